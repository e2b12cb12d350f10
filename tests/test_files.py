"""Readers and writers on small files made here."""

import numpy as np
import pytest

from lattisphere.functions.elements import BOHR
from lattisphere.sources import formats, sinks
from lattisphere.sources.reader import list_formats, read_structures

POSCAR = "title\n2.0\n2 0 0\n0 2 0\n0 0 2\nSi O\n1 2\nDirect\n0 0 0\n0.5 0.5 0.5\n1.25 0 0\n"
DUMP = "ITEM: TIMESTEP\n{t}\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp pp\n1 11\n0 10\n0 10\nITEM: ATOMS id type element xs ys zs\n2 1 Si 0.5 0.5 0.5\n1 2 O 0.1 0.2 0.{t}\nbad row\n"


def one(text, fmt):
    return formats.parse(text, fmt)


def test_vasp():
    f = one(POSCAR, "vasp")[0]
    assert f.symbols == ["Si", "O", "O"] and f.lattice[0] == 4.0 and np.allclose(f.positions, [[0, 0, 0], [2, 2, 2], [1, 0, 0]])
    assert abs(formats.volume(one(POSCAR.replace("2.0", "-27", 1), "vasp")[0].lattice) - 27) < 1e-9
    assert one(POSCAR.replace("Si O\n", ""), "vasp")[0].symbols == ["Type1", "Type2", "Type2"]
    assert one(POSCAR.replace("Direct", "Selective dynamics\nCartesian"), "vasp")[0].positions[1] == [0.5, 0.5, 0.5]
    with pytest.raises(ValueError):
        one(POSCAR.replace("1 2", "-1 2"), "vasp")


def test_xdatcar():
    text = POSCAR.split("Direct")[0] + "".join(f"Direct configuration= {k}\n0 0 0\n0.5 0.5 0.5\n0.25 0 0.{k}\n" for k in (1, 2, 3))
    found = one(text, "xdatcar")
    assert len(found) == 3 and np.allclose(found[2].positions[2], [1, 0, 1.2])


def test_lammps_split_by_frames(spark, tmp_path):
    (tmp_path / "x.dump").write_text("".join(DUMP.format(t=t) for t in range(1, 6)))
    for fmt in ("lammps", None):
        frames, atoms = read_structures(spark, f"file://{tmp_path}/x.dump", fmt)
        rows = sorted(tuple(r) for r in atoms.collect())
        assert frames.count() == 5 and len(rows) == 10 and rows[0][:6] == (0, 0, "Si", 5.0, 5.0, 5.0)
        assert [round(r[5], 6) for r in rows[1::2]] == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_xdatcar_and_pdb_split_by_frames(spark, tmp_path):
    frames_text = "".join(f"Direct configuration= {k}\n0 0 0\n0.5 0.5 0.5\n0.25 0 0.{k}\n" for k in (1, 2, 3))
    (tmp_path / "a.xdatcar").write_text(POSCAR.split("Direct")[0] + frames_text)
    atom = "ATOM      1  SI  UNK     1    {:8.3f}{:8.3f}{:8.3f}  1.00  0.00          SI"
    body = "".join(f"MODEL     {k}\n" + atom.format(k, 2, 3) + "\nENDMDL    \n" for k in (1, 2, 3))
    (tmp_path / "a.pdb").write_text("CRYST1   10.000   11.000   12.000  90.00  90.00  90.00 P 1\n" + body + "END\n")
    for fmt in ("xdatcar", "pdb"):
        path = f"file://{tmp_path}/a.{fmt}"
        whole, parts = read_structures(spark, path), read_structures(spark, path, fmt)
        for one_way, other in zip(whole, parts, strict=True):
            assert sorted(map(tuple, one_way.collect())) == sorted(map(tuple, other.collect())) and other.count() >= 3


def test_files_are_cut_at_their_lines(spark, tmp_path, monkeypatch):
    head = POSCAR.split("Direct")[0]
    body = "".join(f"{'direct' if k % 2 else 'Direct'} configuration= {k}\n0 0 0\n0.5 0.5 0.5\n0.25 0 0.{k}\n" for k in range(1, 8))
    (tmp_path / "XDATCAR").write_text(head + body)
    frame = '2\n{c}\nSi 1 2 {k}\nO 4 5 6\n'
    (tmp_path / "a.xyz").write_text("".join(frame.format(k=k, c=k if k % 2 else f'Lattice="9 0 0 0 9 0 0 0 9" energy={k}') for k in range(7)))
    lattice = "".join(f"  {' '.join('10.0' if i == j else '0.0' for j in range(3))}  <-- h\n" for i in range(3))
    (tmp_path / "a.md").write_text(" BEGIN header\n END header\n\n" + "".join(f"  {k}.0\n  -{k}.5 -1 1 <-- E\n{lattice} Si 1 {k} 2 3 <-- R\n\n" for k in range(7)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "96")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for name in ("XDATCAR", "a.xyz", "a.md"):
            path = tmp_path / name
            found = [sorted(map(tuple, x.collect())) for x in read_structures(spark, f"file://{path}")]
            want = formats.parse(path.read_text(), formats.format_of(name))
            assert spark.read.text(f"file://{path}").rdd.getNumPartitions() > 2 and len(want) == 7 == len(found[0])
            assert [r[-1] for r in found[0]] == [f.energy for f in want]
            assert [r[2] for r in found[1]] == [s for f in want for s in f.symbols] and np.allclose([r[3:6] for r in found[1]], [p for f in want for p in f.positions])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "one.pdb").write_text("CRYST1   10.000   11.000   12.000  90.00  90.00  90.00 P 1\nATOM      1  SI  UNK     1       1.000   2.000   3.000  1.00  0.00          SI\nEND\n")
    frames, atoms = read_structures(spark, f"file://{tmp_path}/one.pdb")
    assert frames.first().ay == 0 and atoms.first().element == "Si"


def test_tilted_box():
    box = DUMP.format(t=1).replace("BOX BOUNDS pp pp pp\n1 11\n0 10\n0 10", "BOX BOUNDS xy xz yz pp pp pp\n0 13 2\n0 11 1\n0 10 1")
    assert np.allclose(one(box, "lammps")[0].lattice, [10, 0, 0, 2, 10, 0, 1, 1, 10])  # the bounds hold the tilt


def test_xyz():
    text = '2\nLattice="5 0 0 0 6 0 0 0 7" Properties=pos:R:3:species:S:1 energy=-1.5\n1 2 3 Si\n4 5 6 O\n' * 2
    found = one(text, "xyz")
    assert len(found) == 2 and found[1].symbols == ["Si", "O"] and found[1].positions[1] == [4, 5, 6] and found[0].energy == -1.5 and found[0].lattice[4] == 6


def test_gro_and_pdb():
    row = "    1WATER  OW1    1   0.100   0.200   0.300  0.0000  0.0000  0.0000\n"
    assert one("t\n1\n" + row + "  1.0 2.0 3.0\n", "gromacs")[0].symbols == ["O"]
    f = one("t\n1\n" + row + "  1.0 2.0 3.0\n", "gromacs")[0]
    assert np.allclose(f.positions, [[1, 2, 3]]) and f.lattice[8] == 30
    atom = "ATOM      1 1HB  ALA A   1    {:8.3f}{:8.3f}{:8.3f}  1.00  0.00"
    text = "CRYST1   10.000   11.000   12.000  90.00  90.00  90.00\n" + "".join(f"MODEL {k}\n{atom.format(k, 2, 3)}\nENDMDL\n" for k in (1, 2))
    found = one(text, "pdb")
    assert len(found) == 2 and found[1].positions == [[2, 2, 3]] and found[0].symbols == ["Hb"]


def test_cif():
    text = "data_x\n_cell_length_a 5.0(1)\n_cell_length_b 5\n_cell_length_c 5\n_cell_angle_alpha 90\n_cell_angle_beta 90\n_cell_angle_gamma 90\nloop_\n_symmetry_equiv_pos_as_xyz\n'x,y,z'\n'-x, -y, -z'\n'x+1/2,y+1/2,z'\nloop_\n_atom_site_label\n_atom_site_type_symbol\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\nNa1 Na1+ 0 0 0\nCl1 Cl 0.25(2) 0.5 0.5\n"
    f = one(text, "cif")[0]
    assert f.symbols.count("Na") == 2 and f.symbols.count("Cl") == 3
    with pytest.raises(ValueError):
        one(text.replace("_cell_length_a 5.0(1)\n", ""), "cif")


def test_car_and_arc():
    body = "PBC 10.0 11.0 12.0 90.0 90.0 90.0 (P1)\nSi1 1.0 2.0 3.0 XXXX 1 xx Si 0.000\nend\n"
    assert one("!BIOSYM\nPBC=ON\n" + body + "end\n", "car")[0].positions == [[1, 2, 3]]
    assert one("PBC=OFF\n-1.0\nSi1 1.0 2.0 3.0 XXXX 1 xx Si 0.000\nend\n", "car")[0].lattice[0] == 100
    found = one("!BIOSYM\nPBC=ON\n" + "".join(f"{-k}.5\n{body}" for k in (1, 2)), "arc")
    assert len(found) == 2 and found[1].energy == -2.5


def test_castep_onetep_and_quantum_codes():
    cell = "%BLOCK LATTICE_ABC\n5 5 5\n90 90 90\n%ENDBLOCK LATTICE_ABC\n%BLOCK POSITIONS_FRAC\nSi 0.5 1.5 0 ! note\n%ENDBLOCK POSITIONS_FRAC\n"
    for fmt in ("castep_cell", "onetep"):
        assert np.allclose(one(cell, fmt)[0].positions, [[2.5, 2.5, 0]])
    md = "BEGIN header\n\nEND header\n\n 0.1\n -5.0 -5.0 0.1 <-- E\n 10 0 0 <-- h\n 0 10 0 <-- h\n 0 0 10 <-- h\n Si 1 1.0 2.0 3.0 <-- R\n -6.0 -5.0 0.1 <-- E\n Si 1 2.0 2.0 3.0 <-- R\n"
    found = one(md, "castep_md")
    assert len(found) == 2 and abs(found[1].lattice[0] - 10 * BOHR) < 1e-9 and abs(found[1].positions[0][0] - 2 * BOHR) < 1e-9
    qe = "CELL_PARAMETERS angstrom\n5 0 0\n0 5 0\n0 0 5\n\nATOMIC_POSITIONS angstrom\nSi 0 0 0\nO 1 1 1\n\nATOMIC_POSITIONS angstrom\nSi 0 0 1\n"
    assert [len(f.symbols) for f in one(qe, "espresso")] == [2, 1]
    cp = "&FORCE_EVAL\n&CELL\nABC 5.0 6.0 7.0\n&END CELL\n&COORD\nO 1 2 3\nH 0 0 0\n&END COORD\n"
    assert one(cp, "cp2k")[0].lattice[4] == 6 and one(cp, "cp2k")[0].symbols == ["O", "H"]
    out = "$cell vectors\n10 0 0\n0 10 0\n0 0 10\n$coordinates\nSi 1 2 3\n$end\n"
    assert abs(one(out, "outmol")[0].positions[0][2] - 3 * BOHR) < 1e-9


def test_names():
    assert formats.format_of("a/POSCAR") == "vasp" and formats.format_of("x.LAMMPSTRJ") == "lammps"
    assert formats.format_of("x.in", "ATOMIC_POSITIONS\n") == "espresso" and formats.format_of("x.out", "&COORD\n") == "cp2k"
    assert len(list_formats()) == 15
    with pytest.raises(ValueError):
        formats.format_of("x.unknown")


@pytest.mark.parametrize("fmt", sorted(formats.PARSERS))
def test_noise_does_not_crash(fmt):
    rng = np.random.default_rng(1)
    for text in ("", "\n\n", "1\n", "loop_\n_a\n", bytes(rng.integers(32, 127, 400, dtype=np.uint8)).decode()):
        try:
            formats.parse(text, fmt)
        except (ValueError, np.linalg.LinAlgError, AttributeError):
            pass


def test_writers(spark, tmp_path):
    rows = [("h", k, k + 0.5, key, float(k), 2.0 * k) for k in range(3) for key in ("B", "A")]
    found = spark.createDataFrame(rows, "hist string, bin_idx long, x double, key string, y double, y_smooth double")
    assert sinks.write_hist(found, f"{tmp_path}/out", ("csv", "parquet", "nothing")).keys() == {"nothing"}
    lines = "".join(p.read_text() for p in sorted((tmp_path / "out.csv").glob("part-*"))).splitlines()
    assert lines[0] == "x,A,B,A_smoothed,B_smoothed" and lines[3] == "0.50000,0.00000,0.00000,0.00000,0.00000" and len(lines) == 6
    table = spark.read.parquet(f"{tmp_path}/out.parquet")
    assert dict(table.dtypes)["A"] == "float" and table.count() == 3
    assert sinks.summary_text({"D": 0.0, "t": 1.5}) == "D: N/A\nt: 1.5"


def test_stream_of_frames(spark, tmp_path):
    from lattisphere.streaming.online import element_profile

    schema = "frame long, atom_id long, element string, x double, y double, z double"
    spark.createDataFrame([(0, 0, "Si", 1.5, 0.0, 0.0), (1, 0, "Si", 1.6, 0.0, 0.0)], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = element_profile(stream, 1.0).writeStream.format("memory").queryName("profile").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.bin_idx, r.key, r.y) for r in spark.table("profile").collect()] == [(1, "Si", 2.0)]


def test_stream_unwraps(spark, tmp_path):
    from lattisphere.streaming.online import online_unwrap

    schema = "frame long, atom_id long, element string, x double, y double, z double"
    steps = [(t, a, "Si", (9.0 + 0.7 * t + a) % 10, 5.0, (1.0 - 0.4 * t) % 10) for t in range(12) for a in (0, 1)]
    for k in range(3):  # three batches, each with its frames out of order
        spark.createDataFrame(steps[8 * k : 8 * k + 8][::-1], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = online_unwrap(stream, [10, 0, 0, 0, 10, 0, 0, 0, 10]).writeStream.format("memory").queryName("places").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    assert q.awaitTermination(120)
    got = {(r.frame, r.atom_id): (r.x, r.y, r.z) for r in spark.table("places").collect()}
    assert len(got) == 24
    for (t, a), place in got.items():
        assert np.allclose(place, [(9.0 + a) % 10 + 0.7 * t, 5.0, 1.0 - 0.4 * t])

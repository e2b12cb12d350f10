"""Operators on crystals and paths whose answers are known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattisphere.functions import elements as el
from lattisphere.functions import geometry as geo
from lattisphere.operators import angular, dynamics, hist, order, pairs, radial, scattering, topology, voronoi
from lattisphere.plans.analysis import Analysis, Options, delete_preset, get_calculator, list_operators, list_presets, register_operator

ATOM = "frame long, atom_id long, element string, x double, y double, z double"
BASES = {
    "sc": [(0, 0, 0)],
    "bcc": [(0, 0, 0), (0.5, 0.5, 0.5)],
    "fcc": [(0, 0, 0), (0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5)],
}


def crystal(spark, kind, a=3.615, n=3, element="Cu"):
    rows = [(0, element, *(a * (np.array(c) + b)).tolist()) for c in np.ndindex(n, n, n) for b in map(np.array, BASES[kind])]
    atoms = spark.createDataFrame([(0, k, e, x, y, z) for k, (_, e, x, y, z) in enumerate(rows)], ATOM)
    side = a * n
    return atoms, geo.frame_table(geo.cell_of_each_frame(atoms, [side, 0, 0, 0, side, 0, 0, 0, side]))


def bonded(atoms, frames, reach):
    found = pairs.periodic_pairs(atoms, frames, reach)
    return found, pairs.bonds_within(found, 0.0, reach**2)


def brute_pairs(atoms, cell, cutoff, reach=3):
    r, cell = np.array([[x.x, x.y, x.z] for x in atoms]), np.array(cell).reshape(3, 3)
    f = r @ np.linalg.inv(cell)
    f -= np.floor(f)
    out = []
    for s in np.ndindex(*[2 * reach + 1] * 3):
        s = np.array(s) - reach
        for i in range(len(f)):
            for j in range(len(f)):
                if tuple(s) > (0, 0, 0) and i != j or tuple(s) == (0, 0, 0) and i < j:
                    d = np.linalg.norm((f[j] + s - f[i]) @ cell)
                    if d < cutoff:
                        out.append((i, j, *s.tolist(), round(d, 6)))
    return sorted(out)


@pytest.mark.parametrize("cell,cutoff", [([4, 0, 0, 0, 5, 0, 0, 0, 6], 4.5), ([9, 0, 0, 2, 8, 0, -1, 1.5, 7], 2.5), ([3, 0, 0, 0.5, 3, 0, 0.2, -0.4, 12], 3.4)])
def test_pairs_match_brute_force(spark, cell, cutoff):
    rng = np.random.default_rng(3)
    rows = [(0, k, "Si", *(rng.uniform(-4, 12, 3)).tolist()) for k in range(25)]
    atoms = spark.createDataFrame(rows, ATOM)
    frames = geo.cell_of_each_frame(atoms, cell)
    got = sorted((r.i, r.j, r.s1, r.s2, r.s3, round(r.d, 6)) for r in pairs.periodic_pairs(atoms, frames, cutoff).collect())
    assert got == brute_pairs(atoms.orderBy("atom_id").collect(), cell, cutoff)


def test_small_cell_equals_supercell(spark):
    one, one_frames = crystal(spark, "fcc", n=1)
    two, two_frames = crystal(spark, "fcc", n=2)
    count = lambda a, f: {round(r.d, 4): r["count"] / a.count() for r in pairs.periodic_pairs(a, f, 6.0, ignore_self=False).withColumn("d", F.round("d", 4)).groupBy("d").count().collect()}
    assert count(one, one_frames) == count(two, two_frames)


def test_pair_search_is_an_equi_join(spark, capsys):
    atoms, frames = crystal(spark, "fcc")
    pairs.periodic_pairs(atoms, frames, 3.0).explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fcc_shell(spark):
    atoms, frames = crystal(spark, "fcc")
    found, bonds = bonded(atoms, frames, 3.0)
    cn = {(r.key, r.bin_idx): r.n for r in topology.coordination_counts(bonds, atoms).collect()}
    assert cn[("Cu-Cu", 12)] == 108 and cn[("Total", 12)] == 108
    g = radial.rdf(found, atoms, frames, 3.0, 0.02).where("hist = 'g_r' and key = 'Total'").orderBy(F.desc("y")).first()
    assert abs(g.x - 3.615 / math.sqrt(2)) < 0.02
    angle = {r.bin_idx for r in angular.pad_counts(angular.angles(bonds), 1.0).collect()}
    assert angle <= {59, 60, 89, 90, 119, 120, 179, 180}
    signatures = {r.signature: r.fraction for r in topology.cna(bonds).collect()}
    assert signatures == {"1421": 1.0}


@pytest.mark.parametrize("kind,reach,q4,q6,w6", [("sc", 4.0, 0.764, 0.354, 0.013), ("bcc", 3.8, 0.036, 0.511, 0.013), ("fcc", 3.0, 0.191, 0.575, -0.013)])
def test_steinhardt(spark, kind, reach, q4, q6, w6):
    atoms, frames = crystal(spark, kind)
    rows = order.steinhardt(bonded(atoms, frames, reach)[1]).collect()
    assert len(rows) == atoms.count()
    for r in rows:
        assert abs(r.q4 - q4) < 0.015 and abs(r.q6 - q6) < 0.015 and abs(r.w6_hat - w6) < 0.015


@pytest.mark.parametrize("kind,faces,ball", [("sc", 6, 0.806), ("bcc", 14, 0.910), ("fcc", 12, 0.905)])
def test_voronoi(spark, kind, faces, ball):
    atoms, frames = crystal(spark, kind, n=2)
    rows = voronoi.voronoi_cells(atoms, frames).collect()
    share = frames.first().volume / len(rows)
    assert len(rows) == atoms.count()
    for r in rows:
        assert abs(r.volume - share) < 1e-6 * share and r.faces == faces and abs(r.sphericity - ball) < 0.01


def test_voronoi_distributions(spark):
    cells = spark.createDataFrame([(0, 0, "Si", 10.0, 0.9, 12, "a"), (0, 1, "O", 5.0, 0.8, 6, "b"), (1, 0, "Si", 10.0, 0.9, 12, "b"), (1, 1, "O", 10.0, 0.8, 6, "b")], "frame long, atom_id long, element string, volume double, sphericity double, faces long, signature string")
    got = {(r.frame, r.hist, r.bin_idx, r.key): r.y for r in voronoi.distributions(cells).collect()}
    assert got[0, "Voronoi Volume", 83, "Total"] == 0.5 and got[1, "Voronoi Volume", 83, "Total"] == 1.0 and got[0, "Voronoi Volume", 41, "O"] == 0.5
    assert got[0, "Voronoi Sphericity", 80, "O"] == 0.5 and got[0, "Voronoi Coordination Number", 12, "Si"] == 0.5
    assert got[1, "Voronoi Signatures", 0, "Total"] == 1.0 and got[0, "Voronoi Signatures", 1, "Si"] == 0.5
    assert voronoi.distributions(cells.limit(0)).count() == 0


def test_smoothing_fills_gaps(spark):
    rows = [("h", k, k + 0.5, "A", 1.0) for k in (3, 4, 7)]
    found = spark.createDataFrame(rows, "hist string, bin_idx long, x double, key string, y double")
    got = {r.bin_idx: (r.x, r.y, r.y_smooth) for r in hist.smoothed(found, 0.5).collect()}
    w = hist.kernel(5, 1.0, 1.0)
    assert sorted(got) == [3, 4, 5, 6, 7] and got[5][:2] == (5.5, 0.0)
    assert abs(got[5][2] - (w[0] + w[1] + w[4])) < 1e-12 and abs(got[3][2] - (w[0] + w[1] + w[2] + w[3])) < 1e-12
    assert "y_smooth" not in hist.smoothed(found.where("bin_idx = 3"), 0.5).columns


def test_voronoi_fills_the_cell(spark):
    rng = np.random.default_rng(1)
    atoms = spark.createDataFrame([(0, k, "Si", *rng.uniform(0, 8, 3).tolist()) for k in range(40)], ATOM)
    frames = geo.frame_table(geo.cell_of_each_frame(atoms, [8, 0, 0, 1, 8, 0, 0, -1, 8]))
    assert abs(voronoi.voronoi_cells(atoms, frames).agg(F.sum("volume")).first()[0] - frames.first().volume) < 1e-4


def ring(spark, n, element="C"):
    radius = 1.4 / (2 * math.sin(math.pi / n))
    rows = [(0, k, element, 10 + radius * math.cos(2 * math.pi * k / n), 10 + radius * math.sin(2 * math.pi * k / n), 10.0) for k in range(n)]
    atoms = spark.createDataFrame(rows, ATOM)
    return atoms, geo.frame_table(geo.cell_of_each_frame(atoms, [20, 0, 0, 0, 20, 0, 0, 0, 20]))


@pytest.mark.parametrize("n", [3, 5, 6])
def test_rings(spark, n):
    atoms, frames = ring(spark, n)
    bonds = bonded(atoms, frames, 1.5)[1]
    assert [(r.size, r.n, r.fraction) for r in topology.ring_sizes(topology.rings(bonds, 8)).collect()] == [(n, 1, 1.0)]
    assert [(r["size"], r.n) for r in topology.cluster_sizes(topology.clusters(bonds, atoms)).collect()] == [(n, 1)]


def test_shortest_rings_of_a_cube():
    near = {v: [v ^ 1, v ^ 2, v ^ 4] for v in range(8)}
    found = topology.shortest_rings(near, range(8), 6)
    assert sum(len(r) == 4 for r in found) == 6 and sum(len(r) == 6 for r in found) == 4


def test_longest_path():
    assert topology.longest_path([(1, 2), (2, 3), (3, 4), (2, 5)]) == 3
    assert topology.longest_path([(a, b) for a in range(25) for b in range(a)]) == 24


def test_water_hydrogen_bond(spark):
    rows = [(0, 0, "O", 5.0, 5.0, 5.0), (0, 1, "H", 5.96, 5.0, 5.0), (0, 2, "O", 7.8, 5.0, 5.0), (0, 3, "O", 5.0, 8.0, 5.0)]
    atoms = spark.createDataFrame(rows, ATOM)
    frames = geo.frame_table(geo.cell_of_each_frame(atoms, [20, 0, 0, 0, 20, 0, 0, 0, 20]))
    bonds = pairs.bonds(pairs.periodic_pairs(atoms, frames, 3.6), el.bond_cutoffs(spark, ["O", "H"]))
    found = topology.hydrogen_bonds(atoms, frames, bonds)
    assert [(r.donor, r.h, r.acceptor) for r in found.collect()] == [(0, 1, 2)]
    assert {r.bin_idx: r.n for r in topology.hydrogen_bond_counts(atoms, found).collect()} == {0: 1, 1: 2}


def moving(spark, frames=8, speed=1.5):
    rows = [(t, k, "Ar", (speed * t + k) % 10.0, 0.0, 0.0) for t in range(frames) for k in range(3)]
    atoms = spark.createDataFrame(rows, ATOM)
    return atoms, geo.frame_table(geo.cell_of_each_frame(atoms, [10, 0, 0, 0, 10, 0, 0, 0, 10]))


def test_constant_velocity(spark):
    atoms, frames = moving(spark, speed=1.0)
    for by_fft in (True, False):
        found = {r.lag: r for r in dynamics.msd(atoms, frames, by_fft=by_fft).collect()}
        assert [round(found[k].msd, 9) for k in range(5)] == [0, 1, 4, 9, 16]
        assert abs(found[1].d_eff - 1 / 6) < 1e-9 and abs(found[2].d_eff - 1 / 3) < 1e-9
    v = dynamics.velocities(atoms, frames)
    assert {round(r.vx, 9) for r in v.collect()} == {1.0}


def test_vacf_without_drift_keeps_counter_motion(spark):
    rows = [(t, k, "Ar", (5 + (1 if k else -1) * 0.5 * t) % 10.0, 0.0, float(k)) for t in range(6) for k in range(2)]
    atoms = spark.createDataFrame(rows, ATOM)
    frames = geo.cell_of_each_frame(atoms, [10, 0, 0, 0, 10, 0, 0, 0, 10])
    found = dynamics.vacf(dynamics.velocities(atoms, frames)).collect()
    assert len(found) == 6 and all(abs(r.vacf_norm - 1) < 1e-9 for r in found)
    assert dynamics.vdos(dynamics.vacf(dynamics.velocities(atoms, frames))).count() > 0


def test_repeated_frames_go(spark):
    places = [0.0, 0.0, 4e-6, 9e-6, 1.2e-5, 1.0, 1.0]
    atoms = spark.createDataFrame([(t, 0, "Ar", x, 0.0, 0.0) for t, x in enumerate(places)], ATOM)
    assert sorted(r.frame for r in dynamics.dedup_frames(atoms).where("kept").collect()) == [0, 4, 5]


def test_filon_matches_quadrature():
    t = np.arange(0, 41.0)
    f = np.exp(-t / 10)
    real, _ = dynamics.filon(np.array([0.0, 0.1, 0.3]), f, 1.0)
    fine = np.linspace(0, 40, 400_001)
    for value, theta in zip(real, (0.0, 0.1, 0.3), strict=True):
        y = np.exp(-fine / 10) * np.cos(theta * fine)
        assert abs(value - float(((y[1:] + y[:-1]) / 2).sum() * (fine[1] - fine[0]))) < 0.02


def test_single_atom_structure_factor(spark):
    atoms = spark.createDataFrame([(0, 0, "Si", 1.0, 2.0, 3.0)], ATOM)
    frames = geo.cell_of_each_frame(atoms, [6, 0, 0, 0, 6, 0, 0, 0, 6])
    rows = scattering.structure_factor(atoms, frames, 4.0, 0.5).where("key = 'Total'").collect()
    assert rows and all(abs(r.y - 1) < 1e-9 for r in rows)


def test_copper_reflection(spark):
    atoms, frames = crystal(spark, "fcc", n=4)
    found = pairs.periodic_pairs(atoms, frames, 7.2)
    g = radial.rdf(found, atoms, frames, 7.2, 0.02).where("hist = 'g_r' and key <> 'Total'").join(radial.pair_weights(atoms).select("frame", "key", "w"), ["frame", "key"])
    best = scattering.xrd_from_g(g, atoms, frames, low=30.0, high=60.0, width=0.5).orderBy(F.desc("y")).first()
    assert abs(best.x - 43.3) < 1.5


def test_unknown_elements_have_no_pattern(spark):
    atoms = spark.createDataFrame([(0, 0, "Fe", 1.0, 2.0, 3.0), (0, 1, "Xx", 2.0, 2.0, 3.0)], ATOM)
    frames = geo.frame_table(geo.cell_of_each_frame(atoms, [6, 0, 0, 0, 6, 0, 0, 0, 6]))
    for kept, good in ((atoms.where("element = 'Fe'"), True), (atoms, False)):
        s = scattering.structure_factor(kept, frames, 4.0, 0.5)
        g = radial.rdf(pairs.periodic_pairs(kept, frames, 2.9), kept, frames, 2.9, 0.1).where("hist = 'g_r' and key <> 'Total'").join(radial.pair_weights(kept).select("frame", "key", "w"), ["frame", "key"])
        for found in (scattering.xrd_from_s(s, kept, width=10.0), scattering.xrd_from_g(g, kept, frames, width=10.0, dr=0.1)):
            if good:
                assert found.count() == 14
            else:
                with pytest.raises(Exception, match="no form factor for element Xx"):
                    found.collect()
    assert len(el.FORM_FACTORS) == 98 and all(len(v) == 9 for v in el.FORM_FACTORS.values())
    assert el.form_factor_coefficients("Si") == [5.275329, 2.631338, 3.191038, 33.730728, 1.511514, 0.081119, 1.356849, 86.288643, 0.145073]
    with pytest.raises(KeyError):
        el.form_factor_coefficients("Xx")


def test_structure_factor_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    atoms = spark.createDataFrame([(f, k, "SiO"[:2] if k % 3 else "O", *map(float, rng.uniform(0, 7, 3))) for f in range(2) for k in range(60)], ATOM)
    frames = geo.frame_table(geo.cell_of_each_frame(atoms, [7, 0, 0, 1, 6, 0, 0, 2, 8]))
    whole = sorted(map(tuple, scattering.structure_factor(atoms, frames, 3.0, 0.5).collect()))
    monkeypatch.setattr(scattering, "ATOM_BLOCK", 7)
    monkeypatch.setattr(scattering, "VECTOR_BLOCK", 5)
    parts = sorted(map(tuple, scattering.structure_factor(atoms, frames, 3.0, 0.5).collect()))
    assert len(whole) == len(parts) > 10
    for a, b in zip(whole, parts, strict=True):
        assert a[:2] == b[:2] and a[3] == b[3] and a[5] == b[5] and abs(a[4] - b[4]) < 1e-9
    rows = [tuple(r) for r in atoms.where("frame = 1").select("x", "y", "z").collect()]
    cell = np.array([[7, 0, 0], [1, 6, 0], [0, 2, 8.0]])
    dual, sums = 2 * np.pi * np.linalg.inv(cell).T, {}
    for h in np.ndindex(21, 21, 21):
        q = (np.array(h) - 10) @ dual
        if 1e-12 < np.linalg.norm(q) <= 3.0 and np.linalg.norm(q) // 0.5 < 6:
            sums.setdefault(int(np.linalg.norm(q) // 0.5), []).append(abs(np.exp(1j * (np.array(rows) @ q)).sum()) ** 2 / 60)
    got = {r[1]: (r[4], r[5]) for r in whole if r[0] == 1 and r[3] == "Total"}
    assert got.keys() == sums.keys() and all(abs(got[b][0] - np.mean(v)) < 1e-9 and got[b][1] == len(v) for b, v in sums.items())


def test_both_ways_to_a_voronoi_cell():
    rng = np.random.default_rng(12)
    for _ in range(20):
        v = rng.normal(size=(60, 3)) * 3
        v = v[np.argsort(np.linalg.norm(v, axis=1))]
        d = np.linalg.norm(v, axis=1)
        one, other = voronoi.cell(v, 50.0), voronoi._clipped(v, d, 50.0)
        if one is None or other is None:
            continue
        assert np.allclose(one[:2], other[:2]) and one[2:] == other[2:]


def test_crowded_frames_have_finer_bins(spark):
    rng = np.random.default_rng(6)
    cell = [8, 0, 0, 2, 7, 0, 1, 1, 9]
    places = rng.uniform(0, 7, (900, 3))
    atoms = spark.createDataFrame([(0, k, "Ar", *map(float, p)) for k, p in enumerate(places)], ATOM)
    frames = geo.cell_of_each_frame(atoms, cell)
    assert pairs.grid(atoms, frames, 2.5).first().nb1 > 3
    got = sorted((min(r.i, r.j), max(r.i, r.j), round(r.d, 6)) for r in pairs.periodic_pairs(atoms, frames, 2.5).collect())
    want = []
    for s in np.ndindex(5, 5, 5):
        r = places[None, :, :] + (np.array(s) - 2) @ np.array(cell, float).reshape(3, 3) - places[:, None, :]
        d = np.sqrt((r**2).sum(axis=2))
        i, j = np.nonzero(d < 2.5)
        want += [(int(a), int(b), round(float(d[a, b]), 6)) for a, b in zip(i, j, strict=True) if a < b]
    assert got == sorted(want)


def test_frames_by_place_and_large_grids(spark):
    atoms = spark.createDataFrame([(t, 0, "Ar", float(t), 0.0, 0.0) for t in range(4)], ATOM)
    assert dynamics.frame_at(atoms, -1).first().x == 3.0 and dynamics.frame_at(atoms, 1).first().x == 1.0
    for bad in (4, -5):
        with pytest.raises(IndexError):
            dynamics.frame_at(atoms, bad)
    frames = geo.frame_table(geo.cell_of_each_frame(atoms, [60, 0, 0, 0, 60, 0, 0, 0, 60]))
    assert order.density_grid(atoms, frames).count() == 0 and order.frames_without_grid(frames).count() == 4
    a = Analysis(frames, atoms)
    cna, sdf = get_calculator("CNA"), get_calculator("SDF").run(Analysis(geo.frame_table(geo.cell_of_each_frame(atoms, [9, 0, 0, 0, 9, 0, 0, 0, 9])), atoms))
    assert cna.run(a).count() == 0 and sorted({r.key for r in sdf.collect()}) == ["Ar", "Total"] and {r.x for r in sdf.collect()} == {0.0}


def test_lattice_round_trip(spark):
    want = [5.0, 6.0, 7.0, 80.0, 95.0, 110.0]
    frames = spark.createDataFrame([(0, *geo.lattice_from_parameters(*want))], "frame long, " + ", ".join(f"{c} double" for c in geo.LATTICE))
    assert np.allclose(geo.frame_table(frames).first().lattice_params, want)
    for bad in ([0, 1, 1, 90, 90, 90], [1, 1, 1, 0, 90, 90], [1, 1, 1, 10, 10, 170]):
        with pytest.raises(ValueError):
            geo.lattice_from_parameters(*bad)


def test_elements():
    assert el.atomic_number("Si") == 14 and el.atomic_number("Zz") == 0 and len(el.SYMBOLS) == 118 and len(el.RADII) == len(el.MASSES) == 98
    with pytest.raises(KeyError):
        el.covalent_radius("Zz")


@pytest.mark.parametrize("kind", ["gaussian", "bump", "triweight", "epanechnikov", "cosine", "biweight"])
def test_kernels(kind):
    w = hist.kernel(17, 0.05, 0.1, kind)
    assert abs(sum(w) - 1) < 1e-12 and max(w) == w[8] and np.allclose(w, w[::-1])


def test_analysis(spark, tmp_path):
    atoms, frames = crystal(spark, "fcc", n=2)
    a = Analysis(frames, atoms, Options(r_max=3.0, dr=0.05, bond_ranges={"Cu-Cu": (0.5, 3.0)}))
    out = a.run(["CN", "Clusters"])
    assert {(r.key, r.bin_idx): r.y for r in out["CN"].collect()}[("Cu-Cu", 12)] == 32
    assert [(r.bin_idx, r.y) for r in out["Clusters"].collect()] == [(32, 1.0)]
    assert len(list_operators()) >= 18 and get_calculator("RDF").short == "RDF"
    assert get_calculator("BAD").short == "PAD" and get_calculator("S_Q_GPU").short == "S_K"
    by_g = Analysis(frames, atoms, Options(r_max=3.0, dr=0.05, xrd_from="g")).run(["XRD"])["XRD"]
    assert by_g.where("y is null").count() == 0 and by_g.count() == 2601
    register_operator("Atoms", "N", "Own")(lambda x: x.atoms.groupBy("frame").agg(F.count("*").cast("double").alias("y")).selectExpr("frame", "'N' hist", "0L bin_idx", "0.0D x", "'Total' key", "y"))
    assert a.run(["N"])["N"].first().y == 32.0
    Options(r_max=7.0).save("mine", str(tmp_path))
    assert Options.load("mine", str(tmp_path)).r_max == 7.0 and list_presets(str(tmp_path)) == ["mine"]
    delete_preset("mine", str(tmp_path))
    for wrong in ({"dr": 0}, {"xrd_from": "x"}):
        with pytest.raises(ValueError):
            Options(**wrong)

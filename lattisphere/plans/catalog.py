"""Registry of named queries and of the SQL that each must match."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from ..functions import elements as el
from ..functions import geometry as geo
from ..operators import angular, dynamics, hist, order, pairs, radial, scattering, topology, voronoi
from ..operators.near import Near
from .inputs import BONDS_SQL, PATHS_SQL, POINTS_SQL, cube, pairs_sql, paths, points

R_MAX, DR, REACH = 5.0, 0.05, 1.6
N_BINS = int(R_MAX / DR + 1e-9)
QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame with its SQL."""

    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return keep


def near(column, places: int = 6):
    """A rounded double without a negative zero."""
    return (F.round(column, places) + F.lit(0.0)).cast("double")


def r(sql: str, places: int = 6) -> str:
    return f"CAST(round({sql}, {places}) + 0.0 AS DOUBLE)"


def _bonded(spark, d):
    atoms = points(spark, d)
    found = pairs.periodic_pairs(atoms, cube(atoms), REACH)
    return atoms, pairs.bonds_within(found, 0.0, 1.44)


def _near(spark, d, reach: float = REACH, high: float = 1.44):
    """The atoms with their bonds as a search for each block of them."""
    atoms = points(spark, d)
    return atoms, Near(atoms, cube(atoms), reach, 0.0, high)


BONDED = f"WITH {POINTS_SQL}, {pairs_sql(REACH)}, {BONDS_SQL}"
RADIAL = f"WITH {POINTS_SQL}, {pairs_sql(R_MAX)}"

# --- structure and geometry -------------------------------------------------------------------------------------------------


@query("element_counts", f"WITH {POINTS_SQL} SELECT element, CAST(count(*) AS BIGINT) AS n FROM atoms GROUP BY element")
def element_counts(spark, d):
    return radial.element_counts(points(spark, d)).select("element", "n")


@query("min_image", f"WITH {PATHS_SQL} SELECT frame, atom_id, {', '.join(r(f'(2.5 * {c} - 13) - 20 * round((2.5 * {c} - 13) / 20)') + f' AS m{c}' for c in 'xyz')} FROM atoms")
def min_image(spark, d):
    atoms = paths(spark, d)
    held = atoms.join(cube(atoms).select("frame", *geo.LATTICE), "frame")
    m = geo.min_image(tuple(2.5 * F.col(c) - 13 for c in "xyz"))
    return held.select("frame", "atom_id", *[near(m[k]).alias(f"m{c}") for k, c in enumerate("xyz")])


@query("wrap_positions", f"WITH {PATHS_SQL} SELECT frame, atom_id, {', '.join(r(f'(2.5 * {c} - 13.003) - 20 * floor((2.5 * {c} - 13.003) / 20)') + f' AS w{c}' for c in 'xyz')} FROM atoms")
def wrap_positions(spark, d):
    atoms = paths(spark, d)
    held = atoms.join(cube(atoms).select("frame", *geo.LATTICE), "frame")
    w = geo.wrapped(tuple(2.5 * F.col(c) - 13.003 for c in "xyz"))
    return held.select("frame", "atom_id", *[near(w[k]).alias(f"w{c}") for k, c in enumerate("xyz")])


@query("lattice_parameters", f"WITH {PATHS_SQL} SELECT DISTINCT frame, 8000.0::DOUBLE AS volume, 20.0::DOUBLE AS a, 90.0::DOUBLE AS alpha FROM atoms")
def lattice_parameters(spark, d):
    return cube(paths(spark, d)).select("frame", near("volume").alias("volume"), near(F.col("lattice_params")[0]).alias("a"), near(F.col("lattice_params")[3]).alias("alpha"))


_RADII = ", ".join(f"('{s}', {el.covalent_radius(s)}::DOUBLE)" for s in ("H", "O", "Si"))


@query("bond_cutoffs", f"WITH {POINTS_SQL}, radii(s, q) AS (VALUES {_RADII}), kinds AS (SELECT DISTINCT element AS s FROM atoms) SELECT a.s AS e1, b.s AS e2, {r('(0.6::DOUBLE * (x.q + y.q)) * (0.6::DOUBLE * (x.q + y.q))')} AS min_sq, {r('(1.3::DOUBLE * (x.q + y.q)) * (1.3::DOUBLE * (x.q + y.q))')} AS max_sq FROM kinds a, kinds b, radii x, radii y WHERE x.s = a.s AND y.s = b.s")
def bond_cutoffs(spark, d):
    symbols = [x[0] for x in points(spark, d).select("element").distinct().collect()]  # elements: 118 at most
    return el.bond_cutoffs(spark, symbols).select("e1", "e2", near("min_sq").alias("min_sq"), near("max_sq").alias("max_sq"))


@query("element_properties", f"WITH {POINTS_SQL}, radii(s, q) AS (VALUES {_RADII}), masses(s, m) AS (VALUES {', '.join(f'({chr(39)}{s}{chr(39)}, {el.atomic_mass(s)}::DOUBLE)' for s in ('H', 'O', 'Si'))}) SELECT a.atom_id, q AS radius, m AS mass FROM atoms a JOIN radii USING (s) JOIN masses USING (s)".replace("JOIN radii USING (s)", "JOIN radii x ON x.s = a.element").replace("JOIN masses USING (s)", "JOIN masses y ON y.s = a.element"))
def element_properties(spark, d):
    return points(spark, d).join(F.broadcast(el.elements(spark)), "element").select("atom_id", "radius", "mass")


@query("time_step", f"WITH {POINTS_SQL}, masses(s, m) AS (VALUES {', '.join(f'({chr(39)}{s}{chr(39)}, {el.atomic_mass(s)}::DOUBLE)' for s in ('H', 'O', 'Si'))} ) SELECT {r('sqrt(9.0::DOUBLE * min(m) / 5.0::DOUBLE)')} AS time_step FROM atoms a JOIN masses y ON y.s = a.element")
def time_step(spark, d):
    return el.recommended_time_step(points(spark, d)).select(near("time_step").alias("time_step"))


# --- pairs and radial distributions ---------------------------------------------------------------------------------------------

_KEY = "CASE WHEN e1 < e2 THEN e1 || '-' || e2 ELSE e2 || '-' || e1 END"
_COUNTS = f"counts AS (SELECT {_KEY} AS key, CAST(floor(d / {DR}::DOUBLE) AS BIGINT) AS bin_idx, CAST(sum(CASE WHEN e1 = e2 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM pairs GROUP BY 1, 2)"
_WEIGHTS = "el AS (SELECT element, count(*) AS n FROM atoms GROUP BY element), tot AS (SELECT count(*) AS n FROM atoms), weights AS (SELECT a.element AS ei, b.element AS ej, a.element || '-' || b.element AS key, a.n AS ni, b.n AS nj, tot.n AS n, CAST(a.n AS DOUBLE) * b.n / (CAST(tot.n AS DOUBLE) * tot.n) * CASE WHEN a.element = b.element THEN 1 ELSE 2 END AS w FROM el a, el b, tot WHERE a.element <= b.element)"
_GRID = f"grid AS (SELECT w.*, CAST(g.k AS BIGINT) AS bin_idx, (g.k + 0.5::DOUBLE) * {DR}::DOUBLE AS x, CASE WHEN g.k > 0 THEN coalesce(c.n, 0) ELSE 0 END AS live, coalesce(c.n, 0) AS h FROM weights w CROSS JOIN range({N_BINS}) g(k) LEFT JOIN counts c ON c.key = w.key AND c.bin_idx = g.k), g AS (SELECT *, live * 8000.0::DOUBLE / (4 * pi() * {DR}::DOUBLE * ni * nj * x * x) AS g, n / 8000.0::DOUBLE AS rho FROM grid)"
_RDF = f"{RADIAL}, {_COUNTS}, {_WEIGHTS}, {_GRID}"


def _rdf(spark, d, name):
    atoms = points(spark, d)
    frames = cube(atoms)
    found = radial.rdf(Near(atoms, frames, R_MAX), atoms, frames, R_MAX, DR)
    return found.where(F.col("hist") == name).select("bin_idx", near("x").alias("x"), "key", near("y").alias("y"))


@query("rdf_counts", f"{RADIAL}, {_COUNTS} SELECT * FROM counts")
def rdf_counts(spark, d):
    atoms = points(spark, d)
    return radial.pair_counts(Near(atoms, cube(atoms), R_MAX), DR).select("key", "bin_idx", "n")


@query("rdf_h", f"{_RDF} SELECT bin_idx, {r('x')} AS x, key, {r('CAST(h AS DOUBLE)')} AS y FROM g UNION ALL SELECT bin_idx, {r('x')}, 'Total', {r('CAST(sum(h) AS DOUBLE)')} FROM g GROUP BY bin_idx, x")
def rdf_h(spark, d):
    return _rdf(spark, d, "H_r")


@query("rdf_g_unweighted", f"{_RDF} SELECT bin_idx, {r('x')} AS x, key, {r('g')} AS y FROM g UNION ALL SELECT bin_idx, {r('x')}, 'Total', {r('sum(w * g)')} FROM g GROUP BY bin_idx, x")
def rdf_g_unweighted(spark, d):
    return _rdf(spark, d, "g_r_unweighted")


@query("rdf_g", f"{_RDF} SELECT bin_idx, {r('x')} AS x, key, {r('w * g')} AS y FROM g UNION ALL SELECT bin_idx, {r('x')}, 'Total', {r('sum(w * g)')} FROM g GROUP BY bin_idx, x")
def rdf_g(spark, d):
    return _rdf(spark, d, "g_r")


@query("rdf_j", f"{_RDF} SELECT bin_idx, {r('x')} AS x, ei || '-' || ej AS key, {r(f'live / (ni * {DR}::DOUBLE)')} AS y FROM g UNION ALL SELECT bin_idx, {r('x')}, ej || '-' || ei, {r(f'live / (nj * {DR}::DOUBLE)')} FROM g WHERE ei <> ej UNION ALL SELECT bin_idx, {r('x')}, 'Total', {r('4 * pi() * x * x * any_value(rho) * sum(w * g)')} FROM g GROUP BY bin_idx, x")
def rdf_j(spark, d):
    return _rdf(spark, d, "J_r")


@query("rdf_G", f"{_RDF} SELECT bin_idx, {r('x')} AS x, key, {r('4 * pi() * rho * x * (w * g - w)')} AS y FROM g UNION ALL SELECT bin_idx, {r('x')}, 'Total', {r('4 * pi() * any_value(rho) * x * (sum(w * g) - 1)')} FROM g GROUP BY bin_idx, x")
def rdf_G(spark, d):  # noqa: N802
    return _rdf(spark, d, "G_r")


@query("pair_weights", f"WITH {POINTS_SQL}, {_WEIGHTS} SELECT key, CAST(ni AS BIGINT) AS ni, CAST(nj AS BIGINT) AS nj, {r('w')} AS w FROM weights")
def pair_weights(spark, d):
    return radial.pair_weights(points(spark, d)).select("key", "ni", "nj", near("w").alias("w"))


@query("bond_list", f"{BONDED} SELECT src, dst, e1, e2, {r('d')} AS d, {r('rx')} AS rx, {r('ry')} AS ry, {r('rz')} AS rz FROM bonds")
def bond_list(spark, d):
    _, bonds = _near(spark, d)
    return bonds.listed().select("src", "dst", "e1", "e2", *[near(c).alias(c) for c in ("d", "rx", "ry", "rz")])


@query("graph_edges", f"WITH {POINTS_SQL}, {pairs_sql(R_MAX)} SELECT i AS src, j AS dst, {r('d')} AS d FROM pairs WHERE d <= 1.2 UNION ALL SELECT j, i, {r('d')} FROM pairs WHERE d <= 1.2")
def graph_edges(spark, d):
    atoms = points(spark, d)
    return pairs.graph_edges(atoms, cube(atoms), 1.2).select("src", "dst", near("d").alias("d"))


# --- bond graph ---------------------------------------------------------------------------------------------------------------


@query("cn_hist", f"{BONDED}, each AS (SELECT src, e1, e2, CAST(count(*) AS BIGINT) AS bin_idx FROM bonds GROUP BY ALL), named AS (SELECT e1 || '-' || e2 AS key, bin_idx FROM each UNION ALL SELECT e1 || '-Any', bin_idx FROM each UNION ALL SELECT 'Total', bin_idx FROM each) SELECT key, bin_idx, CAST(count(*) AS BIGINT) AS n FROM named GROUP BY ALL")
def cn_hist(spark, d):
    atoms, bonds = _near(spark, d)
    return topology.coordination_counts(bonds, atoms).select("key", "bin_idx", "n")


_ANGLE = "degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (p.rx * q.rx + p.ry * q.ry + p.rz * q.rz) / (p.d * q.d)))))"


@query("angle_hist", f"{BONDED} SELECT least(p.e2, q.e2) || '-' || p.e1 || '-' || greatest(p.e2, q.e2) AS key, CAST(least(180, floor({_ANGLE})) AS BIGINT) AS bin_idx, CAST(count(*) AS BIGINT) AS n FROM bonds p JOIN bonds q ON p.src = q.src AND p.dst < q.dst WHERE p.d >= 1e-6 AND q.d >= 1e-6 GROUP BY 1, 2")
def angle_hist(spark, d):
    _, bonds = _near(spark, d)
    return angular.pad_counts(bonds).select("key", "bin_idx", "n")


@query("pad", f"{BONDED}, a AS (SELECT least(p.e2, q.e2) || '-' || p.e1 || '-' || greatest(p.e2, q.e2) AS key, CAST(least(180, floor({_ANGLE})) AS BIGINT) AS bin_idx FROM bonds p JOIN bonds q ON p.src = q.src AND p.dst < q.dst WHERE p.d >= 1e-6 AND q.d >= 1e-6), k AS (SELECT DISTINCT element AS e FROM atoms), s AS (SELECT x.e || '-' || y.e || '-' || z.e AS key, CAST(g.b AS BIGINT) AS bin_idx FROM k x, k y, k z, range(181) g(b) WHERE x.e <= z.e), c AS (SELECT s.key, s.bin_idx, (SELECT count(*) FROM a) AS t, count(a.key) AS n FROM s LEFT JOIN a USING (key, bin_idx) GROUP BY s.key, s.bin_idx) SELECT key, bin_idx, {r('n / CAST(t AS DOUBLE)', 9)} AS y FROM c UNION ALL SELECT 'Total', bin_idx, {r('sum(n) / CAST(any_value(t) AS DOUBLE)', 9)} FROM c GROUP BY bin_idx")
def pad(spark, d):
    atoms, bonds = _near(spark, d)
    return angular.pad(bonds, atoms).where("hist = 'PAD'").select("key", "bin_idx", near("y", 9).alias("y"))


def _cross(u, v):
    return [f"({u}y * {v}z - {u}z * {v}y)", f"({u}z * {v}x - {u}x * {v}z)", f"({u}x * {v}y - {u}y * {v}x)"]


_N1, _N2 = _cross("u", "m"), _cross("m", "w")
_CHAINS = f"""chains AS (SELECT a.dst AS a, m.src AS b, m.dst AS c, z.dst AS d, a.e2 AS ea, m.e1 AS eb, m.e2 AS ec, z.e2 AS ed, -a.rx AS ux, -a.ry AS uy, -a.rz AS uz, m.rx AS mx, m.ry AS my, m.rz AS mz, z.rx AS wx, z.ry AS wy, z.rz AS wz
 FROM bonds m JOIN bonds a ON a.src = m.src AND a.dst <> m.dst JOIN bonds z ON z.src = m.dst AND z.dst <> m.src AND z.dst <> a.dst WHERE m.src < m.dst),
 turned AS (SELECT *, {_N1[0]} AS px, {_N1[1]} AS py, {_N1[2]} AS pz, {_N2[0]} AS qx, {_N2[1]} AS qy, {_N2[2]} AS qz FROM chains),
 phis AS (SELECT *, atan2(sqrt(mx * mx + my * my + mz * mz) * (ux * qx + uy * qy + uz * qz), px * qx + py * qy + pz * qz) AS phi FROM turned WHERE sqrt(px * px + py * py + pz * pz) >= 1e-8 AND sqrt(qx * qx + qy * qy + qz * qz) >= 1e-8)"""


@query("dihedral_hist", f"{BONDED}, {_CHAINS}, named AS (SELECT ea || '-' || eb || '-' || ec || '-' || ed AS key, phi FROM phis UNION ALL SELECT ed || '-' || ec || '-' || eb || '-' || ea, phi FROM phis WHERE ea <> ed OR eb <> ec) SELECT key, CAST(least(72, floor((degrees(phi) + 180.0::DOUBLE) / 5.0::DOUBLE)) AS BIGINT) AS bin_idx, CAST(count(*) AS BIGINT) AS n FROM named GROUP BY 1, 2")
def dihedral_hist(spark, d):
    _, bonds = _near(spark, d)
    return angular.dad_counts(bonds, 5.0).select("key", "bin_idx", "n")


@query("cna_counts", f"{BONDED}, common AS (SELECT p.i, p.j, x.dst AS k FROM pairs p JOIN bonds x ON x.src = p.i JOIN bonds y ON y.src = p.j AND y.dst = x.dst WHERE p.d * p.d <= 1.44), sizes AS (SELECT i, j, count(*) AS n FROM common GROUP BY i, j), inner_bonds AS (SELECT a.i, a.j, count(*) AS m FROM common a JOIN common b ON a.i = b.i AND a.j = b.j AND a.k < b.k JOIN bonds e ON e.src = a.k AND e.dst = b.k GROUP BY a.i, a.j) SELECT CAST(coalesce(n, 0) AS BIGINT) AS n_common, CAST(coalesce(m, 0) AS BIGINT) AS n_bonds, CAST(count(*) AS BIGINT) AS n FROM pairs p LEFT JOIN sizes s ON s.i = p.i AND s.j = p.j LEFT JOIN inner_bonds b ON b.i = p.i AND b.j = p.j WHERE p.d * p.d <= 1.44 GROUP BY 1, 2")
def cna_counts(spark, d):
    _, bonds = _near(spark, d)
    return topology.common_counts(bonds).select("n_common", "n_bonds", "n")


@query("cna_full")
def cna_full(spark, d):
    _, bonds = _near(spark, d)
    return topology.cna(bonds).select("signature", "n", near("fraction").alias("fraction"))


@query("cluster_sizes", f"{BONDED.replace('WITH', 'WITH RECURSIVE', 1)}, reach AS (SELECT atom_id, atom_id AS root FROM atoms UNION SELECT b.dst, r.root FROM reach r JOIN bonds b ON b.src = r.atom_id WHERE r.root < b.dst), least AS (SELECT atom_id, min(root) AS c FROM reach GROUP BY atom_id), sizes AS (SELECT c, CAST(count(*) AS BIGINT) AS size FROM least GROUP BY c) SELECT size, CAST(count(*) AS BIGINT) AS n FROM sizes GROUP BY size")
def cluster_sizes(spark, d):
    atoms, bonds = _near(spark, d)
    return topology.cluster_sizes(topology.clusters(bonds, atoms)).select("size", "n")


@query("rings3", f"{BONDED} SELECT p.src AS a, p.dst AS b, q.dst AS c FROM bonds p JOIN bonds q ON q.src = p.dst JOIN bonds z ON z.src = p.src AND z.dst = q.dst WHERE p.src < p.dst AND q.src < q.dst")
def rings3(spark, d):
    _, bonds = _bonded(spark, d)
    return topology.triangles(bonds).select("a", "b", "c")


@query("rings_king")
def rings_king(spark, d):
    _, bonds = _bonded(spark, d)
    return topology.ring_sizes(topology.rings(bonds, 5)).select("size", "n", near("fraction").alias("fraction"))


@query("hbond_hist", f"WITH {POINTS_SQL}, {pairs_sql(3.5)}, {BONDS_SQL}, near AS (SELECT i AS donor, j AS acceptor, rx, ry, rz, d FROM pairs UNION ALL SELECT j, i, -rx, -ry, -rz, d FROM pairs), polar AS (SELECT atom_id FROM atoms WHERE element IN ('O', 'N', 'F', 'S')), hb AS (SELECT n.donor, n.acceptor FROM near n JOIN polar x ON x.atom_id = n.donor JOIN polar y ON y.atom_id = n.acceptor JOIN bonds b ON b.src = n.donor AND b.e2 = 'H' WHERE b.d > 0 AND (b.rx * n.rx + b.ry * n.ry + b.rz * n.rz) / (b.d * n.d) > cos(radians(30))), ends AS (SELECT donor AS a FROM hb UNION ALL SELECT acceptor FROM hb), k AS (SELECT a, count(*) AS k FROM ends GROUP BY a) SELECT CAST(coalesce(k, 0) AS BIGINT) AS bin_idx, CAST(count(*) AS BIGINT) AS n FROM polar LEFT JOIN k ON k.a = polar.atom_id GROUP BY 1")
def hbond_hist(spark, d):
    atoms, bonds = _near(spark, d)
    return topology.hydrogen_bond_counts(atoms, topology.hydrogen_bond_ends(bonds)).select("bin_idx", "n")


# --- local order --------------------------------------------------------------------------------------------------------------

_TRIPLE = "(a.ry * b.rz - a.rz * b.ry) * c.rx + (a.rz * b.rx - a.rx * b.rz) * c.ry + (a.rx * b.ry - a.ry * b.rx) * c.rz"


@query("chirality", f"{BONDED}, k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS k FROM bonds WHERE d > 0), chi AS (SELECT a.src, ({_TRIPLE}) / (a.d * b.d * c.d) AS chi FROM k a JOIN k b ON b.src = a.src AND b.k = 2 JOIN k c ON c.src = a.src AND c.k = 3 WHERE a.k = 1) SELECT atom_id, {r('coalesce(chi, 0)')} AS chi FROM atoms LEFT JOIN chi ON src = atom_id")
def chirality(spark, d):
    atoms, bonds = _near(spark, d)
    return order.chirality(bonds, atoms).select("atom_id", near("chi").alias("chi"))


def _legendre(degree: int, u: str) -> str:
    c = order._legendre_derivative(degree, 0)
    return " + ".join(f"({v}::DOUBLE) * pow({u}, {k})" for k, v in enumerate(c) if abs(v) > 1e-12)


@query("q4_q6", f"{BONDED}, u AS (SELECT p.src, (p.rx * q.rx + p.ry * q.ry + p.rz * q.rz) / (p.d * q.d) AS u FROM bonds p JOIN bonds q ON p.src = q.src), n AS (SELECT src, count(*) AS n FROM bonds GROUP BY src HAVING count(*) >= 2) SELECT u.src AS atom_id, {r(f'sqrt(greatest(0, sum({_legendre(4, chr(117))}) / (any_value(n) * any_value(n))))', 5)} AS q4, {r(f'sqrt(greatest(0, sum({_legendre(6, chr(117))}) / (any_value(n) * any_value(n))))', 5)} AS q6 FROM u JOIN n USING (src) GROUP BY u.src")
def q4_q6(spark, d):
    _, bonds = _near(spark, d)
    return order.steinhardt(bonds, with_w6=False).select("atom_id", near("q4", 5).alias("q4"), near("q6", 5).alias("q6"))


_LEF = "(exp(-(r - d) * (r - d) / 0.08::DOUBLE) + exp(-(r + d) * (r + d) / 0.08::DOUBLE))"


@query("local_entropy", f"WITH {POINTS_SQL}, {pairs_sql(5.0000001)}, near AS (SELECT i AS a, d FROM pairs WHERE d * d <= 25 UNION ALL SELECT j, d FROM pairs WHERE d * d <= 25), grid AS (SELECT k * 0.02::DOUBLE AS r, CASE WHEN k = 250 THEN 0.01::DOUBLE ELSE 0.02::DOUBLE END AS w FROM range(1, 251) t(k)), rho AS (SELECT count(*) / 8000.0::DOUBLE AS rho FROM atoms), g AS (SELECT atom_id, r, w, rho, coalesce(sum({_LEF}), 0) / (0.2::DOUBLE * sqrt(2 * pi())) / (4 * pi() * rho * r * r) AS g FROM atoms CROSS JOIN grid CROSS JOIN rho LEFT JOIN near ON near.a = atom_id GROUP BY atom_id, r, w, rho) SELECT atom_id, {r('-2 * pi() * any_value(rho) * sum((CASE WHEN g > 1e-10 THEN g * ln(g) - g + 1 ELSE 1 END) * r * r * w)', 5)} AS entropy FROM g GROUP BY atom_id")
def local_entropy(spark, d):
    atoms = points(spark, d)
    return order.local_entropy(atoms, cube(atoms)).select("atom_id", near("entropy", 5).alias("entropy"))


@query("sdf_grid", f"WITH {POINTS_SQL} SELECT element AS key, {', '.join(f'CAST(least(39, floor(({c} / 20 - floor({c} / 20)) * 40)) AS BIGINT) AS i{c}' for c in 'xyz')}, CAST(count(*) AS BIGINT) AS n, {r('count(*) / 0.125::DOUBLE')} AS density FROM atoms GROUP BY ALL")
def sdf_grid(spark, d):
    atoms = points(spark, d)
    return order.density_grid(atoms, cube(atoms), 0.5).select("key", "ix", "iy", "iz", "n", near("density").alias("density"))


_SAMPLES = 500
_POINT = ", ".join(f"(0.5::DOUBLE + (k + 1) * {s!r}::DOUBLE) - floor(0.5::DOUBLE + (k + 1) * {s!r}::DOUBLE) AS f{c}" for c, s in zip("xyz", order.STEPS, strict=True))
_OFF = " + ".join(f"pow(20 * ((x.{c} / 20 - s.f{c}) - round(x.{c} / 20 - s.f{c})), 2)" for c in "xyz")


@query("number_variance", f"WITH {POINTS_SQL}, s AS (SELECT k, {_POINT} FROM range({_SAMPLES}) t(k)), d AS (SELECT s.k, {_OFF} AS d2 FROM s CROSS JOIN atoms x), e AS (SELECT CAST(b AS BIGINT) AS bin_idx, pow(2 + (b + 1) * 0.5::DOUBLE, 2) AS edge FROM range(16) t(b)), n AS (SELECT e.bin_idx, s.k, count(d.k) AS n FROM e CROSS JOIN s LEFT JOIN d ON d.k = s.k AND d.d2 <= e.edge GROUP BY e.bin_idx, s.k) SELECT bin_idx, {r('avg(n)')} AS mean_n, {r('avg(n * n) - avg(n) * avg(n)', 4)} AS sigma2 FROM n GROUP BY bin_idx")
def number_variance(spark, d):
    atoms = points(spark, d)
    return order.number_variance(atoms, cube(atoms), _SAMPLES, 0.5, 100).select("bin_idx", near("mean_n").alias("mean_n"), near("sigma2", 4).alias("sigma2"))


@query("voronoi_cells")
def voronoi_cells(spark, d):
    atoms = points(spark, d)
    return voronoi.voronoi_cells(atoms, cube(atoms)).select("atom_id", near("volume", 4).alias("volume"), near("sphericity", 4).alias("sphericity"), "faces", "signature")


@query("voronoi_signatures")
def voronoi_signatures(spark, d):
    atoms = points(spark, d)
    return voronoi.signature_ranking(voronoi.voronoi_cells(atoms, cube(atoms))).select("signature", "n", "rank")


@query("voronoi_hist")
def voronoi_hist(spark, d):
    atoms = points(spark, d)
    return voronoi.distributions(voronoi.voronoi_cells(atoms, cube(atoms))).select("hist", "bin_idx", near("x", 4).alias("x"), "key", near("y").alias("y"))


# --- scattering ---------------------------------------------------------------------------------------------------------------

_Q = "sqrt(h * h + k * k + l * l) * 2 * pi() / 20"


def _sq(q_max: int, reach: int) -> str:
    """CTEs up to v (q, key, y): structure factors of every reciprocal vector up to q_max, whose indices lie within the reach."""
    return f"WITH {POINTS_SQL}, t AS (SELECT g - {reach} AS v FROM range({2 * reach + 1}) x(g)), q AS (SELECT a.v AS h, b.v AS k, c.v AS l, sqrt(a.v * a.v + b.v * b.v + c.v * c.v) * (2 * pi() / 20) AS q FROM t a, t b, t c WHERE a.v <> 0 OR b.v <> 0 OR c.v <> 0), s AS (SELECT h, k, l, q, element, sum(cos(2 * pi() / 20 * (h * x + k * y + l * z))) AS c, sum(sin(2 * pi() / 20 * (h * x + k * y + l * z))) AS s, count(*) AS n FROM q CROSS JOIN atoms WHERE q <= {q_max} AND floor(q / 0.13::DOUBLE) < floor({q_max} / 0.13::DOUBLE) GROUP BY ALL), w AS (SELECT h, k, l, q, pow(sum(c), 2) + pow(sum(s), 2) AS p, sum(n) AS n FROM s GROUP BY h, k, l, q), v AS (SELECT q, 'Total' AS key, p / n AS y FROM w UNION ALL SELECT a.q, a.element || '-' || b.element, (a.c * b.c + a.s * b.s) / sqrt(a.n * b.n) FROM s a JOIN s b ON a.h = b.h AND a.k = b.k AND a.l = b.l AND a.element <= b.element)"


@query("sq_small", f"{_sq(2, 7)} SELECT CAST(floor(q / 0.13::DOUBLE) AS BIGINT) AS bin_idx, key, {r('avg(y)', 5)} AS y, CAST(count(*) AS BIGINT) AS n_q FROM v GROUP BY 1, 2")
def sq_small(spark, d):
    atoms = points(spark, d)
    return scattering.structure_factor(atoms, cube(atoms), 2.0, 0.13).select("bin_idx", "key", near("y", 5).alias("y"), "n_q")


def _partials(spark, d):
    atoms = points(spark, d)
    frames = cube(atoms)
    g = radial.rdf(Near(atoms, frames, R_MAX), atoms, frames, R_MAX, DR).where("hist = 'g_r' and key <> 'Total'")
    return atoms, frames, g.join(radial.pair_weights(atoms).select("frame", "key", "w"), ["frame", "key"])


# Written out, so that the SQL does not share the operator's table.
_FACTOR = {
    "Si": "0.145073 + 5.275329 * exp(-2.631338 * s2) + 3.191038 * exp(-33.730728 * s2) + 1.511514 * exp(-0.081119 * s2) + 1.356849 * exp(-86.288643 * s2)",
    "O": "0.027014 + 2.960427 * exp(-14.182259 * s2) + 2.508818 * exp(-5.936858 * s2) + 0.637853 * exp(-0.112726 * s2) + 0.722838 * exp(-34.958481 * s2)",
    "H": "0.000049 + 0.413048 * exp(-15.569946 * s2) + 0.294953 * exp(-32.398468 * s2) + 0.187491 * exp(-5.711404 * s2) + 0.080701 * exp(-61.889874 * s2)",
}


def _factor(e: str, q: str) -> str:
    typed = re.sub(r"\d+\.\d+", r"\g<0>::DOUBLE", _FACTOR[e])
    return "(" + typed.replace("s2", f"(({q} / (4 * pi())) * ({q} / (4 * pi())))") + ")"


def _factors(e: str, q: str) -> str:
    return f"CASE {e} " + " ".join(f"WHEN '{x}' THEN {_factor(x, q)}" for x in ("Si", "O", "H")) + " END"


@query("xrd_from_g", f"{_RDF}, th AS (SELECT CAST(k AS BIGINT) AS bin_idx, 10 + k * 0.5::DOUBLE AS two, 4 * pi() * sin(radians((10 + k * 0.5::DOUBLE) / 2)) / 1.5406::DOUBLE AS q FROM range(261) t(k)), own AS (SELECT bin_idx, two, q, sum(el.n / CAST(tot.n AS DOUBLE) * pow({_factors('el.element', 'q')}, 2)) AS own, any_value(tot.n) / 8000.0::DOUBLE AS rho FROM th, el, tot GROUP BY bin_idx, two, q), s AS (SELECT th.bin_idx, q, ei, ej, sum(x * (w * g - w) * sin(q * x) * {DR}::DOUBLE) AS s FROM g CROSS JOIN th GROUP BY ALL), c AS (SELECT bin_idx, sum({_factors('ei', 'q')} * {_factors('ej', 'q')} * s) AS c FROM s GROUP BY bin_idx) SELECT bin_idx, {r('two')} AS x, {r('own + 4 * pi() * rho / q * c', 4)} AS y FROM own JOIN c USING (bin_idx)".replace("FROM g CROSS JOIN th", "FROM g CROSS JOIN (SELECT bin_idx, q FROM th) th"))
def xrd_from_g(spark, d):
    atoms, frames, g = _partials(spark, d)
    return scattering.xrd_from_g(g, atoms, frames, width=0.5, dr=DR).select("bin_idx", near("x").alias("x"), near("y", 4).alias("y"))


_LEGS = "b AS (SELECT key, (floor(q / 0.13::DOUBLE) + 0.5) * 0.13::DOUBLE AS x, avg(y) AS y FROM v WHERE key <> 'Total' GROUP BY 1, 2), legs AS (SELECT key, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2, row_number() OVER w AS k FROM b WINDOW w AS (PARTITION BY key ORDER BY x))"
_ANGLES = "th AS (SELECT CAST(k AS BIGINT) AS bin_idx, 10 + k * 0.5::DOUBLE AS two, 4 * pi() * sin(radians((10 + k * 0.5::DOUBLE) / 2)) / 1.5406::DOUBLE AS q FROM range(261) t(k))"


@query("xrd_from_s", f"{_sq(3, 10)}, {_LEGS}, {_ANGLES}, el AS (SELECT element, count(*) / CAST((SELECT count(*) FROM atoms) AS DOUBLE) AS c FROM atoms GROUP BY element), own AS (SELECT bin_idx, two, sum(c * pow({_factors('element', 'q')}, 2)) AS own FROM th, el GROUP BY bin_idx, two), z AS (SELECT bin_idx, th.q AS q, split_part(key, '-', 1) AS ei, split_part(key, '-', 2) AS ej, CASE WHEN th.q < x OR x2 IS NULL THEN y ELSE y + (y2 - y) * (th.q - x) / (x2 - x) END AS s FROM legs JOIN th ON (th.q >= x AND th.q < x2) OR (k = 1 AND th.q < x) OR (x2 IS NULL AND th.q >= x)), c AS (SELECT bin_idx, sum((CASE WHEN ei = ej THEN 1 ELSE 2 END) * sqrt(a.c * b.c) * {_factors('ei', 'q')} * {_factors('ej', 'q')} * (s - (CASE WHEN ei = ej THEN 1 ELSE 0 END))) AS c FROM z JOIN el a ON a.element = ei JOIN el b ON b.element = ej GROUP BY bin_idx) SELECT bin_idx, {r('two')} AS x, {r('own + c', 4)} AS y FROM own JOIN c USING (bin_idx)")
def xrd_from_s(spark, d):
    atoms = points(spark, d)
    s = scattering.structure_factor(atoms, cube(atoms), 3.0, 0.13)
    return scattering.xrd_from_s(s, atoms, width=0.5).select("bin_idx", near("x").alias("x"), near("y", 4).alias("y"))


# --- trajectories -------------------------------------------------------------------------------------------------------------


def _image(a: str, b: str) -> str:
    return f"(({b} - {a}) - 20 * round(({b} - {a}) / 20))"


_STEPS = f"WITH {PATHS_SQL}, s AS (SELECT *, {', '.join(f'lag({c}) OVER w AS p{c}, lead({c}) OVER w AS n{c}' for c in 'xyz')} FROM atoms WINDOW w AS (PARTITION BY atom_id ORDER BY frame))"
_V = {c: f"CASE WHEN p{c} IS NULL AND n{c} IS NULL THEN 0 WHEN p{c} IS NULL THEN {_image(c, 'n' + c)} WHEN n{c} IS NULL THEN {_image('p' + c, c)} ELSE {_image('p' + c, 'n' + c)} / 2 END" for c in "xyz"}
_UNWRAPPED = f"{_STEPS}, u AS (SELECT atom_id, frame, {', '.join(f'sum(coalesce({_image(chr(112) + c, c)}, {c})) OVER (PARTITION BY atom_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS u{c}' for c in 'xyz')} FROM s)"
_MSD = f"{_UNWRAPPED}, top AS (SELECT (max(frame) + 1) // 2 AS most FROM u), msd AS (SELECT CAST(b.frame - a.frame AS BIGINT) AS lag, CAST(b.frame - a.frame AS DOUBLE) AS t, avg(pow(b.ux - a.ux, 2) + pow(b.uy - a.uy, 2) + pow(b.uz - a.uz, 2)) AS msd FROM u a JOIN u b ON a.atom_id = b.atom_id AND b.frame >= a.frame CROSS JOIN top WHERE b.frame - a.frame <= most GROUP BY 1, 2)"
_MASS = " ".join(f"WHEN '{s}' THEN {el.atomic_mass(s)}::DOUBLE" for s in ("Si", "O", "H"))
_VACF = f"{_STEPS}, v AS (SELECT atom_id, frame, CASE element {_MASS} END AS m, {', '.join(f'{_V[c]} AS v{c}' for c in 'xyz')} FROM s), com AS (SELECT frame, {', '.join(f'sum(m * v{c}) / sum(m) AS c{c}' for c in 'xyz')} FROM v GROUP BY frame), f AS (SELECT atom_id, v.frame, {', '.join(f'v{c} - c{c} AS v{c}' for c in 'xyz')} FROM v JOIN com ON com.frame = v.frame), raw AS (SELECT b.frame - a.frame AS lag, avg(a.vx * b.vx + a.vy * b.vy + a.vz * b.vz) AS vacf FROM f a JOIN f b ON a.atom_id = b.atom_id AND b.frame >= a.frame GROUP BY 1), vacf AS (SELECT CAST(lag AS BIGINT) AS lag, CAST(lag AS DOUBLE) AS t, vacf, vacf / (SELECT vacf FROM raw WHERE lag = 0) AS vacf_norm FROM raw)"


def _area_sql(y: str) -> str:
    return f"{_VACF}, strips AS (SELECT (lead(t) OVER (ORDER BY lag) - t) * (lead({y}) OVER (ORDER BY lag) + {y}) / 2 AS a, t FROM vacf), area AS (SELECT greatest(0, sum(a)) AS area, max(t) AS last FROM strips)"


@query("velocities", f"{_STEPS} SELECT frame, atom_id, {', '.join(r(_V[c]) + f' AS v{c}' for c in 'xyz')} FROM s")
def velocities(spark, d):
    atoms = paths(spark, d)
    return dynamics.velocities(atoms, cube(atoms)).select("frame", "atom_id", *[near(f"v{c}").alias(f"v{c}") for c in "xyz"])


@query("unwrap", f"{_UNWRAPPED} SELECT frame, atom_id, {', '.join(r(f'u{c}') + f' AS u{c}' for c in 'xyz')} FROM u")
def unwrap(spark, d):
    atoms = paths(spark, d)
    return dynamics.unwrap(atoms, cube(atoms)).select("frame", "atom_id", *[near(f"u{c}").alias(f"u{c}") for c in "xyz"])


@query("msd", f"{_MSD} SELECT lag, t, {r('msd', 4)} AS msd FROM msd")
def msd(spark, d):
    atoms = paths(spark, d)
    return dynamics.msd(atoms, cube(atoms)).select("lag", "t", near("msd", 4).alias("msd"))


@query("d_eff", f"{_MSD} SELECT lag, {r('msd / (6 * t)', 4)} AS d_eff FROM msd WHERE lag > 0")
def d_eff(spark, d):
    atoms = paths(spark, d)
    return dynamics.msd(atoms, cube(atoms), by_fft=False).where("lag > 0").select("lag", near("d_eff", 4).alias("d_eff"))


@query("diffusion_msd", f"{_MSD}, k AS (SELECT *, row_number() OVER (ORDER BY lag) - 1 AS k, count(*) OVER () AS n FROM msd) SELECT {r('greatest(0, regr_slope(msd, t) / 6)', 5)} AS diffusion FROM k WHERE k >= n // 2")
def diffusion_msd(spark, d):
    atoms = paths(spark, d)
    return dynamics.diffusion_from_msd(dynamics.msd(atoms, cube(atoms))).select(near("diffusion", 5).alias("diffusion"))


def _vacf(spark, d, by_fft=True):
    atoms = paths(spark, d)
    return dynamics.vacf(dynamics.velocities(atoms, cube(atoms)), by_fft=by_fft)


@query("vacf", f"{_VACF} SELECT lag, t, {r('vacf', 5)} AS vacf FROM vacf")
def vacf(spark, d):
    return _vacf(spark, d).select("lag", "t", near("vacf", 5).alias("vacf"))


@query("vacf_norm", f"{_VACF} SELECT lag, {r('vacf_norm')} AS vacf_norm FROM vacf")
def vacf_norm(spark, d):
    return _vacf(spark, d, by_fft=False).select("lag", near("vacf_norm").alias("vacf_norm"))


@query("diffusion_vacf", f"{_area_sql('vacf')} SELECT {r('area / 3', 5)} AS diffusion FROM area")
def diffusion_vacf(spark, d):
    return dynamics.diffusion_from_vacf(_vacf(spark, d)).select(near("diffusion", 5).alias("diffusion"))


@query("relaxation_time", f"{_area_sql('vacf_norm')} SELECT {r('area')} AS relaxation_time, {r('area / last')} AS deborah FROM area")
def relaxation_time(spark, d):
    return dynamics.relaxation_time(_vacf(spark, d)).select(near("relaxation_time").alias("relaxation_time"), near("deborah").alias("deborah"))


@query("dedup_frames", f"WITH {PATHS_SQL} SELECT DISTINCT frame, true AS kept FROM atoms")
def dedup_frames(spark, d):
    return dynamics.dedup_frames(paths(spark, d))


@query("validate_frames", f"WITH {PATHS_SQL}, e AS (SELECT frame, count(*) AS n, list_sort(list(DISTINCT element)) AS kinds, list_sort(list(atom_id)) AS ids FROM atoms GROUP BY frame), z AS (SELECT * FROM e WHERE frame = 0) SELECT e.frame, e.n = z.n AS same_count, e.kinds = z.kinds AS same_elements, e.ids = z.ids AS same_order FROM e CROSS JOIN z")
def validate_frames(spark, d):
    return dynamics.validate_frames(paths(spark, d))


@query("frame_window", f"WITH {PATHS_SQL} SELECT frame, CAST(count(*) AS BIGINT) AS n FROM atoms WHERE frame >= 3 GROUP BY frame")
def frame_window(spark, d):
    return dynamics.frame_window(paths(spark, d), 3).groupBy("frame").agg(F.count("*").alias("n"))


# --- histograms -----------------------------------------------------------------------------------------------------------------


@query("frame_mean", f"WITH {PATHS_SQL}, h AS (SELECT frame, element AS key, CAST(floor(x / 0.73::DOUBLE) AS BIGINT) AS bin_idx, count(*) AS y FROM atoms GROUP BY ALL) SELECT key, bin_idx, {r('sum(y) / CAST((SELECT count(DISTINCT frame) FROM atoms) AS DOUBLE)')} AS y FROM h GROUP BY key, bin_idx")
def frame_mean(spark, d):
    atoms = paths(spark, d)
    bins = F.floor(F.col("x") / 0.73).cast("long")
    each = atoms.groupBy("frame", F.lit("x").alias("hist"), bins.alias("bin_idx"), ((bins + 0.5) * 0.73).alias("x"), F.col("element").alias("key")).agg(F.count("*").cast("double").alias("y"))
    return hist.frame_mean(each, atoms).select("key", "bin_idx", near("y").alias("y"))


def _smooth_sql(kind: str) -> str:
    w = hist.kernel(2 * 8 + 1, DR, 0.1, kind)
    table = ", ".join(f"({k - 8}, {v!r}::DOUBLE)" for k, v in enumerate(w))
    return f"{_RDF}, w(o, w2) AS (VALUES {table}), y AS (SELECT bin_idx, key, w * g AS y FROM g) SELECT a.key, a.bin_idx, {r('sum(w2 * b.y)')} AS y FROM y a CROSS JOIN w JOIN y b ON b.key = a.key AND b.bin_idx = greatest(0, least({N_BINS - 1}, a.bin_idx + o)) GROUP BY a.key, a.bin_idx"


def _smooth(kind: str):
    def run(spark, d):
        _, _, g = _partials(spark, d)
        return hist.smooth(g.select("hist", "bin_idx", "x", "key", "y"), N_BINS, DR, 0.1, kind).select("key", "bin_idx", near("y_smooth").alias("y"))

    return run


for _kind in ("gaussian", "bump", "triweight", "epanechnikov", "cosine", "biweight"):
    query(f"smooth_{_kind}", _smooth_sql(_kind))(_smooth(_kind))


@query("hist_sum", f"{_RDF} SELECT key, bin_idx, {r('w * g * 3')} AS y FROM g")
def hist_sum(spark, d):
    _, _, g = _partials(spark, d)
    g = g.select("hist", "bin_idx", "x", "key", "y")
    return hist.added(g, hist.scaled(g, 2.0)).select("key", "bin_idx", near("y").alias("y"))


@query("hist_difference", f"{_RDF} SELECT key, bin_idx, {r('-0.5 * (w * g)')} AS difference FROM g")
def hist_difference(spark, d):
    _, _, g = _partials(spark, d)
    g = g.select("hist", "bin_idx", "x", "key", "y")
    return hist.difference(hist.scaled(g, 0.5), g).select("key", "bin_idx", near("difference").alias("difference"))


@query("hist_integral", f"{_RDF}, s AS (SELECT key, (lead(x) OVER p - x) * (lead(w * g) OVER p + w * g) / 2 AS a FROM g WINDOW p AS (PARTITION BY key ORDER BY bin_idx)) SELECT key, {r('coalesce(sum(a), 0)')} AS integral FROM s GROUP BY key")
def hist_integral(spark, d):
    _, _, g = _partials(spark, d)
    return hist.trapezoid(g, ["key"]).select("key", near("integral").alias("integral"))


from . import catalog_more  # noqa: E402, F401  (registers its queries)

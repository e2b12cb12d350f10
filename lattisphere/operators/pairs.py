"""Periodic neighbour search as an equi-join of grid bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import LATTICE, cartesian, dot, fractional, vectors, widths


CROWD = 16


def grid(atoms: DataFrame, frames: DataFrame, cutoff: float) -> DataFrame:
    """Atoms with their lattice, wrapped fractional coordinates f1 f2 f3, bins b1 b2 b3 of nb1 nb2 nb3, and the reach of the cutoff in bins."""
    cells = frames.select("frame", *LATTICE)
    w = widths()
    cells = cells.withColumns({f"nb{k + 1}": F.greatest(F.lit(1), F.floor(w[k] / cutoff)).cast("long") for k in range(3)})
    # crowded bins are cut finer, so that no bin is a key with most of a frame: CROWD atoms in a bin on average, four cuts a side at most
    n = atoms.groupBy("frame").agg(F.count("*").alias("n"))
    crowd = F.least(F.lit(4), F.greatest(F.lit(1), F.ceil(F.cbrt(F.col("n") / (F.col("nb1") * F.col("nb2") * F.col("nb3") * CROWD)))))
    cells = cells.join(n, "frame").withColumn("cuts", crowd).withColumns({f"nb{k}": F.col(f"nb{k}") * F.col("cuts") for k in (1, 2, 3)}).drop("n", "cuts")
    cells = cells.withColumns({f"reach{k + 1}": F.ceil(F.lit(float(cutoff)) * F.col(f"nb{k + 1}") / w[k]).cast("long") for k in range(3)})
    held = atoms.join(cells, "frame")
    f = fractional(tuple(F.col(k) for k in "xyz"))
    held = held.withColumns({f"f{k + 1}": f[k] - F.floor(f[k]) for k in range(3)})
    return held.withColumns({f"b{k}": F.least(F.col(f"nb{k}") - 1, F.floor(F.col(f"f{k}") * F.col(f"nb{k}"))).cast("long") for k in (1, 2, 3)})


def periodic_pairs(atoms: DataFrame, frames: DataFrame, cutoff: float, ignore_self: bool = True, inclusive: bool = False) -> DataFrame:
    """Every unordered pair of atoms (and image) closer than the cutoff, once.

    frame, i, j, e1, e2, s1, s2, s3 (the image of j in whole cells, for wrapped atoms), rx, ry, rz (from i to j), d. Either i < j
    in the same cell or the image is lexicographically positive. Only one side is repeated, over half of the bins around it, and
    meets the other on equal (frame, bin): no pair of distant atoms is ever formed.
    """
    held = grid(atoms, frames, cutoff)
    offsets = F.expr(
        "filter(flatten(flatten(transform(sequence(-reach1, reach1), u -> transform(sequence(-reach2, reach2), v -> transform(sequence(-reach3, reach3), w -> struct(u, v, w)))))),"
        " o -> o.u > 0 or (o.u = 0 and (o.v > 0 or (o.v = 0 and o.w >= 0))))"
    )
    near = held.select("frame", F.col("atom_id").alias("i"), F.col("element").alias("e1"), *[F.col(f"f{k}").alias(f"g{k}") for k in (1, 2, 3)], *[f"b{k}" for k in (1, 2, 3)], *[f"nb{k}" for k in (1, 2, 3)], *LATTICE, F.explode(offsets).alias("o"))
    for k, c in ((1, "u"), (2, "v"), (3, "w")):
        at = F.col(f"b{k}") + F.col(f"o.{c}")
        near = near.withColumns({f"s{k}": F.floor(at / F.col(f"nb{k}")).cast("int"), f"t{k}": F.pmod(at, F.col(f"nb{k}"))})
    near = near.withColumn("home", (F.col("o.u") == 0) & (F.col("o.v") == 0) & (F.col("o.w") == 0)).drop("o", *[f"{p}{k}" for p in ("b", "nb") for k in (1, 2, 3)])
    other = held.select("frame", F.col("atom_id").alias("j"), F.col("element").alias("e2"), *[F.col(f"f{k}").alias(f"h{k}") for k in (1, 2, 3)], *[F.col(f"b{k}").alias(f"t{k}") for k in (1, 2, 3)])
    met = near.join(other, ["frame", "t1", "t2", "t3"]).where(~F.col("home") | (F.col("i") < F.col("j")))
    if ignore_self:
        met = met.where("i <> j")
    r = cartesian(tuple(F.col(f"h{k}") + F.col(f"s{k}") - F.col(f"g{k}") for k in (1, 2, 3)), vectors())
    met = met.withColumns({"rx": r[0], "ry": r[1], "rz": r[2]})
    d2 = dot(*[tuple(F.col(c) for c in ("rx", "ry", "rz"))] * 2)
    limit = float(cutoff) ** 2
    met = met.where(d2 <= limit if inclusive else d2 < limit).withColumn("d", F.sqrt(d2))
    turn = F.expr("s1 < 0 or (s1 = 0 and (s2 < 0 or (s2 = 0 and (s3 < 0 or (s3 = 0 and i > j)))))")
    swap = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
    sign = F.when(turn, -1).otherwise(1)
    return met.select("frame", swap("i", "j").alias("i"), swap("j", "i").alias("j"), swap("e1", "e2").alias("e1"), swap("e2", "e1").alias("e2"), *[(sign * F.col(f"s{k}")).cast("int").alias(f"s{k}") for k in (1, 2, 3)], *[(sign * F.col(c)).alias(c) for c in ("rx", "ry", "rz")], "d")


def both_ways(pairs: DataFrame) -> DataFrame:
    """Directed edges src, dst, e1, e2, s1..s3, rx..rz, d: each pair and its reverse."""
    ahead = pairs.withColumnsRenamed({"i": "src", "j": "dst"})
    back = pairs.select("frame", F.col("j").alias("src"), F.col("i").alias("dst"), F.col("e2").alias("e1"), F.col("e1").alias("e2"), *[(-F.col(c)).alias(c) for c in ("s1", "s2", "s3", "rx", "ry", "rz")], "d")
    return ahead.unionByName(back)


def bonds(pairs: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Directed bonds: pairs whose squared distance is in the range of their elements, ends included; elements without a range do not bond."""
    kept = pairs.join(F.broadcast(cutoffs), ["e1", "e2"]).where((F.col("d") * F.col("d")).between(F.col("min_sq"), F.col("max_sq"))).drop("min_sq", "max_sq")  # at most 118 squared rows of cutoffs
    return both_ways(kept)


def bonds_within(pairs: DataFrame, min_sq: float, max_sq: float) -> DataFrame:
    """Directed bonds under one range of squared distances for all elements."""
    return both_ways(pairs.where((F.col("d") * F.col("d")).between(min_sq, max_sq)))


def graph_edges(atoms: DataFrame, frames: DataFrame, cutoff: float, self_loops: bool = False) -> DataFrame:
    """Directed edges of a periodic graph, distances up to the cutoff included, with image shifts: input of a learned potential."""
    pairs = periodic_pairs(atoms, frames, cutoff, ignore_self=not self_loops, inclusive=True)
    return both_ways(pairs).select("frame", "src", "dst", "s1", "s2", "s3", "rx", "ry", "rz", "d")

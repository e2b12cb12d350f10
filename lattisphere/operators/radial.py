"""Radial distributions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near import Block, Near
from .storage import once


def element_counts(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("frame", "element").agg(F.count("*").alias("n"))


def pair_key(a: str, b: str):
    """Elements in alphabetical order."""
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))


def pair_weights(atoms: DataFrame) -> DataFrame:
    """frame, key, ni, nj, n, w: concentration products of each unordered pair of elements, doubled for unlike ones."""
    counts = element_counts(atoms)
    total = counts.groupBy("frame").agg(F.sum("n").alias("total"))
    a, b = counts.withColumnsRenamed({"element": "ei", "n": "ni"}), counts.withColumnsRenamed({"element": "ej", "n": "nj"})
    met = a.join(b, "frame").where("ei <= ej").join(total, "frame")
    w = F.col("ni") * F.col("nj") / (F.col("total") * F.col("total")).cast("double") * F.when(F.col("ei") == F.col("ej"), 1.0).otherwise(2.0)
    return met.select("frame", F.concat_ws("-", "ei", "ej").alias("key"), "ei", "ej", "ni", "nj", F.col("total").alias("n"), w.alias("w"))


def pair_counts(pairs: DataFrame | Near, dr: float) -> DataFrame:
    """frame, key, bin_idx, n: counts of distances, like pairs twice. Of a Near, each block's pairs are counted as they are found."""
    if isinstance(pairs, Near):
        counts = pairs.run(lambda b: _block_counts(b, dr), "e1 string, e2 string, bin_idx long, n long", home=1024)
        return counts.groupBy("frame", pair_key("e1", "e2").alias("key"), "bin_idx").agg(F.sum("n").alias("n"))
    bins = F.floor(F.col("d") / dr).cast("long")
    return pairs.groupBy("frame", pair_key("e1", "e2").alias("key"), bins.alias("bin_idx")).agg(F.sum(F.when(F.col("e1") == F.col("e2"), 2).otherwise(1)).cast("long").alias("n"))


def _block_counts(b: Block, dr: float) -> dict:
    """Distances from a block's atoms by element and bin: both directions of like pairs, the one in the order of the elements of unlike ones."""
    limit, top = b.reach**2, int(b.reach / dr) + 2
    n = np.zeros((len(b.kinds), len(b.kinds), top + 1), np.int64)
    plain = not b.repeats and not b.inclusive and b.low == 0 and b.high == math.inf
    for k in range(len(b.kinds)):
        own = b.home[b.kind[b.home] == k]
        for m in range(k, len(b.kinds)):
            if plain:
                to = slice(b.starts[m], b.starts[m + 1])
                for part in b.steps(own, to.stop - to.start):
                    d = b.squares(part, to)
                    np.putmask(d, d >= limit, ((top + 1) * dr) ** 2)
                    np.sqrt(d, out=d)
                    d /= dr
                    n[k, m] += np.bincount(np.minimum(d, top).astype(np.intp).ravel(), minlength=top + 1)
                if m == k:
                    n[k, k, 0] -= len(own)  # each atom and itself
            else:
                for _, _, d, _ in b.bonds(own, b.kind == m):
                    n[k, m] += np.bincount(np.floor(d / dr).astype(np.intp), minlength=top + 1)
    n[..., top] = 0
    k, m, at = np.nonzero(n)
    return {"e1": b.names(k), "e2": b.names(m), "bin_idx": at, "n": n[k, m, at]}


def rdf(pairs: DataFrame | Near, atoms: DataFrame, frames: DataFrame, r_max: float = 20.0, dr: float = 0.02) -> DataFrame:
    """frame, hist, bin_idx, x, key, y for H_r, g_r_unweighted, J_r, g_r (weighted partials) and G_r, with Total.

    frames needs volume. g = H V / (4 pi dr Ni Nj r^2), J of i around j and j around i, totals weighted by concentration;
    the partials of bin 0 are 0."""
    n_bins = int(r_max / dr + 1e-9)
    weights = pair_weights(atoms).join(frames.select("frame", "volume"), "frame")
    spine = weights.withColumn("bin_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))))
    inner = Near(pairs.atoms, pairs.frames, min(pairs.reach, n_bins * dr), ignore_self=pairs.ignore_self) if isinstance(pairs, Near) else pairs.where(F.col("d") < n_bins * dr)
    counts = once(pair_counts(inner, dr), inner)
    h = spine.join(counts.withColumnRenamed("n", "h"), ["frame", "key", "bin_idx"], "left").fillna(0, ["h"])
    r = (F.col("bin_idx") + 0.5) * dr
    live = F.when(F.col("bin_idx") > 0, F.col("h")).otherwise(0)
    rho = F.col("n") / F.col("volume")
    g = live * F.col("volume") / (4 * math.pi * dr * F.col("ni") * F.col("nj") * r * r)
    base = h.select("frame", "bin_idx", r.alias("x"), "key", "ei", "ej", "h", "w", rho.alias("rho"), g.alias("g"), (live / (F.col("ni") * dr)).alias("j_ij"), (live / (F.col("nj") * dr)).alias("j_ji"))
    four = 4 * math.pi
    values = F.array(
        *[F.struct(F.lit(name).alias("hist"), key.alias("key"), y.cast("double").alias("y")) for name, key, y in (
            ("H_r", F.col("key"), F.col("h")),
            ("g_r_unweighted", F.col("key"), F.col("g")),
            ("g_r", F.col("key"), F.col("g") * F.col("w")),
            ("G_r", F.col("key"), four * F.col("rho") * F.col("x") * (F.col("w") * F.col("g") - F.col("w"))),
            ("J_r", F.concat_ws("-", "ei", "ej"), F.col("j_ij")),
            ("J_r", F.when(F.col("ei") != F.col("ej"), F.concat_ws("-", "ej", "ei")), F.col("j_ji")),
        )]
    )
    partial = base.select("frame", "bin_idx", "x", F.explode(values).alias("v")).select("frame", "v.hist", "bin_idx", "x", "v.key", "v.y").where("key is not null")
    total = base.groupBy("frame", "bin_idx", "x").agg(F.sum(F.col("w") * F.col("g")).alias("g"), F.sum("h").alias("h"), F.first("rho").alias("rho"))
    sums = F.array(
        *[F.struct(F.lit(name).alias("hist"), y.cast("double").alias("y")) for name, y in (
            ("H_r", F.col("h")),
            ("g_r_unweighted", F.col("g")),
            ("g_r", F.col("g")),
            ("G_r", four * F.col("rho") * F.col("x") * (F.col("g") - 1)),
            ("J_r", four * F.col("x") * F.col("x") * F.col("rho") * F.col("g")),
        )]
    )
    whole = total.select("frame", "bin_idx", "x", F.explode(sums).alias("v")).select("frame", "v.hist", "bin_idx", "x", F.lit("Total").alias("key"), "v.y")
    return partial.unionByName(whole)

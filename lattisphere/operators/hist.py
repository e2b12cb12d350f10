"""Histograms in long form (hist, bin_idx, x, key, y): means over frames, scaling, adding, smoothing, integration."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frame_mean(hist: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """The mean over frames; a bin that a frame lacks counts as zero. Bins meet by their place, axes by their values."""
    n = (frames if frames is not None else hist).select("frame").distinct().agg(F.count("*").alias("n"))
    total = hist.groupBy("hist", "bin_idx", "x", "key").agg(F.sum("y").alias("y"))
    return total.join(F.broadcast(n)).select("hist", "bin_idx", "x", "key", (F.col("y") / F.col("n")).alias("y"))  # n is one row


def scaled(hist: DataFrame, factor: float) -> DataFrame:
    return hist.withColumn("y", F.col("y") * F.lit(float(factor)))


def added(one: DataFrame, other: DataFrame) -> DataFrame:
    keys = ["hist", "bin_idx", "x", "key"]
    return one.unionByName(other).groupBy(*keys).agg(F.sum("y").alias("y"))


def kernel(size: int, dx: float, sigma: float, kind: str = "gaussian") -> list[float]:
    """Weights of an odd number of bins that sum to one."""
    u = [(k - (size - 1) / 2) * dx / sigma for k in range(size)]
    shapes = {
        "gaussian": lambda t: math.exp(-t * t / 2),
        "bump": lambda t: math.exp(-1 / (1 - t * t)) if abs(t) < 1 else 0.0,
        "triweight": lambda t: (1 - t * t) ** 3 if abs(t) <= 1 else 0.0,
        "epanechnikov": lambda t: 1 - t * t if abs(t) <= 1 else 0.0,
        "cosine": lambda t: math.cos(math.pi * t / 2) if abs(t) <= 1 else 0.0,
        "biweight": lambda t: (1 - t * t) ** 2 if abs(t) <= 1 else 0.0,
    }
    if kind not in shapes:
        raise ValueError(f"unknown kernel {kind!r}")
    w = [shapes[kind](t) for t in u]
    return [x / sum(w) for x in w] if sum(w) > 1e-9 else w


def smooth(hist: DataFrame, n_bins: int, dx: float, sigma: float = 0.1, kind: str = "gaussian") -> DataFrame:
    """hist with y_smooth: bins 0 to n_bins - 1 of each key convolved with the kernel, the end values repeated beyond the ends.

    The kernel reaches 4 sigma, one bin at least and half of the bins at most."""
    if dx <= 0 or sigma <= 0:
        raise ValueError("bin width and sigma must be positive")
    radius = max(1, min(int(4 * sigma / dx), n_bins // 2))
    weights = kernel(2 * radius + 1, dx, sigma, kind)
    spread = F.explode(F.array(*[F.struct(F.lit(k - radius).alias("o"), F.lit(w).alias("w")) for k, w in enumerate(weights)])).alias("s")
    asked = hist.select("hist", "key", "bin_idx", "x", "y", spread).withColumn("at", F.greatest(F.lit(0), F.least(F.lit(n_bins - 1), F.col("bin_idx") + F.col("s.o"))))
    source = hist.select("hist", "key", F.col("bin_idx").alias("at"), F.col("y").alias("v"))
    return asked.join(source, ["hist", "key", "at"]).groupBy("hist", "bin_idx", "x", "key", "y").agg(F.sum(F.col("s.w") * F.col("v")).alias("y_smooth"))


def smoothed(hist: DataFrame, sigma: float = 0.1, kind: str = "gaussian") -> DataFrame:
    """One histogram, with bins that it lacks as zeros, and y_smooth; unchanged where it has no axis of two bins or more.

    Sigma is 15 times as wide for distributions of angles, and a bin at least."""
    axis = hist.agg(F.min("bin_idx"), F.max("bin_idx"), F.min("x"), F.max("x"), F.min("hist")).first()  # one row
    low, high, x0, x1, name = axis
    if low is None or high == low or x1 <= x0:
        return hist
    dx = (x1 - x0) / (high - low)
    keys = hist.select("hist", "key").distinct().withColumn("bin_idx", F.explode(F.sequence(F.lit(low), F.lit(high))))
    dense = keys.join(hist.select("hist", "key", "bin_idx", "y"), ["hist", "key", "bin_idx"], "left").select("hist", "key", (F.col("bin_idx") - low).alias("bin_idx"), (x0 + (F.col("bin_idx") - low) * dx).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    wide = sigma * (15 if name in ("BAD", "PAD", "PAD_raw", "DAD", "DAD_raw") else 1)
    return smooth(dense, int(high - low + 1), dx, max(dx, wide), kind).withColumn("bin_idx", F.col("bin_idx") + low)


def trapezoid(series: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """The integral of y over x for each group."""
    w = Window.partitionBy(*by).orderBy(x) if by else Window.orderBy(x)
    strip = (F.lead(x).over(w) - F.col(x)) * (F.lead(y).over(w) + F.col(y)) / 2
    return series.withColumn("strip", strip).groupBy(*by).agg(F.coalesce(F.sum("strip"), F.lit(0.0)).alias("integral"))


def difference(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two runs side by side with their difference; a bin missing in a run counts as zero."""
    keys = ["hist", "bin_idx", "key"]
    met = one.withColumnRenamed("y", "y1").join(other.select(*keys, F.col("x").alias("x2"), F.col("y").alias("y2")), keys, "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return met.select(*keys, F.coalesce("x", "x2").alias("x"), zero("y1").alias("y1"), zero("y2").alias("y2"), (zero("y1") - zero("y2")).alias("difference"))

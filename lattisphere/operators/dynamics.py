"""Trajectory operators: velocities, unwrapping, mean-squared displacement, velocity autocorrelation, vibrational spectrum."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.elements import DEFAULT_MASS, THZ_TO_CM, THZ_TO_MEV, elements
from ..functions.geometry import LATTICE, min_image
from .storage import materialised

def _path():
    return Window.partitionBy("atom_id").orderBy("frame")



def _step(held: DataFrame, to, origin):
    return min_image(tuple(t - o for t, o in zip(to, origin, strict=True)))


def velocities(atoms: DataFrame, frames: DataFrame, dt: float = 1.0) -> DataFrame:
    """atoms with vx, vy, vz from differences of the nearest images: forward in an atom's first frame, backward in its last, central between."""
    held = atoms.drop("vx", "vy", "vz").join(frames.select("frame", *LATTICE), "frame")
    held = held.withColumns({f"{p}{c}": f(c).over(_path()) for p, f in (("p", F.lag), ("n", F.lead)) for c in "xyz"})
    here, before, after = (tuple(F.col(f"{p}{c}") for c in "xyz") for p in ("", "p", "n"))
    ahead, behind, both = _step(held, after, here), _step(held, here, before), _step(held, after, before)
    v = [F.when(F.col("px").isNull() & F.col("nx").isNull(), 0.0).when(F.col("px").isNull(), ahead[k] / dt).when(F.col("nx").isNull(), behind[k] / dt).otherwise(both[k] / (2 * dt)) for k in range(3)]
    return held.withColumns({f"v{c}": v[k] for k, c in enumerate("xyz")}).drop(*LATTICE, *[f"{p}{c}" for p in "pn" for c in "xyz"])


def unwrap(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """atoms with ux, uy, uz: running sums of nearest-image steps from an atom's first position."""
    held = atoms.join(frames.select("frame", *LATTICE), "frame")
    held = held.withColumns({f"p{c}": F.lag(c).over(_path()) for c in "xyz"})
    step = _step(held, tuple(F.col(c) for c in "xyz"), tuple(F.col(f"p{c}") for c in "xyz"))
    held = held.withColumns({f"u{c}": F.coalesce(step[k], F.col(c)) for k, c in enumerate("xyz")})
    run = _path().rowsBetween(Window.unboundedPreceding, 0)
    return held.withColumns({f"u{c}": F.sum(f"u{c}").over(run) for c in "xyz"}).drop(*LATTICE, "px", "py", "pz")


def _lagged(rows: DataFrame, columns: list[str], most: int) -> DataFrame:
    """Every pair of an atom's frames that are 0 to `most` apart: lag and both ends' columns. The join stays inside an atom."""
    ahead = rows.select("atom_id", F.col("frame").alias("later"), *[F.col(c).alias(f"{c}2") for c in columns])
    start = rows.select("atom_id", "frame", *columns, F.explode(F.sequence(F.lit(0), F.lit(most))).alias("lag")).withColumn("later", F.col("frame") + F.col("lag"))
    return start.join(ahead, ["atom_id", "later"])


def n_frames(atoms: DataFrame) -> int:
    return atoms.agg((F.max("frame") - F.min("frame") + 1).alias("n")).first()[0] or 0


def _correlated(rows: DataFrame, columns: list[str], most: int, displacement: bool) -> DataFrame:
    """atom_id, lag, total, n: per atom the sum over origins of products (or squared differences), by FFT where an atom has every frame."""

    def run(one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("frame")
        first, n = int(one["frame"].iloc[0]), int(one["frame"].iloc[-1] - one["frame"].iloc[0]) + 1
        v, here = np.zeros((n, len(columns))), np.zeros(n)
        at = (one["frame"] - first).to_numpy()
        v[at], here[at] = one[columns].to_numpy(), 1.0
        v[at] -= v[at].mean(axis=0) if displacement else 0.0  # differences stay, sums get small
        size = 1 << (2 * n - 1).bit_length()
        series = lambda a, b: np.fft.irfft(np.fft.rfft(a, size, axis=0).conj() * np.fft.rfft(b, size, axis=0), size, axis=0)[:n]
        counts = np.rint(series(here, here))
        product = series(v, v).sum(axis=1)
        if displacement:
            square = (v**2).sum(axis=1)
            product = series(square, here) + series(here, square) - 2 * product
        lags = np.arange(min(n, most + 1))
        return pd.DataFrame({"atom_id": one["atom_id"].iloc[0], "lag": lags, "total": product[lags], "n": counts[lags].astype("int64")})

    return rows.groupBy("atom_id").applyInPandas(run, "atom_id long, lag long, total double, n long").where("n > 0")


def msd(atoms: DataFrame, frames: DataFrame, dt: float = 1.0, max_lag: int | None = None, by_fft: bool = True) -> DataFrame:
    """lag, t, msd, d_eff (msd / 6 t, null at 0): means over atoms and origins of unwrapped squared displacements, lags to half the frames."""
    most = n_frames(atoms) // 2 if max_lag is None or max_lag < 0 else max_lag
    paths = unwrap(atoms, frames).select("atom_id", "frame", "ux", "uy", "uz")
    if by_fft:
        parts = _correlated(paths, ["ux", "uy", "uz"], most, True)
        value = parts.groupBy("lag").agg((F.sum("total") / F.sum("n")).alias("msd"))
    else:
        met = _lagged(paths, ["ux", "uy", "uz"], most)
        value = met.groupBy("lag").agg(F.avg(sum(((F.col(f"u{c}2") - F.col(f"u{c}")) ** 2 for c in "yz"), (F.col("ux2") - F.col("ux")) ** 2)).alias("msd"))
    t = F.col("lag") * F.lit(float(dt))
    return value.select(F.col("lag").cast("long").alias("lag"), t.alias("t"), "msd", F.when(F.col("lag") > 0, F.col("msd") / (6 * t)).alias("d_eff"))


def without_drift(moving: DataFrame, masses: DataFrame | None = None) -> DataFrame:
    """atoms (with velocities) less the velocity of each frame's centre of mass; unknown elements weigh 1."""
    table = masses if masses is not None else elements(moving.sparkSession).select("element", "mass")
    held = moving.join(F.broadcast(table), "element", "left").withColumn("mass", F.coalesce("mass", F.lit(DEFAULT_MASS)))
    centre = held.groupBy("frame").agg(*[(F.sum(F.col("mass") * F.col(f"v{c}")) / F.sum("mass")).alias(f"c{c}") for c in "xyz"])
    return held.join(centre, "frame").withColumns({f"v{c}": F.col(f"v{c}") - F.col(f"c{c}") for c in "xyz"}).drop("mass", "cx", "cy", "cz")


def vacf(moving: DataFrame, dt: float = 1.0, max_lag: int | None = None, by_fft: bool = True) -> DataFrame:
    """lag, t, vacf, vacf_norm: the mean of v(t0) v(t0 + lag) over atoms and origins, drift removed; lags to the last frame."""
    most = n_frames(moving) - 1 if max_lag is None or max_lag < 0 else max_lag
    rows = without_drift(moving).select("atom_id", "frame", "vx", "vy", "vz")
    if by_fft:
        value = _correlated(rows, ["vx", "vy", "vz"], most, False).groupBy("lag").agg((F.sum("total") / F.sum("n")).alias("vacf"))
    else:
        met = _lagged(rows, ["vx", "vy", "vz"], most)
        value = met.groupBy("lag").agg(F.avg(F.col("vx") * F.col("vx2") + F.col("vy") * F.col("vy2") + F.col("vz") * F.col("vz2")).alias("vacf"))
    start = value.where("lag = 0").select(F.col("vacf").alias("v0"))  # one row
    norm = F.when(F.abs("v0") > 1e-300, F.col("vacf") / F.col("v0")).otherwise(0.0)
    return value.join(F.broadcast(start)).select(F.col("lag").cast("long").alias("lag"), (F.col("lag") * F.lit(float(dt))).alias("t"), "vacf", norm.alias("vacf_norm"))


def diffusion_from_msd(found: DataFrame) -> DataFrame:
    """One row: a sixth of the slope of the second half of msd over t, 0 if negative or with fewer than two points."""
    n = found.agg(F.count("*").alias("n_all"))
    late = found.join(F.broadcast(n)).withColumn("k", F.row_number().over(Window.orderBy("lag")) - 1).where("k >= floor(n_all / 2)")
    slope = F.regr_slope("msd", "t")
    return late.agg(F.greatest(F.lit(0.0), F.coalesce(slope, F.lit(0.0)) / 6).alias("diffusion"))


def _area(found: DataFrame, y: str) -> DataFrame:
    w = Window.orderBy("lag")  # a row for each lag
    strip = (F.lead("t").over(w) - F.col("t")) * (F.lead(y).over(w) + F.col(y)) / 2
    return found.withColumn("strip", strip).agg(F.greatest(F.lit(0.0), F.coalesce(F.sum("strip"), F.lit(0.0))).alias("area"), F.max("t").alias("last"))


def diffusion_from_vacf(found: DataFrame) -> DataFrame:
    return _area(found, "vacf").select((F.col("area") / 3).alias("diffusion"))


def relaxation_time(found: DataFrame) -> DataFrame:
    """relaxation_time and the Deborah number (it over the last time)."""
    return _area(found, "vacf_norm").select(F.col("area").alias("relaxation_time"), F.when(F.col("last") > 0, F.col("area") / F.col("last")).otherwise(0.0).alias("deborah"))


def filon(theta: np.ndarray, f: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and sine transforms of f at the phase steps theta, by Filon's rule (the trapezoid rule near 0 and for an odd strip at the end)."""
    n = len(f)
    k = np.arange(n)
    last = n - 2 if n % 2 == 0 else n - 1
    c, s = np.cos(theta[:, None] * k), np.sin(theta[:, None] * k)
    flat = np.ones(n)
    flat[[0, -1]] = 0.5
    t = np.where(np.abs(theta) < 1e-6, 1.0, theta)
    sin, cos = np.sin(t), np.cos(t)
    alpha = 1 / t + sin * cos / t**2 - 2 * sin**2 / t**3
    beta = 2 * ((1 + cos**2) / t**2 - 2 * sin * cos / t**3)
    gamma = 4 * (sin / t**3 - cos / t**2)
    odd, even = np.arange(1, last, 2), np.arange(2, last, 2)
    even_c = c[:, even] @ f[even] + (f[0] + f[last] * c[:, last]) / 2
    even_s = s[:, even] @ f[even] + f[last] * s[:, last] / 2
    real = dt * (alpha * f[last] * s[:, last] + beta * even_c + gamma * (c[:, odd] @ f[odd]))
    imag = dt * (alpha * (f[0] - f[last] * c[:, last]) + beta * even_s + gamma * (s[:, odd] @ f[odd]))
    if n % 2 == 0 and n > 1:
        real += dt * (c[:, n - 2] * f[n - 2] + c[:, n - 1] * f[n - 1]) / 2
        imag += dt * (s[:, n - 2] * f[n - 2] + s[:, n - 1] * f[n - 1]) / 2
    small = np.abs(theta) < 1e-6
    return np.where(small, dt * (c @ (f * flat)), real), np.where(small, 0.0, imag)


def vdos(found: DataFrame, dt: float = 1.0, points: int = 2000, most_imaginary: float = 5.0, most_real: float = 10.0) -> DataFrame:
    """bin_idx, thz, cm, mev, y: the spectrum of the windowed vacf from -most_imaginary (sine part) to most_real THz (cosine part).

    The autocorrelation is one short series, so one task transforms it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values("lag")["vacf"].to_numpy()
        if len(v) < 2:
            raise ValueError("the autocorrelation is too short for a spectrum")
        t_max, nyquist = (len(v) - 1) * dt, 1000 / (2 * dt)
        sigma = t_max / 3 if t_max >= 1e-6 else 1.0
        windowed = v * np.exp(-0.5 * (np.arange(len(v)) * dt / sigma) ** 2)
        nu = np.arange(points) * nyquist / points
        real, imag = filon(2 * math.pi * nu * dt * 0.001, windowed, dt)
        damp = np.exp(-0.5 * (nu / (0.5 * nyquist)) ** 2)
        minus, plus = (nu > 0) & (nu <= most_imaginary), nu <= most_real
        thz = np.concatenate([-nu[minus][::-1], nu[plus]])
        y = np.concatenate([(imag * damp)[minus][::-1], (real * damp)[plus]])
        return pd.DataFrame({"bin_idx": np.arange(len(thz)), "thz": thz, "cm": thz * THZ_TO_CM, "mev": thz * THZ_TO_MEV, "y": y})

    return found.select("lag", "vacf").groupBy(F.lit(0).alias("one")).applyInPandas(run, "bin_idx long, thz double, cm double, mev double, y double")


def dedup_frames(atoms: DataFrame, eps: float = 1e-5) -> DataFrame:
    """frame, kept: a frame goes if it has as many atoms as the last kept frame and none of them moved by more than eps.

    A frame with an atom that moved by more than 2 eps since the frame before, or with another number of atoms, is kept in any
    case: the frame before lies within eps of the last kept one. The others are held against the start of their run; the first
    that has moved away starts a run of its own, until none has. What is repeated is a table with one row for each frame."""
    order = Window.orderBy("frame")  # a row for each frame
    sizes = atoms.groupBy("frame").agg(F.count("*").alias("n"))
    jump = sum(((F.col(c) - F.lag(c).over(_path())) ** 2 for c in "yz"), (F.col("x") - F.lag("x").over(_path())) ** 2)
    jumps = atoms.withColumn("jump", jump).groupBy("frame").agg(F.max("jump").alias("jump"))
    clear = F.coalesce((F.col("n") != F.lag("n").over(order)) | (F.col("jump") > 4 * eps * eps), F.lit(True))
    kept = materialised(sizes.join(jumps, "frame").select("frame", "n", clear.alias("kept")))
    while True:
        anchored = kept.withColumn("anchor", F.max(F.when(F.col("kept"), F.col("frame"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        here = atoms.select("frame", "atom_id", "x", "y", "z").join(anchored.where(~F.col("kept")).select("frame", "anchor"), "frame")
        there = atoms.select(F.col("frame").alias("anchor"), "atom_id", *[F.col(c).alias(f"{c}0") for c in "xyz"])
        d2 = sum(((F.col(c) - F.col(f"{c}0")) ** 2 for c in "yz"), (F.col("x") - F.col("x0")) ** 2)
        moved = here.join(there, ["anchor", "atom_id"], "left").groupBy("frame").agg(F.max(F.coalesce(d2, F.lit(float("inf")))).alias("far"))
        counted = anchored.join(kept.select(F.col("frame").alias("anchor"), F.col("n").alias("n0")), "anchor").join(moved, "frame", "left")
        away = counted.where(~F.col("kept") & ((F.col("n") != F.col("n0")) | (F.col("far") > eps * eps)))
        starts = materialised(away.groupBy("anchor").agg(F.min("frame").alias("frame")).select("frame"))
        if not starts.count():
            return kept.select("frame", "kept")
        kept = materialised(kept.join(starts.withColumn("new", F.lit(True)), "frame", "left").select("frame", "n", (F.col("kept") | F.coalesce("new", F.lit(False))).alias("kept")))


def validate_frames(atoms: DataFrame) -> DataFrame:
    """frame, same_count, same_elements, same_order against the first frame; all true for a valid trajectory."""
    each = atoms.groupBy("frame").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("element")).alias("kinds"), F.sum(F.xxhash64("atom_id", "element").cast("decimal(38,0)")).alias("mark"))
    first = each.orderBy("frame").limit(1).select(F.col("n").alias("n0"), F.col("kinds").alias("kinds0"), F.col("mark").alias("mark0"))
    return each.join(F.broadcast(first)).select("frame", (F.col("n") == F.col("n0")).alias("same_count"), (F.col("kinds") == F.col("kinds0")).alias("same_elements"), (F.col("mark") == F.col("mark0")).alias("same_order"))  # first is one row


def frame_window(atoms: DataFrame, start: int = 0, end: int = -1) -> DataFrame:
    """Frames start to end - 1; an end that is negative or too large means all."""
    held = atoms.where(F.col("frame") >= start)
    return held if end < 0 else held.where(F.col("frame") < end)


def frame_at(atoms: DataFrame, index: int) -> DataFrame:
    """One frame by its place, from the last one where the index is negative. Raises IndexError beyond the ends."""
    n = atoms.agg(F.max("frame")).first()[0]
    n = 0 if n is None else n + 1
    if not -n <= index < n:
        raise IndexError(f"frame {index} of {n}")
    return atoms.where(F.col("frame") == index % n)

"""Lattice geometry as Column expressions. A lattice is nine columns ax ... cz: the vectors a, b and c."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATTICE = [f"{v}{k}" for v in "abc" for k in "xyz"]


def cross(u, v):
    return (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])


def dot(u, v):
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def norm(u):
    return F.sqrt(dot(u, u))


def vectors(prefix: str = "") -> list[tuple[Column, ...]]:
    return [tuple(F.col(f"{prefix}{v}{k}") for k in "xyz") for v in "abc"]


def volume(lattice=None) -> Column:
    a, b, c = lattice or vectors()
    return dot(a, cross(b, c))


def fractional(r, lattice=None):
    """The coordinates of r along the lattice vectors."""
    a, b, c = lattice or vectors()
    v = volume((a, b, c))
    return tuple(dot(w, r) / v for w in (cross(b, c), cross(c, a), cross(a, b)))


def cartesian(f, lattice=None):
    a, b, c = lattice or vectors()
    return tuple(f[0] * a[k] + f[1] * b[k] + f[2] * c[k] for k in range(3))


def min_image(r, lattice=None):
    """r less whole lattice vectors, by rounding its fractional coordinates (halves away from zero)."""
    return cartesian(tuple(x - F.round(x) for x in fractional(r, lattice)), lattice)


def wrapped(r, lattice=None):
    """r inside the cell."""
    return cartesian(tuple(x - F.floor(x) for x in fractional(r, lattice)), lattice)


def widths(lattice=None):
    """Distances between opposite faces of the cell."""
    a, b, c = lattice or vectors()
    v = F.abs(volume((a, b, c)))
    return tuple(v / norm(w) for w in (cross(b, c), cross(c, a), cross(a, b)))


def angle_between(u, v) -> Column:
    """The angle in radians; 0 if either vector is shorter than 1e-6."""
    n2 = dot(u, u) * dot(v, v)
    short = (dot(u, u) < 1e-12) | (dot(v, v) < 1e-12)
    return F.when(short, 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / F.sqrt(n2)))))


def lattice_from_parameters(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> list[float]:
    """Nine numbers ax ... cz, a along x and b in the xy plane. Raises ValueError for impossible cells."""
    if min(a, b, c) <= 0 or not all(0 < x < 180 for x in (alpha, beta, gamma)):
        raise ValueError("cell lengths must be positive and angles between 0 and 180 degrees")
    ca, cb, cg = (math.cos(math.radians(x)) for x in (alpha, beta, gamma))
    sg = math.sin(math.radians(gamma))
    left = 1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg
    if left <= 0:
        raise ValueError("the angles do not close a cell")
    return [a, 0.0, 0.0, b * cg, b * sg, 0.0, c * cb, c * (ca - cb * cg) / sg, c * math.sqrt(left) / sg]


def parameters(lattice=None) -> list[Column]:
    """a, b, c, alpha, beta, gamma (degrees) of the lattice columns."""
    a, b, c = lattice or vectors()
    return [norm(a), norm(b), norm(c)] + [F.degrees(angle_between(u, v)) for u, v in ((b, c), (a, c), (a, b))]


def frame_table(frames: DataFrame) -> DataFrame:
    """frames (frame and the lattice) with volume and lattice_params; raises at run time for a cell without volume."""
    checked = frames.withColumn("volume", F.abs(volume()))
    good = F.when(F.col("volume") > 1e-9, F.col("volume")).otherwise(F.raise_error(F.lit("a cell has no volume")).cast("double"))
    return checked.withColumns({"volume": good, "lattice_params": F.array(*parameters())})


def box(spark, length: float) -> DataFrame:
    """One cubic cell for every frame: to be joined without keys."""
    values = [float(length), 0.0, 0.0, 0.0, float(length), 0.0, 0.0, 0.0, float(length)]
    return spark.createDataFrame([tuple(values)], ", ".join(f"{c} double" for c in LATTICE))


def cell_of_each_frame(atoms: DataFrame, lattice: list[float]) -> DataFrame:
    """A frames table that gives every frame of atoms the same lattice."""
    return atoms.select("frame").distinct().withColumns({c: F.lit(float(v)) for c, v in zip(LATTICE, lattice, strict=True)})

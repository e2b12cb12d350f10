"""Periodic Voronoi cells from half-spaces."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import both_ways, periodic_pairs
from .storage import materialised

LEAST_AREA, LEAST_EDGE = 0.01, 1e-3
_TRIPLES: dict[int, np.ndarray] = {}


def _triples(n: int) -> np.ndarray:
    if n not in _TRIPLES:
        _TRIPLES[n] = np.array(list(itertools.combinations(range(n), 3)))
    return _TRIPLES[n]


def cell(neighbours: np.ndarray, reach: float):
    """(volume, area, faces, signature) of the cell of a point at the origin among neighbours that are complete to `reach`; None if they do not suffice.

    The corners are the points where three bisecting planes meet inside all others."""
    d = np.linalg.norm(neighbours, axis=1)
    order = np.argsort(d, kind="stable")
    order = order[d[order] > 1e-9]
    v, d = neighbours[order], d[order]
    size = 16
    while True:
        n = min(size, len(v))
        if n < 4:
            return None
        normals, h = v[:n], d[:n] ** 2 / 2
        t = _triples(n) if n <= 64 else _triples(64)
        m = normals[t]
        det = np.linalg.det(m)
        good = np.abs(det) > 1e-9 * np.prod(d[t], axis=1)
        corners = np.linalg.solve(m[good], h[t[good]][:, :, None])[:, :, 0]
        inside = (corners @ normals.T <= h + 1e-7 * (1 + h)).all(axis=1)
        corners = corners[inside]
        far = np.linalg.norm(corners, axis=1).max() if len(corners) else math.inf
        following = d[n] if n < len(v) else reach
        if len(corners) >= 4 and 2 * far <= following + 1e-9 and _closed(corners):
            break
        if n == len(v) or n >= 64:
            return None if n == len(v) else _clipped(v, d, reach)
        size *= 2
    return _measure(corners, normals, h)


def _closed(corners: np.ndarray) -> bool:
    """Whether the corners surround the origin in every axis direction."""
    return bool((corners.max(axis=0) > 0).all() and (corners.min(axis=0) < 0).all())


def _clipped(v: np.ndarray, d: np.ndarray, reach: float):
    """As cell(), cutting a large cube plane by plane: for atoms with very many close neighbours."""
    side = reach
    planes = [np.array(p, float) for p in ((side, 0, 0), (-side, 0, 0), (0, side, 0), (0, -side, 0), (0, 0, side), (0, 0, -side))]
    normals, h = np.array(planes), np.full(6, side * side)
    corners = np.array(list(itertools.product((-side, side), repeat=3)))
    for k in range(len(v)):
        if d[k] > 2 * np.linalg.norm(corners, axis=1).max():
            break
        height = d[k] ** 2 / 2
        out = corners @ v[k] > height + 1e-9
        if not out.any():
            continue
        on = np.abs(corners @ normals.T - h) <= 1e-7 * (1 + np.abs(h))
        a, b = np.flatnonzero(out), np.flatnonzero(~out)
        shared = on[a].astype(int) @ on[b].T.astype(int) >= 2
        i, j = np.nonzero(shared)
        p, q = corners[a[i]], corners[b[j]]
        at = (height - q @ v[k]) / ((p - q) @ v[k])
        corners = np.concatenate([corners[b], q + at[:, None] * (p - q)])
        normals, h = np.vstack([normals, v[k]]), np.append(h, height)
        used = (np.abs(corners @ normals.T - h) <= 1e-7 * (1 + np.abs(h))).any(axis=0)
        normals, h = normals[used], h[used]
    if 2 * np.linalg.norm(corners, axis=1).max() > reach + 1e-9:
        return None
    return _measure(corners, normals, h)


def _measure(corners: np.ndarray, normals: np.ndarray, h: np.ndarray):
    volume = area = 0.0
    orders, faces = [], 0
    for n, c in zip(normals, h, strict=True):
        points = corners[np.abs(corners @ n - c) <= 1e-6 * (1 + c)]
        if len(points) < 3:
            continue
        size = np.linalg.norm(n)
        u = np.cross(n, [1.0, 0, 0] if abs(n[0]) < 0.9 * size else [0, 1.0, 0])
        u /= np.linalg.norm(u)
        w = np.cross(n / size, u)
        flat = np.column_stack([points @ u, points @ w])
        flat = flat[np.argsort(np.arctan2(*(flat - flat.mean(axis=0)).T[::-1]))]
        edges = np.linalg.norm(np.roll(flat, -1, axis=0) - flat, axis=1)
        own = abs(float(flat[:, 0] @ np.roll(flat[:, 1], -1) - flat[:, 1] @ np.roll(flat[:, 0], -1))) / 2
        area += own
        volume += own * (c / size) / 3
        if own >= LEAST_AREA:
            faces += 1
            orders.append(int((edges >= LEAST_EDGE).sum()))
    counts = [sum(o == k for o in orders) for k in (3, 4, 5, 6)]
    return volume, area, faces, "({}, {}, {}, {})".format(*counts)


def voronoi_cells(atoms: DataFrame, frames: DataFrame, reach: float | None = None, rounds: int = 8) -> DataFrame:
    """frame, atom_id, element, volume, sphericity, faces (of LEAST_AREA or more), signature (faces of 3, 4, 5 and 6 edges). frames needs volume.

    Neighbours come from the grid join; atoms whose cell is not certain within the reach are tried again with a larger one, the
    neighbours of those atoms only."""
    if reach is None:
        size = atoms.groupBy("frame").agg(F.count("*").alias("n")).join(frames.select("frame", "volume"), "frame").agg(F.max(F.cbrt(F.col("volume") / F.col("n")))).first()[0]
        reach = 2.2 * (size or 1.0)
    todo, done = atoms.select("frame", "atom_id", "element"), None
    for _ in range(rounds):
        near = both_ways(periodic_pairs(atoms, frames, reach, ignore_self=False))
        lists = near.join(todo.select("frame", F.col("atom_id").alias("src")), ["frame", "src"], "left_semi").groupBy("frame", F.col("src").alias("atom_id")).agg(F.collect_list(F.array("rx", "ry", "rz")).alias("vs"))

        def run(batches, reach=reach):
            for rows in batches:
                found = [cell(np.stack([np.asarray(v, float) for v in vs]), reach) if vs is not None and len(vs) else None for vs in rows["vs"]]
                good = [f is not None for f in found]
                value = lambda k, found=found: [f[k] if f else None for f in found]
                ball = [math.pi ** (1 / 3) * (6 * f[0]) ** (2 / 3) / f[1] if f and f[1] > 1e-9 else None for f in found]
                yield pd.DataFrame({"frame": rows["frame"], "atom_id": rows["atom_id"], "element": rows["element"], "ok": good, "volume": value(0), "sphericity": ball, "faces": pd.array(value(2), "Int64"), "signature": value(3)})

        fields = "frame long, atom_id long, element string, ok boolean, volume double, sphericity double, faces long, signature string"
        each = materialised(todo.join(lists, ["frame", "atom_id"], "left").mapInPandas(run, fields))
        own = each.where("ok").drop("ok")
        done = own if done is None else done.unionByName(own)
        todo = each.where("not ok").select("frame", "atom_id", "element")
        if todo.isEmpty():
            return done
        reach *= 1.6
    raise ValueError("some cells are not closed within the largest reach")


def signature_ranking(cells: DataFrame) -> DataFrame:
    """frame, signature, n, rank: by count, then name."""
    from pyspark.sql import Window

    counts = cells.groupBy("frame", "signature").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("n"), "signature")))


def signature_places(cells: DataFrame) -> DataFrame:
    """bin_idx, signature, n: the signatures of all frames by count, then name, so that frames share one axis."""
    from pyspark.sql import Window

    counts = cells.groupBy("signature").agg(F.count("*").alias("n"))  # as many rows as kinds of cell
    return counts.select((F.row_number().over(Window.orderBy(F.desc("n"), "signature")) - 1).cast("long").alias("bin_idx"), "signature", "n")


def _shares(cells: DataFrame, name: str, bins, x) -> DataFrame:
    """frame, hist, bin_idx, x, key (element, Total), y: the share of the frame's cells in each bin."""
    counts = cells.select("frame", bins.cast("long").alias("bin_idx"), F.explode(F.array("element", F.lit("Total"))).alias("key")).where("bin_idx is not null").groupBy("frame", "bin_idx", "key").agg(F.count("*").alias("n"))
    total = cells.groupBy("frame").agg(F.count("*").alias("all"))
    return counts.join(total, "frame").select("frame", F.lit(name).alias("hist"), "bin_idx", x.cast("double").alias("x"), "key", (F.col("n") / F.col("all")).alias("y"))


def distributions(cells: DataFrame, n_bins: int = 100) -> DataFrame:
    """Volumes (bins up to 1.2 times the largest of all frames), sphericities (0 to 1), faces, and signatures by their place in signature_places."""
    width = 1.2 * (cells.agg(F.max("volume")).first()[0] or 100.0 / 1.2) / n_bins
    k = F.col("bin_idx")
    volume = _shares(cells, "Voronoi Volume", F.floor(F.col("volume") / width), (k + 0.5) * width)
    ball = F.when(F.col("sphericity") < 1, F.floor(F.col("sphericity") * n_bins))
    sphericity = _shares(cells, "Voronoi Sphericity", ball, (k + 0.5) / n_bins)
    faces = _shares(cells, "Voronoi Coordination Number", F.col("faces"), k)
    placed = cells.join(signature_places(cells).drop("n"), "signature")
    return volume.unionByName(sphericity).unionByName(faces).unionByName(_shares(placed, "Voronoi Signatures", F.col("bin_idx"), k))

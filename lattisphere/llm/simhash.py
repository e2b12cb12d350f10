"""SimHash near-duplicates: fingerprints of word shingles, exact pairs within a Hamming radius from vantage-point trees.

Fingerprints: words are runs of bytes without ASCII white space after A-Z became a-z; every run of `width` words (joined by
one space; fewer words: the whole sequence) is hashed by XXH64 with seed 42, and a bit is 1 where over half the hashes have
it. No words (null, empty or blank text): 0, linked like any other.

Links: a vantage-point tree over a bounded sample halves the space by distance again and again; its leaves are the shards.
A distinct fingerprint belongs to one shard and is asked in every shard that its ball of radius r reaches by the triangle
inequality, so no pair is lost. In its shard each block of questions runs down a vantage-point tree of the members.
The pairs found become a spanning forest there, so a dense group never gives all its pairs.

Copies share one fingerprint and are grouped before any search. Rows that repeat a doc_id are separate documents with the
same id. A null doc_id takes part; the component is named after the least id that is not null (null if there is none).
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import bytes_array, slices, staged, tidy

#: Distinct fingerprints that a shard should hold; the tree has at least LEAST_DEPTH levels. SAMPLE rows for each leaf reach the driver.
#: Questions and members that one task takes; the pieces of a shard meet pair by pair.
SHARD_ROWS, LEAST_DEPTH, SAMPLE, ASKED_ROWS, MEMBER_ROWS = 1 << 17, 4, 64, 1 << 17, 1 << 20
_LANES = np.array([[(v >> j) & 1 for j in range(8)] for v in range(256)], np.uint8).view(np.uint64).ravel()


def shingle_hashes(text: bytes, width: int) -> list[int]:
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
    return [digest(line[a:b], 42) for a, b in zip([0, *(e + 1 for e in ends[:-width])], ends[width - 1 :], strict=True)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each document the bits set in over half of its hashes; counts: hashes of each document."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = np.cumsum(counts[full]) - counts[full]
    cuts = np.unique(np.concatenate([starts, *(np.arange(s, s + n, 255) for s, n in zip(starts[counts[full] > 255], counts[full][counts[full] > 255], strict=True))]))  # lanes of a byte hold 255
    lanes = np.add.reduceat(_LANES[hashes.view(np.uint8).reshape(-1, 8)], cuts, axis=0).view(np.uint8)
    sums = np.add.reduceat(lanes, np.searchsorted(cuts, starts), axis=0, dtype=np.int64)
    out[full] = np.packbits(sums * 2 > counts[full][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (long, the 64 bits) of every row."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                each = [shingle_hashes(x, width) for x in bytes_array(piece.column("text")).to_pylist()]
                counts = np.fromiter(map(len, each), np.int64, len(each))
                hashes = np.fromiter(itertools.chain.from_iterable(each), np.uint64, int(counts.sum()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(majority_bits(hashes, counts).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, fp long")


def _distance(a, b):
    return np.bitwise_count(a ^ b)


def shard_tree(sample: np.ndarray, depth: int) -> list:
    """Vantage points and radii of a full binary tree, in heap order."""
    tree, held = [None] * (2**depth - 1), {0: sample}
    for k in range(len(tree)):
        own = held.pop(k)
        point = own[0] if len(own) else np.uint64(0)
        d = _distance(own, point)
        radius = int(np.median(d[1:])) if len(own) > 1 else 32
        tree[k] = (int(point), radius)
        held[2 * k + 1], held[2 * k + 2] = own[1:][d[1:] <= radius], own[1:][d[1:] > radius]
    return tree


def tree_shards(fps: np.ndarray, tree: list, depth: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of fps and the leaves that their balls of that radius reach."""
    rows, nodes = np.arange(len(fps)), np.zeros(len(fps), np.int64)
    points, radii = np.array([p for p, _ in tree], np.uint64), np.array([r for _, r in tree], np.int64)
    for _ in range(depth):
        d = _distance(fps[rows], points[nodes]).astype(np.int64)
        near, far = d - slack <= radii[nodes], d + slack > radii[nodes]
        rows, nodes = np.concatenate([rows[near], rows[far]]), np.concatenate([2 * nodes[near] + 1, 2 * nodes[far] + 2])
    return rows, nodes - (2**depth - 1)


class Forest:
    """Minimum labels of nodes 0 to n - 1 under links added in arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def pairs_within(members: np.ndarray, asked: np.ndarray, radius: int, found, cells: int = 1 << 20, leaf: int = 512) -> None:
    """Calls found(i of members, j of asked) with arrays of all pairs within the radius, by a vantage-point tree of the members."""
    stack = [(np.arange(len(members)), np.arange(len(asked)))]
    while stack:
        m, q = stack.pop()
        if not len(m) or not len(q):
            continue
        split = None
        if len(m) > leaf:
            point = members[m[len(m) // 2]]
            d = _distance(members[m], point)
            r = int(np.median(d))
            inside = d <= r
            if 0 < inside.sum() < len(m):
                split = inside
        if split is None:
            step = max(1, cells // len(m))
            for at in range(0, len(q), step):
                j, i = np.nonzero(_distance(asked[q[at : at + step], None], members[m][None, :]) <= radius)
                found(m[i], q[at : at + step][j])
            continue
        dq = _distance(asked[q], point).astype(np.int64)
        stack += [(m[split], q[dq - radius <= r]), (m[~split], q[dq + radius > r])]


def near_links(fps: DataFrame, radius: int = 3, shard_rows: int = SHARD_ROWS, asked_rows: int = ASKED_ROWS) -> DataFrame:
    """fps: distinct fingerprints (fp long). Returns links (a, b) that join just those fingerprints that are within the radius or chains of such.

    The tree has a leaf for each shard_rows fingerprints, however many there are. A shard with over asked_rows questions is
    searched by several tasks, each with all members and a share of the questions, and members beyond MEMBER_ROWS are shared out too."""
    n = fps.count()
    depth = max(LEAST_DEPTH, math.ceil(math.log2(max(1, n) / shard_rows)))
    share = min(1.0, 2**depth * SAMPLE / max(1, n))  # SAMPLE rows for each leaf, so SAMPLE / shard_rows of the table
    drawn = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)).orderBy(F.xxhash64("fp")).limit(2**depth * SAMPLE)
    tree = shard_tree(np.array([r[0] for r in drawn.collect()], np.int64).view(np.uint64), depth)

    def deal(batches):
        for batch in batches:
            x = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(x), 20_000):
                part = x[at : at + 20_000]
                rows, shards = tree_shards(part, tree, depth, radius)
                home = np.zeros(len(part), np.int64)
                own_rows, own = tree_shards(part, tree, depth, 0)
                home[own_rows] = own
                yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(part[rows].view(np.int64)), pa.array(home[rows] == shards)], ["shard", "fp", "home"])

    def search(part: pa.Table) -> pa.Table:
        x = np.unique(part.column("fp").to_numpy().view(np.uint64))
        as_member = part.column("home").to_numpy(zero_copy_only=False)
        members, asked = (np.sort(part.column("fp").to_numpy()[who].view(np.uint64)) for who in (as_member, ~as_member))
        forest, of_member, of_asked = Forest(len(x)), np.searchsorted(x, members), np.searchsorted(x, asked)

        def found(i, j):
            a, b = of_member[i], of_asked[j]
            if (a != b).any():
                forest.link(a[a != b], b[a != b])

        pairs_within(members, asked, radius, found)
        linked = np.flatnonzero(forest.label != np.arange(len(x)))
        return pa.table({"a": x[linked].view(np.int64), "b": x[forest.label[linked]].view(np.int64)})

    dealt, _ = staged(fps.mapInArrow(tidy(deal), "shard long, fp long, home boolean"), "dealt")
    sizes = dealt.groupBy("shard").agg(F.ceil(F.count("*") / asked_rows).alias("n_asked"), F.ceil(F.count_if("home") / MEMBER_ROWS).alias("n_members"))  # a row for each shard
    held = dealt.join(sizes, "shard").where("n_members > 0")
    coin = F.xxhash64("fp")
    members = held.where("home").withColumns({"m": F.pmod(coin, "n_members"), "q": F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_asked") - 1))})
    asked = held.withColumns({"home": F.lit(False), "q": F.pmod(coin, "n_asked"), "m": F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_members") - 1))})
    columns = ["shard", "q", "m", "fp", "home"]
    return members.select(*columns).unionByName(asked.select(*columns)).groupBy("shard", "q", "m").applyInArrow(tidy(search), "a long, b long")


def near_groups(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp (long) and component_id of every row: the least doc_id among all that chains of near fingerprints reach."""
    held, _ = staged(fingerprints(docs, width), "fingerprints")
    fps, _ = staged(held.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(near_links(fps.select("fp"), radius))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    groups, _ = staged(named.join(least, "root").select("fp", "component_id"), "groups")
    return held.join(groups, "fp").select("doc_id", "fp", "component_id")

"""Near-duplicates of the pipeline: documents whose distinct five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates are SimHash fingerprints of the five-word shingles within `radius` bits, found by the vantage-point shards of
`simhash`. Fingerprints of pairs of that similarity differ in anything from 0 to over 20 bits, so no radius that the search can
bear holds them all; BANDS x ROWS MinHash values add the rest: a pair of similarity 0.8 shares none of the bands with a
probability of (1 - 0.8^6)^64, under 1 in 10^8, at any length of the texts. Documents that share a fingerprint's ball or a band
form candidate groups by star links, never by pairs. Each group's texts then meet once, and only pairs whose exact similarity
reaches the threshold are linked.

Words are runs without ASCII white space after A-Z became a-z; a text of fewer words is one shingle, its whole sequence. Shingles
are compared as 64-bit hashes. Texts with the same set of shingles (so all without words) are copies and searched once. A
null doc_id takes part and counts as larger than all others; rows of one doc_id are documents of their own. A candidate group
is the largest unit: its distinct texts meet in one task.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .components import components
from .decontamination import _combined
from .shared import LAST_ID, buffer_of, discard, lowered, mix, parts_for, slices, span_hashes, staged, tidy, words_of
from .simhash import majority_bits

WIDTH, THRESHOLD, RADIUS, BANDS, ROWS, BUCKET_BYTES = 5, 0.8, 3, 64, 6, 8 << 20
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, in order within each, and the n + 1 offsets of the texts."""
    data, offsets = buffer_of(texts)
    data = lowered(data)
    starts, ends, edges = words_of(data, offsets)
    hashes, counts = span_hashes(data, starts, ends), np.diff(edges)
    grams, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for size in range(1, width + 1):
        own = np.flatnonzero(counts >= width if size == width else counts == size)
        if not len(own):
            continue
        n = counts[own] - size + 1
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        grams.append(_combined(hashes, size)[np.repeat(edges[:-1][own], n) + inside])
        rows.append(np.repeat(own, n))
    grams, rows = np.concatenate(grams), np.concatenate(rows)
    order = np.lexsort((grams, rows))
    grams, rows = grams[order], rows[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
    grams, rows = grams[new], rows[new]
    return grams, np.searchsorted(rows, np.arange(len(counts) + 1))


def bands_of(grams: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and a hash of each of their bands."""
    full = np.flatnonzero(np.diff(edges))
    out = np.zeros((len(full), BANDS), np.uint64)
    if len(full):
        cuts = edges[full]
        for k, seed in enumerate(_SEEDS):
            band = k // ROWS
            out[:, band] = mix(out[:, band] * np.uint64(0x9DDFEA08EB382D69) + np.minimum.reduceat(grams * seed, cuts) + np.uint64(band + 1))
    return full, out


def _sketches(docs: DataFrame, width: int, names: dict[str, str]) -> DataFrame:
    """The columns of docs, and under the given names a row's place (row), the digest of its set of shingles (key), its fingerprint and its bands. Stage it before use: places follow tasks."""

    def run(batches):
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in slices(batch):
                grams, edges = shingle_sets(piece.column("text"), width)
                whole, m = memoryview(grams.tobytes()), piece.num_rows
                keys = np.array([xxhash.xxh3_64_intdigest(whole[8 * a : 8 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], np.uint64)
                full, bands = bands_of(grams, edges)
                held = [None] * m
                for k, own in zip(full.tolist(), bands, strict=True):
                    held[k] = own.tobytes()
                bits = majority_bits(grams, np.diff(edges))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(np.arange(n, n + m)), pa.array(keys.view(np.int64)), pa.array(bits.view(np.int64)), pa.array(held, pa.binary())], [*piece.schema.names, *names.values()])
                n += m

    schema = T.StructType([*docs.schema, *(T.StructField(names[c], kind()) for c, kind in (("row", T.LongType), ("key", T.LongType), ("fp", T.LongType), ("bands", T.BinaryType)))])
    return docs.mapInArrow(tidy(run), schema)


def _candidates(held: DataFrame, n: int) -> DataFrame:
    """Links (a, b) from each text to the least key of each of its bands."""
    buckets = parts_for(n * BANDS * 16, BUCKET_BYTES, 32)

    def deal(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for at in range(0, len(keys), 4000):
                part = batch.column("bands").slice(at, 4000)
                full = part.is_valid().to_numpy(zero_copy_only=False)
                bands = np.frombuffer(b"".join(part.drop_null().to_pylist()), np.uint64)
                own = np.repeat(keys[at : at + 4000][full], BANDS)
                yield pa.RecordBatch.from_arrays([pa.array((bands % np.uint64(buckets)).astype(np.int32)), pa.array(bands.view(np.int64)), pa.array(own)], ["bucket", "band", "key"])

    def stars(part: pa.Table) -> pa.Table:
        band, own = part.column("band").to_numpy(), part.column("key").to_numpy()
        order = np.lexsort((own, band))
        band, own = band[order], own[order]
        new = np.ones(len(band), bool)
        new[1:] = band[1:] != band[:-1]
        least = own[np.flatnonzero(new)][np.cumsum(new) - 1]
        links = np.unique(np.stack([own, least], axis=1)[own != least], axis=0)
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    dealt = held.mapInArrow(tidy(deal), "bucket int, band long, key long")
    return dealt.groupBy("bucket").applyInArrow(tidy(stars), "a long, b long")


def linked(grams: np.ndarray, edges: np.ndarray, threshold: float) -> np.ndarray:
    """A label for each set, the same for sets that chains of similar ones join.

    Sets come in order of size; a pair is compared only if their rarest shingles meet: with n shingles the n - ceil(threshold n) + 1
    rarest of two similar sets share one (prefix filtering; Chaudhuri et al., 2006)."""
    sizes = np.diff(edges)
    order = np.argsort(sizes, kind="stable")
    _, token, count = np.unique(grams, return_inverse=True, return_counts=True)
    rarity = np.empty(len(count), np.int64)
    rarity[np.argsort(count, kind="stable")] = np.arange(len(count))
    rare = rarity[token][np.lexsort((rarity[token], np.repeat(np.arange(len(sizes)), sizes)))]
    label, holders = np.arange(len(order)), {}
    sets = [grams[edges[k] : edges[k + 1]] for k in order]
    for i, k in enumerate(order.tolist()):
        own, n, met = sets[i], int(sizes[k]), set()
        for t in rare[edges[k] : edges[k] + n - math.ceil(threshold * n - 1e-9) + 1].tolist() if n else ():
            others = holders.setdefault(t, [])
            met.update(others)
            others.append(i)
        rest = np.array(sorted(met), np.int64)
        rest = rest[(sizes[order[rest]] >= threshold * n - 1e-9) & (label[rest] != label[i])]
        while len(rest):
            j, rest = rest[-1], rest[:-1]
            shared = n + len(sets[j]) - len(np.union1d(own, sets[j]))
            if shared / max(1, n + len(sets[j]) - shared) >= threshold:
                label[: i + 1][label[: i + 1] == label[i]] = label[j]
                rest = rest[label[rest] != label[i]]
    out = np.empty(len(order), np.int64)
    out[order] = label
    return out


def _near_fingerprints(held: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between keys whose fingerprints lie within the radius; each fingerprint is searched once."""
    one, _ = staged(held.groupBy("fp").agg(F.min("key").alias("key")), "fingerprints")
    same = held.join(one.withColumnRenamed("key", "least"), "fp").where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    near = simhash.near_links(one.select("fp"), radius)
    for side in ("a", "b"):
        near = near.join(one.select(F.col("fp").alias(side), F.col("key").alias(f"key_{side}")), side)
    return same.unionByName(near.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")))


def _roots(docs: DataFrame, width: int, threshold: float, radius: int) -> tuple[DataFrame, dict[str, str], DataFrame]:
    """The rows of docs with their place and key (under names that docs does not use), the names, and the root of each key."""
    names = {c: next(n for k in itertools.count() if (n := f"__{c}{k}") not in docs.columns) for c in ("row", "key", "fp", "bands")}
    full, path = staged(_sketches(docs, width, names), "sketches")
    held, _ = staged(full.drop(names["bands"], names["fp"]), "rows")
    plain = full.select(*[F.col(n).alias(c) for c, n in names.items()])
    one, _ = staged(plain.groupBy("key").agg(F.min("row").alias("row"), F.first("fp").alias("fp"), F.first(F.col("bands").isNotNull()).alias("full")), "distinct")
    bands = plain.groupBy("key").agg(F.first("bands").alias("bands"))  # equal sets have equal bands: copies are searched once
    links = _candidates(bands, one.count()).unionByName(_near_fingerprints(one.where("full").select("key", "fp"), radius))
    groups = components(links).select(F.col("node").alias("key"), F.col("root").alias("group")).distinct()
    discard(docs.sparkSession, path)  # the bands have given their links
    texts = groups.join(one.select("key", "row"), "key").join(held.select(F.col(names["row"]).alias("row"), "text"), "row").select("group", "key", "text")

    def verify(part: pa.Table) -> pa.Table:
        keys = part.column("key").to_numpy()
        labels = linked(*shingle_sets(part.column("text"), width), threshold)
        return pa.table({"key": keys, "root": keys[labels_first(labels)]})

    found = texts.groupBy("group").applyInArrow(tidy(verify), "key long, root long")
    named, _ = staged(one.select("key").join(found, "key", "left").withColumn("root", F.coalesce("root", "key")), "named")
    return held, names, named


def near_groups(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """doc_id and component_id of every row: the least doc_id among all that chains of similar texts reach."""
    held, names, named = _roots(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, threshold, radius)
    rows = held.select("doc_id", F.col(names["key"]).alias("key"))
    least = rows.groupBy("key").agg(F.min("doc_id").alias("least")).join(named, "key").groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(least, "root").select("key", "component_id"), "key").select("doc_id", "component_id")


def labels_first(labels: np.ndarray) -> np.ndarray:
    """For each place the first place with the same label."""
    _, first, back = np.unique(labels, return_index=True, return_inverse=True)
    return first[back]


def keep_one(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """One row of each group, that with the least doc_id (of equal ones the first as the table is read), with its own columns. Rows are told apart by place, so a null or repeated doc_id takes no other row with it."""
    held, names, named = _roots(docs, width, threshold, radius)
    rows = held.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.col(names["row"]).alias("row"), F.col(names["key"]).alias("key"))
    least = rows.groupBy("key").agg(F.min(F.struct("id", "row")).alias("least")).join(named, "key").groupBy("root").agg(F.min("least").alias("first"))
    gone = rows.join(named.join(least, "root").select("key", "first"), "key").where(F.col("row") != F.col("first.row")).select(F.col("row").alias(names["row"]))
    return held.join(gone, names["row"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

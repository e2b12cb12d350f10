"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item inside a long document has a tiny Jaccard similarity to it, so, as in an LSH ensemble (Zhu et al., 2016), the
search is partitioned by size: for each size class of items (up to u shingles) documents are cut into blocks of u shingles,
and an item is compared with pairs of neighbouring blocks. K MinHash values of both are banded with one row each; an item that
shares any value with a block pair of its class is a candidate, and a candidate is kept if its share of distinct shingles
found in the whole document, compared as words, reaches the threshold. With a block pair that holds an item's 0.8 of u / 2
shingles or more the similarity is above 0.15, and K = 64 values miss it with a probability under 1 in 30,000. The least class
is u = 8 and holds items of 5 to 8 shingles; items of up to EXACT = 4 are looked up by the hashes of their shingles, as many of
them as a document that reaches the threshold cannot all lack, so none of these is missed.

Words are runs without ASCII white space after A-Z became a-z; shingles have `width` words (5). An item with fewer words is one
shingle, its whole word sequence, looked for as such. Null and empty items match nothing; null and empty documents hold
nothing. Repeated items and documents each give their rows, under whatever doc_id, null included. Other columns are ignored.

Items are sent to all executors in groups of ITEM_BYTES of text at most; a larger benchmark takes more passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import buffer_of, lowered, mix, slices, span_hashes, tidy, words_of

K, WIDTH, THRESHOLD, ITEM_BYTES, EXACT = 64, 5, 0.8, 8 << 20, 4
_SEEDS = mix(np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], width: int) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}


def _combined(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words from the words' hashes."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9DDFEA08EB382D69) + hashes[k : k + n])
    return out


class Items:
    """The items of one pass: their shingles and, by size class, the K tables of MinHash values."""

    def __init__(self, rows: list[tuple], width: int, threshold: float = THRESHOLD):
        self.ids, words = [i for i, _ in rows], [_words(t) for _, t in rows]
        self.width, self.sets = width, [shingles(w, width) for w in words]
        self.short: dict[int, dict[int, list[int]]] = {}
        self.classes: dict[int, list] = {}
        groups: dict[int, list] = {}
        for k, w in enumerate(words):
            if not w:
                continue
            line = np.frombuffer(b" ".join(w), np.uint8)
            starts, ends, _ = words_of(line, np.array([0, len(line)]))
            hashes = span_hashes(line, starts, ends)
            if len(w) < width:
                self.short.setdefault(len(w), {}).setdefault(int(_combined(hashes, len(w))[0]), []).append(k)
            else:
                grams, n = _combined(hashes, width), len(self.sets[k])
                if n <= EXACT:
                    least = next((m for m in range(1, n) if m >= threshold * n), n)
                    for g in np.unique(grams)[: n - least + 1].tolist():
                        self.short.setdefault(width, {}).setdefault(g, []).append(k)
                    continue
                size = 8
                while size < n:
                    size *= 2
                groups.setdefault(size, []).append((k, np.array([mix(grams * s).min() for s in _SEEDS])))
        for size, own in groups.items():
            place, values = np.array([k for k, _ in own]), np.stack([v for _, v in own])
            order = np.argsort(values, axis=0)
            self.classes[size] = [(values[order[:, j], j], place[order[:, j]]) for j in range(K)]


def _matches(table, keys: np.ndarray, where: np.ndarray):
    """(where, item) for each key that the table holds."""
    values, place = table
    a, b = np.searchsorted(values, keys, "left"), np.searchsorted(values, keys, "right")
    hit = np.flatnonzero(b > a)
    for k in hit:
        for item in place[a[k] : b[k]]:
            yield int(where[k]), int(item)


def candidates(items: Items, texts: pa.Array) -> set[tuple[int, int]]:
    """(row, item) pairs that share a MinHash value in some block pair, a short item's whole sequence, or a shingle of an item of few."""
    data, offsets = buffer_of(texts)
    data = lowered(data)
    starts, ends, edges = words_of(data, offsets)
    hashes, counts, out = span_hashes(data, starts, ends), np.diff(edges), set()
    for width in sorted({items.width, *items.short}):
        n = np.maximum(0, counts - width + 1)
        grams = _combined(hashes, width)
        row = np.repeat(np.arange(len(counts)), n)
        first = np.repeat(edges[:-1], n)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        grams = grams[first + inside] if len(row) else grams[:0]
        if width in items.short:
            known = items.short[width]
            for k in np.flatnonzero(np.isin(grams, np.array(list(known), np.uint64))):
                out.update((int(row[k]), item) for item in known[int(grams[k])])
        if width != items.width or not len(row) or not items.classes:
            continue
        blocks = {size: np.flatnonzero(inside % size == 0) for size in items.classes}
        for j, seed in enumerate(_SEEDS):
            values = mix(grams * seed)
            for size, cuts in blocks.items():
                least = np.minimum.reduceat(values, cuts)
                own = row[cuts]
                pair = least.copy()
                same = own[1:] == own[:-1]
                pair[:-1][same] = np.minimum(least[:-1], least[1:])[same]
                out.update(_matches(items.classes[size][j], pair, own))
    return out


def _passes(items: DataFrame, item_bytes: int, width: int, threshold: float):
    """The items in groups of item_bytes of text at most (or one item), each group broadcast."""
    spark = items.sparkSession
    small = items.select("item_id", "text", F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64).over(Window.orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    small = small.withColumn("pass", F.floor(F.col("upto") / item_bytes))
    for one in [r[0] for r in small.select("pass").distinct().orderBy("pass").collect()]:
        own = small.where(F.col("pass") == one).orderBy("item_id", "text").select("item_id", "text").collect()
        yield spark.sparkContext.broadcast(Items([(r[0], r[1]) for r in own], width, threshold))


def _found(known: Items, texts: pa.Array, threshold: float):
    """(row, item, shared shingles, shingles of the item) of each item that a text holds."""
    at, words, own = None, None, {}
    for k, item in sorted(candidates(known, texts)):
        if k != at:
            at, words, own = k, _words(texts[k].as_py()), {}
        asked = known.sets[item]
        size = next(iter(asked)).count(b" ") + 1
        if size not in own:
            own[size] = shingles(words, size) if len(words) >= size else set()
        shared = len(asked & own[size])
        if shared >= threshold * len(asked):
            yield k, item, shared, len(asked)


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of each item that a document holds to the threshold or more."""
    out, texts = None, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fields = "doc_id long, item_id long, n_shared long, n_item long, containment double"
    for held in _passes(items, item_bytes, width, threshold):

        def run(batches, held=held):
            known = held.value
            for batch in batches:
                for piece in slices(batch):
                    rows = [(piece.column("doc_id")[k].as_py(), known.ids[item], shared, n, shared / n) for k, item, shared, n in _found(known, piece.column("text"), threshold)]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(kinds)], ["doc_id", "item_id", "n_shared", "n_item", "containment"])

        own = texts.mapInArrow(tidy(run), fields)
        out = own if out is None else out.unionByName(own)
    return out if out is not None else docs.sparkSession.createDataFrame([], fields)


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The documents that hold no item, with their own columns. Each row is judged by its own text, whatever its doc_id (null or repeated)."""
    for held in _passes(items, item_bytes, width, threshold):

        def run(batches, held=held):
            known = held.value
            for batch in batches:
                for piece in slices(batch):
                    clean = np.ones(piece.num_rows, bool)
                    clean[[k for k, *_ in _found(known, piece.column("text"), threshold)]] = False
                    yield piece.filter(pa.array(clean))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs

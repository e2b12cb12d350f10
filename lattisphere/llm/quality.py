"""Quality scores by naive Bayes support vectors (Wang and Manning, 2012).

A text is a set of n-gram indicators: pairs of bytes, and runs of one and two word shapes (case, length, last bytes, whether
the word repeats the one before) at four levels of their share in the text. Each indicator is scaled by the log ratio of its
smoothed counts in the two classes, and a linear hinge-loss model is fitted to the scaled indicators by dual coordinate
descent. The model learns from a bounded sample (PER_CLASS labelled rows of each class, drawn by hash); every whole text is
scored where it is read, without a shuffle.

Null and empty texts have no indicators and get the score of the bias. Without labelled rows of both classes every score is
0.5. Labels that are null or neither 0 nor 1 are not used; a label whose document is missing is not used; repeated labels
count as often as they stand. Other columns are ignored; repeated rows each get a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import fit_hinge, fit_scale, logistic
from .shared import buffer_of, lowered, mix, slices, span_hashes, tidy, words_of

PER_CLASS = 3000
PAIRS, SHAPES = 1 << 16, 1 << 16
LEVELS = (0.0, 1 / 64, 1 / 8, 1 / 2)

_KIND = np.full(256, 3, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 other, 4 part of a character beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 4


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """A number for each word's shape; fresh: whether it is the first of its text."""
    kind = _KIND[data]
    upper, lower = (np.concatenate([[0], np.cumsum(kind == k)]) for k in (1, 0))
    n, n_upper, n_lower = ends - starts, upper[ends] - upper[starts], lower[ends] - lower[starts]
    case = (n_upper > 0).astype(np.int64) + (n_lower == 0) * 2 + (n_upper > 1) * 4
    last = data[ends - 1].astype(np.int64)
    last = np.where(_KIND[last] == 3, last, _KIND[last])
    before = np.where(n > 1, data[np.maximum(ends - 2, 0)], 0)
    double = (before == data[ends - 1]) & (_KIND[before] == 3)
    size = np.searchsorted([2, 3, 7, 13, 30], n, "right")
    own = span_hashes(lowered(data), starts, ends)
    again = np.zeros(len(own), bool)
    again[1:] = (own[1:] == own[:-1]) & ~fresh[1:]
    return (((case * 256 + last) * 2 + double) * 8 + size) * 2 + again


def features(texts: pa.Array) -> list[np.ndarray]:
    """The indices of each text's indicators."""
    data, offsets = buffer_of(texts)
    starts, ends, edges = words_of(data, offsets)
    fresh = np.zeros(len(starts) + 1, bool)
    fresh[edges[:-1]] = True
    shape = _shapes(data, starts, ends, fresh[:-1]).astype(np.uint64)
    one = (mix(shape + np.uint64(1)) % np.uint64(SHAPES // 4)).astype(np.int64)
    two = one.copy()
    two[1:] = (mix(shape[1:] * np.uint64(1 << 24) + shape[:-1] + np.uint64(1 << 50)) % np.uint64(SHAPES // 4)).astype(np.int64)
    pair = data[:-1].astype(np.int64) * 256 + data[1:] if len(data) else np.zeros(0, np.int64)
    seen, out = np.zeros(PAIRS, bool), []
    for k in range(len(offsets) - 1):
        a, b = offsets[k], max(offsets[k], offsets[k + 1] - 1)
        seen[pair[a:b]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        parts = [found]
        a, b = edges[k], edges[k + 1]
        for run in (one[a:b], two[a + 1 : b]):
            if len(run):
                grams, counts = np.unique(run, return_counts=True)
                share = counts / len(run)
                parts += [PAIRS + grams[share > level] * 4 + n for n, level in enumerate(LEVELS)]
        out.append(np.unique(np.concatenate(parts)))
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    """(weights of the indicators, bias) of the labelled documents; None if a class is missing."""
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    counts = {r[0]: r[1] for r in good.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    coin = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, per_class / counts[1]).otherwise(per_class / counts[0])
    drawn = good.where(coin < share)  # some 2 * per_class rows at any size

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                yield pa.RecordBatch.from_arrays([piece.column("y"), piece.column("key"), pa.array([x.tolist() for x in features(piece.column("text"))], pa.list_(pa.int32()))], ["y", "key", "at"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id").select("y", F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(tidy(run), "y int, key long, at array<int>").toArrow().sort_by([("key", "ascending"), ("y", "ascending")])  # the same order however the files are laid out
    y = np.where(rows.column("y").to_numpy() == 1, 1, -1)
    if len(set(y.tolist())) < 2:
        return None
    lists = rows.column("at").combine_chunks()
    edges, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
    each = [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    ratio = np.zeros(PAIRS + SHAPES)
    for sign in (1, -1):
        count = np.ones(PAIRS + SHAPES)
        np.add.at(count, np.concatenate([x for x, s in zip(each, y, strict=True) if s == sign]), 1)
        ratio += sign * np.log(count / count.sum())
    scaled = [(x, ratio[x] / np.sqrt(max(1, len(x)))) for x in each]
    cost = np.where(y == 1, 1.0, max(1.0, (y == 1).sum() / max(1, (y == -1).sum())))
    w = fit_hinge(scaled, y, PAIRS + SHAPES, cost)
    margins = np.array([w[x] @ v + w[-1] for x, v in scaled])
    a = fit_scale(margins, y)
    return (a * w[:-1] * ratio), float(a * w[-1])


def scored(docs: DataFrame, model) -> DataFrame:
    """doc_id and score of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: one weight for each indicator

    def run(batches):
        weights, bias = held.value
        for batch in batches:
            for piece in slices(batch):
                margins = np.array([weights[x].sum() / np.sqrt(max(1, len(x))) + bias for x in features(piece.column("text"))])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(logistic(margins))], ["doc_id", "score"])

    return docs.mapInArrow(tidy(run), "doc_id long, score double")


def score_quality(docs: DataFrame, labels: DataFrame, of: int = 3, kept_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose crc32(doc_id) mod `of` is kept_out are not learnt from."""
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string")), F.lit(of)) == kept_out, F.lit(False))
    model = fit(docs, labels.where(~fold))
    return scored(docs, model).select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

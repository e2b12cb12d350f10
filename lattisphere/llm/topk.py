"""Exact top-k inner products by vector-approximation files.

Components become floor(64 * x). The approximation file holds, in blocks, every vector's cell numbers, a byte for each component:
CELLS cells of equal width between the least and the greatest value of the dimension. Exact vectors lie in a table of their own.
The cells are scanned twice against all blocks of questions. A product with the cells' lower edges, and a term of the question
alone, give a lower and an upper bound of each inner product. The first scan finds each question's kth lower bound over the
whole file; the second lists the candidates whose upper bound reaches it. Their exact vectors are then read in falling order
of upper bound: the first k, and after those whatever reaches the kth exact score.

Questions are the rows whose vec_id is divisible by `every`, candidates all rows but the question's own (all rows of that
vec_id). Ties go to the smaller vec_id; repeated rows are candidates as often as they stand and one
question; different vectors under one vec_id give the best k of both. Vectors that are null or hold a null or
non-finite component, and rows with a null vec_id, take no part; vectors of unequal lengths are filled up with zeros; empty
vectors score 0. Bounds are widened by their rounding error, so they hold for components of any size; a score beyond 64 bits is an error.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import pack_planes, staged, tidy, unpack_planes

SCALE, CELLS, BLOCK_ROWS, ASKED_ROWS, AT_ONCE = 64, 256, 16384, 4096, 256


def _whole(embeddings: DataFrame) -> DataFrame:
    """vec_id and v (whole numbers) of the rows that take part."""
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * SCALE).cast("long"))
    good = F.coalesce(F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
    return embeddings.where(good & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


class Cells:
    """The cells of each dimension: least values and widths."""

    def __init__(self, low: np.ndarray, high: np.ndarray, cells: int = CELLS):
        self.low = low
        self.width = np.array([max(1, -(-(int(b) - int(a) + 1) // cells)) for a, b in zip(low, high, strict=True)], np.int64)
        self.most = np.maximum(np.abs(low.astype(np.float64)), np.abs(high.astype(np.float64))) + self.width

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.low) // self.width).astype(np.uint8)

    def bounds(self, asked: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Products of the questions (m x d, floating) with the cells' lower edges, and what to add for the lower and the upper bounds."""
        edges = codes * self.width.astype(np.float64) + self.low
        size = np.abs(asked) @ self.most
        slack = np.where(size * 4 < 2.0**53, 0.0, size * (asked.shape[1] + 4) * 2.0**-51)
        room = self.width - 1.0
        return asked @ edges.T, np.minimum(asked, 0) @ room - slack, np.maximum(asked, 0) @ room + slack


def _cells(exact: DataFrame, dims: int) -> Cells:
    """The least and greatest value of each dimension; a row for each reaches the driver."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"), dims)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(v.min(axis=0)), pa.array(v.max(axis=0))], ["at", "low", "high"])

    found = sorted(exact.select("v").mapInArrow(tidy(run), "at long, low long, high long").groupBy("at").agg(F.min("low"), F.max("high")).collect())
    return Cells(np.array([r[1] for r in found], np.int64), np.array([r[2] for r in found], np.int64))


def _blocks(rows: DataFrame, size: int, dims: int, cells: Cells | None) -> DataFrame:
    """Rows (row, vec_id, v) in blocks of `size` or fewer, as they come: their numbers, ids, and codes (without cells: vectors)."""

    def run(batches):
        first, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                v = _matrix(part.column("v"), dims)
                held = pack_planes((cells.codes(v) if cells else v).ravel()) if dims else b""
                packed = [pack_planes(part.column(c).to_numpy()) for c in ("row", "vec_id")]
                yield pa.RecordBatch.from_arrays([pa.array([first + n]), *(pa.array([x], pa.binary()) for x in (*packed, held))], ["block", "rows", "ids", "held"])
                n += 1

    return rows.mapInArrow(tidy(run), "block long, rows binary, ids binary, held binary")


def _numbered(blocks: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Blocks under the numbers 0, 1, ... as `name`; a bare number for each block is sorted in one task."""
    numbers, _ = staged(blocks.select("block").withColumn(name, F.row_number().over(Window.orderBy("block")) - 1), "numbers")
    return blocks.join(numbers, "block").drop("block"), numbers.count()


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each question's k best candidates."""
    spark, rows = embeddings.sparkSession, _whole(embeddings)
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v")))
    exact, _ = staged(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", filled.alias("v")), "vectors")
    cells = _cells(exact, dims) if dims else None
    file, _ = staged(_blocks(exact, BLOCK_ROWS, dims, cells), "cells")
    asked, _ = staged(exact.where(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.min("row").alias("row")).select("row", "vec_id", "v"), "questions")
    file, n_blocks = _numbered(file, "c")
    questions, n_asked = _numbered(staged(_blocks(asked, ASKED_ROWS, dims, None), "asked")[0], "q")
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def met(questions: DataFrame, scan, fields: str) -> DataFrame:
        """Every block of questions with every block of the file, in groups of one pair each."""
        left = questions.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        right = file.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
        return left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(tidy(scan), fields)

    def products(left: pa.Table, right: pa.Table):
        """For AT_ONCE questions at a time their numbers, and the bounds of all candidates; own rows are marked."""
        one, other = left.to_pylist()[0], right.to_pylist()[0]
        q_rows, q_ids, rows, ids = (unpack_planes(x[c], np.int64) for x in (one, other) for c in ("rows", "ids"))
        q = unpack_planes(one["held"], np.int64).reshape(-1, dims).astype(np.float64) if dims else np.zeros((len(q_ids), 0))
        codes = unpack_planes(other["held"], np.uint8).reshape(-1, dims) if dims else np.zeros((len(ids), 0), np.uint8)
        for a in range(0, len(q), AT_ONCE):
            b = slice(a, a + AT_ONCE)
            base, low, high = cells.bounds(q[b], codes) if dims else (np.zeros((len(q[b]), len(ids))), *np.zeros((2, len(q[b]))))
            base[q_ids[b][:, None] == ids[None, :]] = -np.inf
            yield b, q_rows[b], q_ids[b], rows, base, low, high

    def lowest(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for _, q_rows, _, rows, base, low, _ in products(left, right):
            n = min(k, len(rows))
            best = np.partition(base, len(rows) - n, axis=1)[:, len(rows) - n :] + low[:, None]
            asked, best = np.repeat(q_rows, n), best.ravel()
            out.append((asked[best > -np.inf], best[best > -np.inf]))
        asked, best = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"q": pa.repeat(left.column("q")[0], len(asked)), "asked": asked, "low": best})

    first = met(questions, lowest, "q int, asked long, low double")
    best = Window.partitionBy("q", "asked").orderBy(F.desc("low"))
    floors = first.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).groupBy("q", "asked").agg(F.min("low").alias("low"), F.count("*").alias("n"))
    floors = floors.where(F.col("n") == k).groupBy("q").agg(F.collect_list(F.struct("asked", "low")).alias("floors"))  # ASKED_ROWS at most
    bounded, _ = staged(questions.join(floors, "q", "left"), "bounded")

    def reaching(left: pa.Table, right: pa.Table) -> pa.Table:
        floor = {f["asked"]: f["low"] for f in left.column("floors")[0].as_py() or []}
        out = []
        for _, q_rows, q_ids, rows, base, _, high in products(left, right):
            base += high[:, None]
            least = np.array([floor.get(x, -np.inf) for x in q_rows.tolist()])
            i, j = np.nonzero((base >= least[:, None]) & (base > -np.inf))
            out.append((q_rows[i], q_ids[i], rows[j], base[i, j]))
        return pa.table(dict(zip(("asked", "query_id", "row", "high"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    listed = met(bounded, reaching, "asked long, query_id long, row long, high double")
    found, _ = staged(listed.withColumn("n", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("high"), "row"))), "listed")

    def scored(pairs: DataFrame) -> DataFrame:
        """The exact products of the pairs (asked, query_id, row)."""
        held = pairs.join(asked.select(F.col("row").alias("asked"), F.col("v").alias("u")), "asked").join(exact, "row")
        return held.select("asked", "query_id", "vec_id", F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x).alias("score"))

    near, _ = staged(scored(found.where(F.col("n") <= k).select("asked", "query_id", "row")), "scored")
    sure = near.groupBy("asked").agg(F.min("score").alias("sure"))
    rest = found.where(F.col("n") > k).join(sure, "asked").where(F.col("high") >= F.col("sure").cast("double")).select("asked", "query_id", "row")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    every_one = near.unionByName(scored(rest)).select("query_id", "vec_id", "score")
    return every_one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

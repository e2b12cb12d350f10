"""Sharding by sampled splitters, in DataFrame operations only.

Rows are ordered by (doc_id, salt); a size-weighted sample of that key gives quantile splitters, the splitters cut the
rows into ranges, and a range that holds too many bytes is cut again by splitters of its own sample. Running sums inside
the ranges, on top of the totals of the ranges before, place every row exactly, so the shards' sizes differ by no more than
about one row. The salt splits repeated keys, so a key with a third of all rows is cut like any other.

Null texts have no bytes (size 1, CRC of nothing); null ids come first; repeated rows each get a slot; an empty table gives
no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

#: Bounds of what reaches the driver: splitters of the first level, and sampled rows for each of them.
RANGES, PER_RANGE = 64, 64


def _sample(rows: DataFrame, share, seed: int) -> DataFrame:
    """Rows drawn with a probability of size times share (1 at most), with the bytes that each stands for."""
    p = F.least(F.lit(1.0), F.col("size") * share)
    coin = F.pmod(F.xxhash64("salt", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(coin < p).withColumn("stands", F.col("size") / p)


def _quantiles(sample: list, n: int) -> list:
    """n - 1 keys that cut the sample (key, bytes it stands for) into n parts of about equal bytes."""
    total, run, out = sum(w for _, w in sample), 0.0, []
    for k, w in sorted(sample, key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1])):
        run += w
        if len(out) < n - 1 and run >= total * (len(out) + 1) / n:
            out.append(k)
    return out


def _literal(k: tuple):
    return F.struct(F.lit(k[0]).cast("long").alias("doc_id"), F.lit(k[1]).cast("long").alias("salt"))


def assign_shards(docs: DataFrame, n_shards: int = 8, range_bytes: int = 1 << 28) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard (0 to n_shards - 1), slot (from 0, gapless in its shard)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows, _ = staged(rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id(), "text_crc32")), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    rows = rows.withColumn("k", F.struct("doc_id", "salt"))

    picked = _sample(rows, RANGES * PER_RANGE / max(1, total), 1).select("doc_id", "salt", "stands").collect()  # some RANGES * PER_RANGE rows at any size
    cuts = _quantiles([((r[0], r[1]), r[2]) for r in picked], RANGES)
    at = F.size(F.filter(F.array(*map(_literal, cuts)), lambda c: c < F.col("k"))) if cuts else F.lit(0)
    rows, _ = staged(rows.withColumn("range", at.cast("int")).drop("k"), "ranges")

    # a range with too many bytes is cut again, by a sample of its own
    limit = max(1, min(range_bytes, 2 * math.ceil(total / RANGES)))
    held = rows.groupBy("range").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > limit)
    held = held.withColumn("cuts_n", F.least(F.lit(1024), F.ceil(F.col("bytes") / limit)).cast("int"))
    keyed = rows.join(F.broadcast(held), "range")  # RANGES rows at most
    drawn = _sample(keyed, F.col("cuts_n") * PER_RANGE / F.col("bytes"), 2)
    sub = drawn.groupBy("range", "cuts_n").agg(F.sort_array(F.collect_list(F.struct("doc_id", "salt"))).alias("s"))
    sub = sub.select("range", F.expr("transform(sequence(1, cuts_n - 1), i -> s[cast(floor(i * size(s) / cuts_n) as int)])").alias("sub"))
    sub = sub.where(F.size("sub") > 0)
    # at most RANGES rows of 1,023 keys each: some megabytes at any size of the input
    rows = rows.join(F.broadcast(sub), "range", "left").withColumn("k", F.struct("doc_id", "salt"))
    inner = F.coalesce(F.size(F.filter("sub", lambda c: c < F.col("k"))), F.lit(0))
    rows = rows.select("doc_id", "size", "text_crc32", "salt", (F.col("range") * 1024 + F.when(F.col("sub").isNull(), 0).otherwise(inner)).cast("int").alias("range"))

    # totals of the ranges before each range: RANGES * 1,024 rows at most
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    sums = sums.select("range", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("range").orderBy("doc_id", "salt", "text_crc32", "size")
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumns({"upto": F.sum("size").over(run), "rank": F.row_number().over(inside)}).join(F.broadcast(sums), "range")
    middle = F.col("b0") + F.col("upto") - F.col("size") / 2
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(float(max(1, total))))).cast("int")
    placed = placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("n0") + F.col("rank") - 1).alias("place"))
    placed, _ = staged(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8) -> DataFrame:
    """Writes the documents to path/shard=k in slot order and returns the assignment; doc_id must be unique."""
    placed = assign_shards(docs, n_shards)
    keyed = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    keyed.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed

"""Structures taken from general tables: points of an embedding as one frame, and an event log as trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import cell_of_each_frame, frame_table

SIDE = 20.0
CUBE = [SIDE, 0.0, 0.0, 0.0, SIDE, 0.0, 0.0, 0.0, SIDE]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as an atom of frame 0 by its first three components."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    kind = F.when(F.col("label") % 3 == 0, "Si").when(F.col("label") % 3 == 1, "O").otherwise("H")
    at = [((F.col("embedding")[k].cast("double") + 0.5) * SIDE).alias(c) for k, c in enumerate("xyz")]
    return e.select(F.lit(0).cast("long").alias("frame"), F.col("vec_id").alias("atom_id"), kind.alias("element"), *at)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user as an atom whose successive events are its frames."""
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("user_id") % 3 == 0, "Si").when(F.col("user_id") % 3 == 1, "O").otherwise("H")
    hashed = lambda m: ((F.col("event_id") * m) % 2000).cast("double") / 100.0
    return e.select((F.row_number().over(order) - 1).cast("long").alias("frame"), F.col("user_id").alias("atom_id"), kind.alias("element"), (F.col("value") % SIDE).alias("x"), hashed(7919).alias("y"), hashed(104729).alias("z"))


def cube(atoms: DataFrame) -> DataFrame:
    return frame_table(cell_of_each_frame(atoms, CUBE))


#: The same as DuckDB SQL.
POINTS_SQL = """atoms AS (SELECT vec_id AS atom_id, CASE label % 3 WHEN 0 THEN 'Si' WHEN 1 THEN 'O' ELSE 'H' END AS element,
 (CAST(embedding[1] AS DOUBLE) + 0.5) * 20 AS x, (CAST(embedding[2] AS DOUBLE) + 0.5) * 20 AS y, (CAST(embedding[3] AS DOUBLE) + 0.5) * 20 AS z FROM embeddings)"""
PATHS_SQL = """atoms AS (SELECT CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame, user_id AS atom_id,
 CASE user_id % 3 WHEN 0 THEN 'Si' WHEN 1 THEN 'O' ELSE 'H' END AS element, value % 20.0::DOUBLE AS x,
 CAST((event_id * 7919) % 2000 AS DOUBLE) / 100.0 AS y, CAST((event_id * 104729) % 2000 AS DOUBLE) / 100.0 AS z FROM events)"""


def pairs_sql(cutoff: float) -> str:
    d = {c: f"(b.{c} - a.{c}) - 20 * round((b.{c} - a.{c}) / 20)" for c in "xyz"}
    return f"""legs AS (SELECT a.atom_id AS i, b.atom_id AS j, a.element AS e1, b.element AS e2, {', '.join(f'{d[c]} AS r{c}' for c in 'xyz')} FROM atoms a JOIN atoms b ON a.atom_id < b.atom_id),
 pairs AS (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS d FROM legs WHERE rx * rx + ry * ry + rz * rz < {float(cutoff) ** 2})"""


BONDS_SQL = """bonds AS (SELECT i AS src, j AS dst, e1, e2, rx, ry, rz, d FROM pairs WHERE d * d <= 1.44
 UNION ALL SELECT j, i, e2, e1, -rx, -ry, -rz, d FROM pairs WHERE d * d <= 1.44)"""

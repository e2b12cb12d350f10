"""Tables written to the folder that all executors share, to end long lineages."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict = {}


def new_folder(spark: SparkSession) -> str:
    """A path under spark.checkpoint.dir that goes when the session ends; where it is unset, under a temporary folder of a local session.

    Raises RuntimeError on a cluster without it, whose executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.TemporaryDirectory()
            atexit.register(_OWN["dir"].cleanup)
        base = f"file://{_OWN['dir'].name}"
    path = f"{base.rstrip('/')}/structures/{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def once(df: DataFrame, source) -> DataFrame:
    """df, a few rows that are used more than once: written if it comes from a search (a Near), which would be run each time."""
    from .near import Near

    return materialised(df) if isinstance(source, Near) else df


def materialised(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

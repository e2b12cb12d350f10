"""Structure files as DataFrames of frames and atoms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import LATTICE
from . import formats

_ROW = "path string, place long, lattice array<double>, energy double, symbols array<string>, positions array<array<double>>"


def _frames_of_files(spark: SparkSession, path, fmt: str | None) -> DataFrame:
    """One row for each frame of each file; a task parses a file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for rows in batches:
            for name, content in zip(rows["path"], rows["content"], strict=True):
                text = bytes(content).decode("utf-8", "replace")
                found = formats.parse(text, fmt or formats.format_of(name, text))
                yield pd.DataFrame({"path": name, "place": range(len(found)), "lattice": [f.lattice for f in found], "energy": [f.energy for f in found], "symbols": [f.symbols for f in found], "positions": [f.positions for f in found]})

    return files.mapInPandas(run, _ROW)


#: Trajectories whose frames begin at a line that can be told by itself, in any case: its pattern, and whether the lines before
#: the first frame belong to every frame. Spark splits such files at line ends, so many tasks read one file.
CUTS = {
    "lammps": (r"^ITEM: TIMESTEP", False),
    "xdatcar": (r"(?i)^\s*direct", True),
    "pdb": (r"^MODEL\b", True),
    "castep_md": (r"<--\s+E\s*$", True),
    "xyz": (r"^\s*\d+\s*$", False),  # the count; a bare number after it is its comment
}
#: Heads of all files together go to every task up to this size; beyond it they meet the frames by path.
HEADS = 8 << 20


def _frames_of_lines(spark: SparkSession, path, fmt: str) -> DataFrame:
    """One row for each frame: lines are numbered inside their split, splits by the frames before them, and a task holds some frames."""
    mark, with_head = CUTS[fmt]
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    inside = Window.partitionBy("path", "block").orderBy("row")
    begins = F.col("value").rlike(mark)
    lines = lines.withColumn("bare", begins)
    if fmt == "xyz":
        begins = F.col("bare") & ~F.coalesce(F.lag("bare").over(inside), F.lit(False))
    lines = lines.withColumn("begins", begins.cast("long"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split of a file
    splits = lines.groupBy("path", "block").agg(F.sum("begins").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.col("before") + F.sum("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    chunks = lines.join(splits, ["path", "block"]).withColumn("place", place).groupBy("path", "place").agg(F.sort_array(F.collect_list(F.struct("block", "row", "value"))).alias("lines"))
    chunks = chunks.select("path", "place", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("text"))  # a frame's lines
    heads = chunks.where("place = 0").select("path", F.col("text").alias("head"))
    whole = chunks.groupBy("path").agg(F.max("place").alias("n")).where("n = 0")  # files without a mark
    frames = chunks.where("place > 0")
    if with_head:
        size = heads.agg(F.sum(F.octet_length("head") + 64)).first()[0] or 0
        frames = frames.join(F.broadcast(heads) if size <= HEADS else heads, "path", "left")
    else:
        frames = frames.withColumn("head", F.lit(None).cast("string"))
    alone = chunks.join(whole, "path", "left_semi").withColumn("head", F.lit(None).cast("string")) if with_head else None
    held = frames.unionByName(alone) if alone is not None else frames

    def run(batches):
        for rows in batches:
            at, found = [], []
            for name, k, head, text in zip(rows["path"], rows["place"], rows["head"], rows["text"], strict=True):
                for f in formats.parse(f"{head}\n{text}" if head else text, fmt):
                    at.append((name, k))
                    found.append(f)
            yield pd.DataFrame({"path": [a for a, _ in at], "place": [max(0, k - 1) for _, k in at], "lattice": [f.lattice for f in found], "energy": [f.energy for f in found], "symbols": [f.symbols for f in found], "positions": [f.positions for f in found]})

    return held.select("path", "place", "head", "text").mapInPandas(run, _ROW)


def _only_format(spark: SparkSession, path) -> str | None:
    """The format of all files by name, if they share one that can be told so; names alone are listed."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    short = F.when(name.contains("."), F.concat(F.lit("x."), F.substring_index(name, ".", -1))).otherwise(name)
    found = set()
    for row in spark.read.format("binaryFile").load(path).select(short.alias("name")).distinct().limit(100).collect():
        try:
            found.add(formats.format_of(row["name"]))
        except ValueError:
            found.add(None)
    return found.pop() if len(found) == 1 else None


def tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, atoms) of rows with one frame each; frames are numbered by file name and place."""
    numbers = rows.select("path", "place").withColumn("frame", (F.row_number().over(Window.orderBy("path", "place")) - 1).cast("long"))  # a narrow row for each frame
    held = rows.join(numbers, ["path", "place"])
    a, b, c = ([F.col("lattice")[3 * v + k] for k in range(3)] for v in range(3))
    det = a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    frames = held.select("frame", "path", *[F.col("lattice")[k].alias(n) for k, n in enumerate(LATTICE)], F.abs(det).alias("volume"), "energy")
    each = held.select("frame", F.posexplode(F.arrays_zip("symbols", "positions")).alias("k", "v"))
    atoms = each.select("frame", F.col("k").cast("long").alias("atom_id"), F.col("v.symbols").alias("element"), *[F.col("v.positions")[k].alias(n) for k, n in enumerate("xyz")])
    return frames, atoms


def read_structures(spark: SparkSession, path, fmt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames, atoms) of a file, folder or pattern, of single structures and trajectories alike.

    fmt: a name of formats.PARSERS; by default from each file's name and first lines. Where all files are of one format of CUTS,
    many tasks read one file, split at its lines; any other file is read whole, by one task. Frames without atoms are left out of split files."""
    kind = fmt or _only_format(spark, path)
    if kind in CUTS:
        return tables(_frames_of_lines(spark, path, kind).where(F.size("symbols") > 0))
    return tables(_frames_of_files(spark, path, fmt))


def list_formats() -> dict[str, tuple[str, ...]]:
    return {name: es for name, (_, es, _) in formats.PARSERS.items()}

"""Helpers of the corpus operators: shared storage, packed blocks, byte buffers and hashing."""

from __future__ import annotations

import atexit
import ctypes
import inspect
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python function works on at once; with 8-byte temporaries a worker stays under some 300 MB.
BLOCK_BYTES = 4 << 20

_OWN: dict = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where unset, in a local session (tests), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.TemporaryDirectory()
            atexit.register(_OWN["dir"].cleanup)
        base = f"file://{_OWN['dir'].name}"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the session's file system closes, or earlier by discard()."""
    path = f"{shared_folder(spark)}/lattisphere/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def discard(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written once to the shared folder and read back: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def parts_for(n_bytes: int, each: int, least: int = 1) -> int:
    return max(least, -(-n_bytes // each))


def bytes_array(column: pa.Array) -> pa.Array:
    """Null texts as empty ones, as large binary."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    return column.cast(pa.large_binary())


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, without copying, and their n + 1 offsets."""
    column = bytes_array(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES):
    """Row slices of a batch with at most so many bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def to_ipc(batch: pa.RecordBatch) -> bytes:
    """The batch as a compressed Arrow stream, without the bytes that a slice shares with others."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(payload: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(payload).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


BLOCKS = "block long, payload binary"


def packed(df: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """Rows of df (with a text column) in compressed blocks: block long, payload binary. Stage it before use: block numbers follow tasks."""

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        n = 0
        for batch in batches:
            for piece in slices(batch, most=most):
                if piece.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([first + n]), pa.array([to_ipc(piece)], pa.binary())], ["block", "payload"])
                    n += 1

    return df.mapInArrow(tidy(run), BLOCKS)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def give_back() -> None:
    """Hands freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def tidy(function):
    """A function for mapInArrow or applyInArrow that gives memory back after each call (a generator: after its last batch).

    Spark keeps workers for later stages; without this each keeps the most that any stage took."""
    if inspect.isgeneratorfunction(function):

        def run(batches):
            yield from function(batches)
            give_back()

    elif len(inspect.signature(function).parameters) == 1:

        def run(part):
            try:
                return function(part)
            finally:
                give_back()

    else:

        def run(one, other):
            try:
                return function(one, other)
            finally:
                give_back()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: list = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        n = max(n, 1 << 20)
        for k, b in enumerate((_BASE, inverse)):
            run = np.full(n, b, np.uint64)
            run[0] = 1
            _POWERS[k] = np.multiply.accumulate(run)
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], from prefix sums of a polynomial; equal bytes give equal hashes wherever they stand."""
    n = len(data)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) of each value, and n + 1 word offsets of the values."""
    n = len(data)
    solid = np.empty(n + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(_SPACE[data], out=solid[1:-1])
    begins, finishes = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    edges = offsets[1:-1]
    inner = edges[(edges > 0) & (edges < n)]
    begins[inner] |= solid[1:-1][inner]
    finishes[inner - 1] |= solid[1:-1][inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return _LOWER[data]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


#: Stands for a null doc_id where ids are compared: after all others.
LAST_ID = (1 << 63) - 1


def doc_ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), LAST_ID).to_numpy(zero_copy_only=False)


_PACKERS: dict[int, zstandard.ZstdCompressor] = {}
_UNPACKER = zstandard.ZstdDecompressor()


def squeeze(data: bytes, level: int = 1) -> bytes:
    """zstandard.compress by one compressor for each level and worker: a new one for each small piece takes longer than its work."""
    if level not in _PACKERS:
        _PACKERS[level] = zstandard.ZstdCompressor(level=level)
    return _PACKERS[level].compress(data)


def unsqueeze(packed: bytes) -> bytes:
    return _UNPACKER.decompress(packed)


def pack_planes(values: np.ndarray, level: int = 1) -> bytes:
    """Numbers as planes of their bytes, packed: planes of equal bytes take next to nothing."""
    width = values.dtype.itemsize
    flat = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width)
    return squeeze(np.ascontiguousarray(flat.T).tobytes(), level)


def unpack_planes(packed: bytes, kind) -> np.ndarray:
    flat = np.frombuffer(unsqueeze(packed), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


#: Rows that are gathered by block at once before they are shuffled.
HELD_ROWS = 1 << 21


def gathered(rows: DataFrame, kinds: dict[str, str], most: int = HELD_ROWS) -> DataFrame:
    """Rows (block, place, ...) gathered by block, `most` of them at a time: block and each column of kinds packed, in order of place (a column kept as differences).

    One row for each block that the rows name, so never more rows than there were."""

    def pack(held: list) -> pa.RecordBatch:
        columns = {c: np.concatenate([h[c] for h in held]) for c in ("block", *kinds)}
        order = np.lexsort((columns["place"], columns["block"]))
        columns = {c: v[order] for c, v in columns.items()}
        first = np.flatnonzero(np.concatenate([[True], columns["block"][1:] != columns["block"][:-1]]))
        out = [pa.array(columns["block"][first])]
        for c, kind in kinds.items():
            parts = np.split(columns[c].astype(kind), first[1:])
            out.append(pa.array([pack_planes(np.diff(x, prepend=x.dtype.type(0)) if c == "place" else x) for x in parts], pa.binary()))
        return pa.RecordBatch.from_arrays(out, ["block", *kinds])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", *kinds)})
                n += batch.num_rows
            if n >= most:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    return rows.select("block", *kinds).mapInArrow(tidy(run), ", ".join(["block long", *(f"{c} binary" for c in kinds)]))


def places_of(packed: bytes) -> np.ndarray:
    """The places that gathered() packed."""
    return np.cumsum(unpack_planes(packed, np.int32))


def without(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> list[bytes]:
    """Each value's bytes that are not gone."""
    kept = data[~gone]
    edges = np.concatenate([[0], np.cumsum(~gone)])[offsets]
    whole = kept.tobytes()
    return [whole[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def removed_runs(gone: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes gone and maximal runs of them in each value."""
    bytes_gone = np.diff(np.concatenate([[0], np.cumsum(gone)])[offsets])
    begin = gone.copy()
    begin[1:] &= ~gone[:-1]
    edges = offsets[:-1][offsets[:-1] < len(gone)]
    begin[edges] = gone[edges]
    return bytes_gone, np.diff(np.concatenate([[0], np.cumsum(begin)])[offsets])


def with_text(rows: pa.Table | pa.RecordBatch, texts: list[bytes]) -> list[pa.Array]:
    """The columns of rows with these texts; a null text stays null."""
    null = rows.column("text").is_null().to_pylist()
    own = pa.array([None if no else x.decode("utf-8", "replace") for x, no in zip(texts, null, strict=True)], pa.string())
    return [own if name == "text" else rows.column(name) for name in rows.schema.names]

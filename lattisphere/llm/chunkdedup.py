"""Substring dedup by content-defined chunks.

A gear hash that rolls over 16 bytes cuts every text at the least hash of each window of WINDOW places (winnowing; Schleimer et
al., 2003), never inside a character. So cuts depend on the bytes beside them alone, none is forced by position, and a passage of
2 WINDOW + 15 bytes (143) or more holds a whole chunk wherever it stands; only stretches of periods up to 8 bytes are not cut. A chunk is known by a 95-bit digest; an occurrence is a repeat if the same chunk also stands in a
document with a smaller doc_id. A run of repeats grows outward, byte by byte, as far as the text around its end chunks is the
text around the same chunk in the document with the least doc_id, and goes if it then has at least `least` bytes, which keeps
chance repeats of a few words where they are. So of a repeated passage the first document keeps it whole.

Documents travel in compressed blocks. A block names each of its chunks once, as a row of digest, least doc_id and place; a
window over the digest finds the least doc_id of all blocks, and only what a block does not know itself goes back to it, with
the block that holds it. For the end chunks of its runs a block then asks for the bytes beside them: up to CONTEXT bytes on
the run's side, at the first MOST_PLACES places of the chunk in the document with the least doc_id. The holder answers once for each
chunk, however many blocks ask, and a plain join brings the answers to them. So rows exchanged grow with the text, not with
blocks times buckets, and a chunk in every document has one row for each block.

Null texts stay null and have no bytes; an empty text has no chunks; repeats inside one document, or between rows of the
same doc_id, stay; a null doc_id counts as larger than all others. All columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import buffer_of, doc_ids, from_ipc, gathered, mix, packed, places_of, ragged, removed_runs, staged, tidy, unpack_planes, with_text, without

WINDOW, LEAST_RUN = 64, 100  # WINDOW: a power of two
CONTEXT, MOST_PLACES = 256, 4
#: Windows that are searched at once.
AT_ONCE = 1 << 16
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the chunks of each value: after the least hash of each window, of equal ones the last. Windows are taken AT_ONCE at a time, which fit the cache."""
    n, sizes = len(data), np.diff(offsets)
    head = np.zeros(n, bool)
    head[ragged(offsets[:-1], np.minimum(sizes, 15))] = True  # these hashes reach into the text before
    inside = np.ones(n, bool)  # starts of windows that are inside one text
    inside[ragged(np.maximum(offsets[:-1], offsets[1:] - WINDOW + 1), np.minimum(sizes, WINDOW - 1))] = False
    begin = np.zeros(n, bool)
    begin[offsets[:-1][sizes >= WINDOW]] = True
    cut = np.zeros(n + 1, bool)
    for at in range(0, n - WINDOW + 1, AT_ONCE):
        low = max(0, at - 24)  # one window before, 8 hashes before that, and 15 bytes that reach into the first of them
        high = min(n, at + AT_ONCE + WINDOW - 1)
        h, bad = _hashes(data[low : high + 1], high - low)
        bad |= head[low:high]
        h[bad] = 0xFFFFFFFF
        least, step = h, 1
        while step < WINDOW:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        skip = at - low
        rises = np.ones(len(least) - skip, bool)  # the least hash has left the window, or the window is the first
        np.greater(least[max(1, skip) :], least[max(1, skip) - 1 : -1], out=rises[skip == 0 :])
        own = slice(at, at + len(rises))
        rises |= begin[own]
        rises &= inside[own]
        cut[at + WINDOW : at + WINDOW + len(rises)] |= (h[skip + WINDOW - 1 :] == least[skip:]) & inside[own] & ~bad[skip + WINDOW - 1 :]  # it has just come in
        places = np.flatnonzero(rises) + (skip + WINDOW - 1)
        back = np.ascontiguousarray(h[::-1])
        places -= np.lib.stride_tricks.sliding_window_view(back, WINDOW)[len(h) - 1 - places].argmin(axis=1)
        cut[low + 1 + places[~bad[places]]] = True
    cut[offsets[1:][sizes > 0]] = True
    cut[0] = False
    return np.flatnonzero(cut)


def _hashes(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rolling hash at each of the first n places, and where none may cut."""
    h = _GEAR[data[:n]]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint32(step)
    bad = np.zeros(n, bool)
    bad[: len(data) - 1] = (data[1:] & 0xC0) == 0x80
    for period in range(1, 9):  # equal hashes side by side would cut at each of them
        bad[period:] |= h[period:] == h[:-period]
    return h, bad


class Chunks:
    """The chunks of a block: ends, digests (two numbers each), and the row of each."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = buffer_of(texts)
        self.ends = chunk_ends(self.data, self.offsets)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)[: len(self.ends)]
        whole, digest = memoryview(self.data.tobytes()), xxhash.xxh3_128_digest
        each = b"".join([digest(whole[a:b]) for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)])
        self.digests = np.frombuffer(each, np.uint64).reshape(-1, 2) & np.array([0xFFFFFFFFFFFFFFFF, 0x7FFFFFFF], np.uint64)
        self.rows = np.searchsorted(self.offsets, self.starts, "right") - 1

    def distinct(self, ids: np.ndarray):
        """Distinct digests in order, the least id of each, and the place of each chunk's digest."""
        d, own = self.digests, ids[self.rows]
        order = np.argsort(d[:, 0])
        if _mixed(d[order]):  # of two digests with one first number the second must tell
            order = np.lexsort((d[:, 1], d[:, 0]))
        d = d[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]).any(axis=1)
        place = np.empty(len(d), np.int64)
        place[order] = np.cumsum(new) - 1
        return d[new], np.minimum.reduceat(own[order], np.flatnonzero(new)) if len(d) else own, place


def _mixed(d: np.ndarray) -> bool:
    """Whether two rows side by side have the first number in common, but not the second."""
    return bool(((d[1:, 0] == d[:-1, 0]) & (d[1:, 1] != d[:-1, 1])).any())


def _told(blocks: DataFrame) -> DataFrame:
    """For each block the places, among its distinct digests, of those that have a smaller doc_id elsewhere, that id and the block that holds it.

    A row for each distinct digest of a block, so the exchange grows with the text alone; a chunk of every text has a row for each block."""

    def run(batches):
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                rows = from_ipc(payload.as_py())
                d, least, _ = Chunks(rows.column("text")).distinct(doc_ids(rows.column("doc_id")))
                d = d.view(np.int64)
                for at in range(0, len(d), 1 << 16):
                    own = slice(at, min(len(d), at + (1 << 16)))
                    yield pa.RecordBatch.from_arrays([pa.array(d[own, 0]), pa.array(d[own, 1].astype(np.int32)), pa.array(least[own]), pa.array(np.full(own.stop - at, block)), pa.array(np.arange(at, own.stop, dtype=np.int32))], ["d1", "d2", "least", "block", "place"])

    asked = blocks.mapInArrow(tidy(run), "d1 long, d2 int, least long, block long, place int")
    first = asked.withColumn("first", F.min(F.struct("least", "block")).over(Window.partitionBy("d1", "d2"))).where("first.least < least")
    return gathered(first.select("block", "place", F.col("first.least").alias("least"), F.col("first.block").alias("source")), {"place": "i4", "least": "i8", "source": "i8"})


class Repeats:
    """The repeated chunks of a block, by what the buckets told it, and the ends of their runs."""

    def __init__(self, block: int, rows: pa.RecordBatch, told: pa.Table):
        ids = doc_ids(rows.column("doc_id"))
        self.chunks = Chunks(rows.column("text"))
        _, least, self.place = self.chunks.distinct(ids)
        least, source = least.copy(), np.full(len(least), block)
        for places, values, holders in zip(*(told.column(c).to_pylist() for c in ("place", "least", "source")), strict=True):
            at = places_of(places)
            least[at], source[at] = unpack_planes(values, np.int64), unpack_planes(holders, np.int64)
        self.least, self.source = least[self.place], source[self.place]
        rows_of = self.chunks.rows
        self.dup = ids[rows_of] > self.least
        joined = np.zeros(len(self.dup) + 1, bool)  # with the chunk before
        joined[1:-1] = self.dup[1:] & self.dup[:-1] & (rows_of[1:] == rows_of[:-1])
        self.first, self.last = np.flatnonzero(self.dup & ~joined[:-1]), np.flatnonzero(self.dup & ~joined[1:])

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """The chunks to ask for, the outer two at each end of each run, and the side (0: left, 1: right) to ask of each."""
        inner = self.first < self.last
        left, right = (np.concatenate([outer, outer[inner] + step]) for outer, step in ((self.first, 1), (self.last, -1)))
        return np.concatenate([left, right]), np.repeat([0, 1], [len(left), len(right)])

    def gone(self, contexts: dict, least_run: int) -> np.ndarray:
        """The bytes to remove; contexts: the bytes beside each place of a digest, by side."""
        data, offsets, starts, ends = self.chunks.data, self.chunks.offsets, self.chunks.starts, self.chunks.ends
        whole, rows, digests, out = data.tobytes(), self.chunks.rows, self.chunks.digests.view(np.int64), np.zeros(len(data), bool)
        for a, b in zip(self.first.tolist(), self.last.tolist(), strict=True):
            low, high, row = int(starts[a]), int(ends[b]), int(rows[a])
            begin, end = int(offsets[row]), int(offsets[row + 1])
            for k in range(a, min(a + 2, b + 1)):
                for left in contexts.get((*digests[k].tolist(), 0), ()):
                    at = int(starts[k])
                    low = min(low, at - common_end(whole[max(begin, at - CONTEXT) : at], left))
            for k in range(max(a, b - 1), b + 1):
                for right in contexts.get((*digests[k].tolist(), 1), ()):
                    at = int(ends[k])
                    high = max(high, at + common_start(whole[at : min(end, at + CONTEXT)], right))
            while low < starts[a] and data[low] & 0xC0 == 0x80:  # whole characters only
                low += 1
            while high > ends[b] and high < end and data[high] & 0xC0 == 0x80:
                high -= 1
            if high - low >= least_run:
                out[low:high] = True
        return out


def common_start(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n  # x[:low] is common, x[:high] is not
    while high - low > 1:
        k = (low + high) // 2
        low, high = (k, high) if x[low:k] == y[low:k] else (low, k)
    return low


def common_end(x: bytes, y: bytes) -> int:
    return common_start(x[::-1], y[::-1])


def _contexts(told: pa.Table) -> dict:
    """The bytes beside the places of each digest, by digest and side."""
    return {(d1, d2, side): beside for d1, d2, side, beside in zip(*(told.column(c).to_pylist() for c in ("d1", "d2", "side", "beside")), strict=True)}


def dedup(docs: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """All columns of docs, text without its repeated passages, and n_bytes (before), n_removed, n_spans."""
    docs = docs.drop("n_bytes", "n_removed", "n_spans")
    blocks, _ = staged(packed(docs.withColumn("doc_id", F.col("doc_id").cast("long"))), "blocks")
    told, _ = staged(_told(blocks), "told")

    def ask(held: pa.Table, told: pa.Table) -> pa.Table:
        found = Repeats(held.column("block")[0].as_py(), from_ipc(held.column("payload")[0].as_py()), told)
        ends, side = found.ends()
        digests = found.chunks.digests[ends].view(np.int64)
        each = pa.table({"holder": found.source[ends], "d1": np.ascontiguousarray(digests[:, 0]), "d2": digests[:, 1].astype(np.int32), "least": found.least[ends], "side": side.astype(np.int32)})
        each = each.group_by(each.column_names).aggregate([])
        return each.append_column("block", pa.repeat(held.column("block")[0], each.num_rows)).select(["holder", "d1", "d2", "least", "side", "block"])

    asking, _ = staged(blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(tidy(ask), "holder long, d1 long, d2 int, least long, side int, block long"), "asked")
    wanted = asking.select("holder", "d1", "d2", "least", "side").distinct()  # however many ask, a holder answers once for each of its chunks

    def reply(held: pa.Table, asked: pa.Table) -> pa.Table:
        found: dict = {}
        if held.num_rows and asked.num_rows:
            rows = from_ipc(held.column("payload")[0].as_py())
            ids, chunks = doc_ids(rows.column("doc_id")), Chunks(rows.column("text"))
            whole, offsets, starts, ends = chunks.data.tobytes(), chunks.offsets.tolist(), chunks.starts.tolist(), chunks.ends.tolist()
            for name in zip(*(asked.column(c).to_pylist() for c in ("d1", "d2", "least", "side")), strict=True):
                found[name] = []
            digests = chunks.digests.view(np.int64)
            for k, (d1, d2, i, row) in enumerate(zip(digests[:, 0].tolist(), digests[:, 1].tolist(), ids[chunks.rows].tolist(), chunks.rows.tolist(), strict=True)):
                left, right = found.get((d1, d2, i, 0)), found.get((d1, d2, i, 1))
                if left is not None and len(left) < MOST_PLACES:
                    left.append(whole[max(offsets[row], starts[k] - CONTEXT) : starts[k]])
                if right is not None and len(right) < MOST_PLACES:
                    right.append(whole[ends[k] : min(offsets[row + 1], ends[k] + CONTEXT)])
        columns = list(zip(*found, strict=True)) or [(), (), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(list(found.values()), pa.list_(pa.binary()))], names=["d1", "d2", "side", "beside"])

    replies = blocks.groupBy("block").cogroup(wanted.groupBy("holder")).applyInArrow(tidy(reply), "d1 long, d2 int, side int, beside array<binary>")
    given = asking.select("block", "d1", "d2", "side").join(replies, ["d1", "d2", "side"])  # a chunk that many blocks ask for is a skewed key of a plain join
    told_all = told.unionByName(given, allowMissingColumns=True)

    def finish(held: pa.Table, told: pa.Table) -> pa.Table:
        rows = from_ipc(held.column("payload")[0].as_py())
        is_place = told.column("side").is_null()
        found = Repeats(held.column("block")[0].as_py(), rows, told.filter(is_place))
        chunks, gone = found.chunks, found.gone(_contexts(told.filter(pc.invert(is_place))), least_run)
        n_removed, n_spans = removed_runs(gone, chunks.offsets)
        columns = with_text(rows, without(chunks.data, chunks.offsets, gone))
        return pa.table([*columns, pa.array(np.diff(chunks.offsets)), pa.array(n_removed), pa.array(n_spans)], names=[*rows.schema.names, "n_bytes", "n_removed", "n_spans"])

    fields = ", ".join(f"`{f.name}` {'long' if f.name == 'doc_id' else f.dataType.simpleString()}" for f in docs.schema)
    return blocks.groupBy("block").cogroup(told_all.groupBy("block")).applyInArrow(tidy(finish), f"{fields}, n_bytes long, n_removed long, n_spans long")


def keep_deduped(docs: DataFrame) -> DataFrame:
    """The documents without their repeated passages, with their own columns; n_chars follows the text, and a document of which nothing is left goes."""
    clash = {c: f"__{c}" for c in ("n_bytes", "n_removed", "n_spans") if c in docs.columns}
    found = dedup(docs.withColumnsRenamed(clash)).where("n_removed < n_bytes or n_bytes = 0")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.select(*[F.col(clash[c]).alias(c) if c in clash else c for c in docs.columns])

"""BPE encoding and decoding by a table of distinct words.

Spark splits the texts into words, block by block; each block names its distinct words once and keeps, for every position,
the rank of its word. The words of all blocks meet in buckets by hash, where each distinct word is encoded once; the ids
go back to the blocks, where they join the positions, and an id-to-piece join gives the decoded text. What is shuffled is
each block's distinct words and the packed ranks, so a word in every text weighs no more than a rare one. Each block sends one
packed row to each bucket that it has words for, at most one row for each of its distinct words. (A row for each distinct word of
a block, sorted by word, needs no buckets, but a block of 12 MB has some 190,000 of them, and such rows took twice the disk.)

Null and empty texts, and texts of white space only, have no ids and decode to the empty text. Every row gives one row,
repeated or null doc_id or not; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import buffer_of, parts_for, slices, span_hashes, staged, text_bytes, tidy
from .wordbpe import coder

#: Text that shares one table of words, and text for each bucket of words.
BLOCK_TEXT, BUCKET_TEXT = 12 << 20, 32 << 20
#: Words that are joined to their ids and pieces at once, whole texts at a time.
WORDS_AT_ONCE = 1 << 17


def _planes(ranks: np.ndarray, level: int = 3) -> bytes:
    """Ranks as three planes of bytes, packed: common words have small ranks, so the upper planes are nearly all zero."""
    flat = np.ascontiguousarray(ranks.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return zstandard.compress(np.ascontiguousarray(flat.T).tobytes(), level)


def _ranks(packed: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(packed), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel()


_KIND = "block long, bucket int, ids array<long>, counts array<int>, packed binary"


def _split(docs: DataFrame, path: str, buckets: int, most: int) -> DataFrame:
    """Rows of two kinds: bucket -1 holds a block's ids, words of each text and ranks; the others its distinct words of that bucket, in rank order."""

    def run(batches):
        first, n, tool = TaskContext.get().partitionId() << 32, 0, coder(path)
        for batch in batches:
            for piece in slices(batch, most=most):
                coded, counts = tool.split(piece.column("text"))
                codes, words = coded.indices.to_numpy(), coded.dictionary
                data, offsets = buffer_of(words)
                home = (span_hashes(data, offsets[:-1], offsets[1:]) % np.uint64(buckets)).astype(np.int64)
                seen = np.bincount(codes, minlength=len(words))
                order = np.lexsort((-seen, home))  # by bucket, in each the commonest first
                rank_in = np.empty(len(words), np.int64)
                sizes = np.bincount(home, minlength=buckets)
                rank_in[order] = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                rank = np.empty(len(words), np.int64)
                rank[np.lexsort((home, rank_in))] = np.arange(len(words))
                block = first + n
                n += 1
                rows = [(block, -1, piece.column("doc_id").to_pylist(), counts.tolist(), _planes(rank[codes]))]
                listed = words.take(pa.array(order)).to_pylist()
                ends = np.cumsum(sizes)
                for k in np.flatnonzero(sizes):
                    own = listed[ends[k] - sizes[k] : ends[k]]
                    at = rank[order[ends[k] - sizes[k] : ends[k]]]
                    rows.append((block, int(k), None, None, zstandard.compress("\n".join(own).encode(), 3) + _tail(_planes(np.diff(at, prepend=0)))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()), strict=True)], ["block", "bucket", "ids", "counts", "packed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), _KIND)


def _tail(blob: bytes) -> bytes:
    return blob + len(blob).to_bytes(8, "little")


def _two(packed: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(packed[-8:], "little")
    return packed[: -8 - n], packed[-8 - n : -8]


def _words(packed: bytes) -> tuple[list[str], bytes]:
    words, ranks = _two(packed)
    return zstandard.decompress(words).decode().split("\n"), ranks


def _encode_words(words: DataFrame, path: str) -> DataFrame:
    """For each block and bucket the ids of its words; a distinct word is encoded once."""

    def run(part: pa.Table) -> pa.Table:
        tool, known, out = coder(path), {}, []
        for packed in part.column("packed"):
            own, ranks = _words(packed.as_py())
            ids = [known[w] if w in known else known.setdefault(w, array("I", tool.encode(w)).tobytes()) for w in own]
            sizes = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
            out.append(_tail(ranks) + _tail(_planes(sizes)) + _tail(_planes(np.frombuffer(b"".join(ids), "<u4"))))
        return pa.table({"block": part.column("block"), "coded": pa.array(out, pa.binary())})

    return words.groupBy("bucket").applyInArrow(tidy(run), "block long, coded binary")


def _table_of(coded: list[bytes]) -> list[np.ndarray]:
    """Ids of a block's words by rank."""
    ids: dict[int, np.ndarray] = {}
    for blob in coded:
        rest, flat = _two(blob)
        ranks, sizes = map(_ranks, (_two(rest)[0][:-8], _two(rest)[1]))
        ids.update(zip(np.cumsum(ranks).tolist(), np.split(_ranks(flat), np.cumsum(sizes)[:-1]), strict=True))
    return [ids[k] for k in range(len(ids))]


def encode_decode(docs: DataFrame, path: str, block_text: int = BLOCK_TEXT, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian 32-bit ids), decoded_sha256; extra: also ids, decoded."""
    buckets = parts_for(text_bytes(docs), BUCKET_TEXT, 32)
    held, _ = staged(_split(docs, path, buckets, block_text), "words")
    coded = _encode_words(held.where("bucket >= 0").select("block", "bucket", "packed"), path)
    blocks = held.where("bucket < 0").select("block", "ids", "counts", "packed")
    kinds = {"ids": "array<int>", "decoded": "string"}
    fields = ", ".join(["doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", *(f"{c} {kinds[c]}" for c in kinds if c in extra)])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _arrow(extra).empty_table()
        tool = coder(path)
        words = _table_of(right.column("coded").to_pylist())
        pieces = _pieces(tool)
        shown = [b" ".join([pieces[i] for i in w.tolist()]) for w in words]  # the id-to-piece join
        shown = pa.array([x + b" " if x else x for x in shown], pa.large_binary())
        plain = pa.array([w.tobytes() for w in words], pa.large_binary())
        del words
        out, all_ids, all_text = [], [], []
        for doc_ids, counts, packed in zip(left.column("ids").to_pylist(), left.column("counts").to_pylist(), left.column("packed").to_pylist(), strict=True):
            ranks, edges = _ranks(packed), np.cumsum([0, *counts])
            for first, last in _runs(edges, WORDS_AT_ONCE):
                base = edges[first]
                asked = pa.array(ranks[base : edges[last]])
                ids, at = buffer_of(plain.take(asked))
                text, at_text = buffer_of(shown.take(asked))
                for k in range(first, last):
                    a, b = edges[k] - base, edges[k + 1] - base
                    own, own_text = ids[at[a] : at[b]], text[at_text[a] : at_text[b]][:-1]
                    out.append((doc_ids[k], len(own) // 4, hashlib.sha256(own).hexdigest(), hashlib.sha256(own_text).hexdigest()))
                    if "ids" in extra:
                        all_ids.append(own)
                    if "decoded" in extra:
                        all_text.append(own_text)
        schema = _arrow(extra)
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=False)]
        if "ids" in extra:
            ends = np.cumsum([0, *(len(x) // 4 for x in all_ids)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(all_ids).view("<i4"))))
        if "decoded" in extra:
            columns.append(pa.array([x.tobytes().decode() for x in all_text], pa.string()))
        return pa.table(columns, schema=schema)

    return blocks.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(tidy(join), fields)


def _runs(edges: np.ndarray, most: int):
    """First and last (not included) texts of runs of at most so many words, or one text; edges: where each text's words begin."""
    first, n = 0, len(edges) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + most, "right")) - 1)
        yield first, last
        first = last


def _pieces(tool) -> list[bytes]:
    if not hasattr(tool, "pieces"):
        vocabulary = tool.tokenizer.get_vocab(with_added_tokens=True)
        tool.pieces = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            tool.pieces[i] = piece.encode()
    return tool.pieces


def _arrow(extra: tuple[str, ...]) -> pa.Schema:
    more = {"ids": pa.list_(pa.int32()), "decoded": pa.string()}
    return pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *((c, more[c]) for c in more if c in extra)])

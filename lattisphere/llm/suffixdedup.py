"""Exact substring dedup by suffix arrays that are built by two-stage sorting.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id. Texts are too many
for one suffix array, so equal strings first meet in one place. In every string of LENGTH bytes one run of GRAM bytes has the
least hash; equal strings choose equal runs, so the hash of the chosen run is a key under which all copies of a string meet.
Blocks of documents name their keys, one row each; strings whose key two or more documents have are candidates. They go, as
short snippets of text with the least doc_id that the block has for them, to the bucket of their key: one row for each block
and bucket, so at most one for each candidate.

A bucket holds its distinct snippets in one buffer and sorts the candidate suffixes in two stages (Itoh and Tanaka, 1999):
suffixes smaller than their successors are sorted directly, on LENGTH bytes; a scan of the byte buckets in ascending order
induces the rest. Neighbours with a common prefix of LENGTH bytes are one string, whose least doc_id goes back to the blocks.

Null texts count as empty; a null doc_id counts as larger than all others; rows of one doc_id do not count against each
other. Every row gives one row; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import LAST_ID, buffer_of, doc_ids, from_ipc, gathered, mix, pack_planes, packed, parts_for, places_of, ragged, removed_runs, squeeze, staged, text_bytes, tidy, unpack_planes, unsqueeze, without

LENGTH, GRAM, BLOCK_TEXT, BUCKET_TEXT = 50, 16, 2 << 20, 4 << 20
KEY_BITS = 48


#: Places that are hashed at once, so that all temporaries stay in a core's cache.
AT_ONCE = 1 << 15


def words_view(data: np.ndarray, big: bool = False, more: int = 8) -> np.ndarray:
    """A view of padded bytes: at each byte the 64-bit number of the 8 bytes from there on, zeros beyond the end. `more` zeros stand behind."""
    held = np.zeros(len(data) + more, np.uint8)
    held[: len(data)] = data
    return np.ndarray((len(held) - 7,), ">u8" if big else "<u8", held, strides=(1,))


def words_at(data: np.ndarray, big: bool = False) -> np.ndarray:
    """At each byte the 64-bit number of the 8 bytes from there on, zeros beyond the end."""
    return words_view(data, big)[: len(data)].astype(np.uint64)


def gram_hashes(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of runs of bytes, by their first and last 8 bytes."""
    x = first * np.uint64(0x9DDFEA08EB382D69)
    x += last * np.uint64(0xC2B2AE3D27D4EB4F)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def span_words(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Spans of 8 bytes or more as 64-bit numbers, the last one back from the end: which spans reach so far, and the place of their number."""
    for at in range(0, int(sizes.max(initial=0)), 8):
        own = np.flatnonzero(sizes > at)
        yield own, starts[own] + np.minimum(at, sizes[own] - 8)


def merged(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal spans (of one home) as one, in order of home: an index of each, the place of every span among them, and their least ids.

    Equal hashes are compared as bytes. Spans whose hashes meet by chance may leave equal ones apart, which costs a row and no result."""
    h = sizes.astype(np.uint64)
    for own, at in span_words(words, starts, sizes):
        h[own] = mix((h[own] ^ words[at]) * np.uint64(0x9E3779B97F4A7C15))
    if home is not None:
        h = (home.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
    order = np.argsort(h, kind="stable")
    a, b = order[1:], order[:-1]
    same = np.flatnonzero((h[a] == h[b]) & (sizes[a] == sizes[b]))
    a, b = a[same], b[same]
    equal = np.ones(len(same), bool)
    for own, at in span_words(words, starts[a], sizes[a]):
        equal[own] &= words[at] == words[at + (starts[b] - starts[a])[own]]
    new = np.ones(len(order), bool)
    new[same[equal] + 1] = False
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new)) if len(order) else ids
    return order[new], place, least


class Grams:
    """The candidate machinery of one block: the run of GRAM bytes that each string chooses, the runs' keys, and the neighbouring strings that chose one run."""

    def __init__(self, texts: pa.Array, ids: np.ndarray, length: int, gram: int):
        self.data, self.offsets = buffer_of(texts)
        self.ids, self.length, self.gram = ids, length, gram
        self.words = words_view(self.data)
        n, window = len(self.data), length - gram + 1
        inside = np.ones(n, bool)  # strings inside one document
        ends, tails = self.offsets[1:], np.minimum(np.diff(self.offsets), length - 1)
        inside[ragged(ends - tails, tails)] = False
        picks, starts, ranks, total, last = [], [], [], 0, -1
        for a in range(0, n - length + 1, AT_ONCE):
            b = min(a + AT_ONCE, n - length + 1)
            grams = b - a + window - 1
            w = self.words[a : a + grams + gram - 8].astype(np.uint64)
            least = gram_hashes(w[:grams], w[gram - 8 :])
            least &= np.uint64(0xFFFFFFFF00000000)
            least |= np.arange(a, a + grams, dtype=np.uint64)
            size = 1
            while 2 * size <= window:  # minima of 2, 4, 8 ... neighbours
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            if window > size:
                least = np.minimum(least[: len(least) - (window - size)], least[window - size :])
            own = np.flatnonzero(inside[a:b])
            if not len(own):
                continue
            chosen = (least[own] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            new = np.flatnonzero(np.diff(chosen, prepend=last))
            picks.append(chosen[new])
            starts.append(own[new] + a)
            ranks.append(new + total)
            total, last = total + len(own), chosen[-1]
        # strings of two documents never choose one run, so those that chose one are neighbours
        self.picks, self.starts = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (picks, starts))
        self.counts = np.diff(np.concatenate([*ranks, [total]]))
        self.keys = gram_hashes(self.words[self.picks].astype(np.uint64), self.words[self.picks + gram - 8].astype(np.uint64))

    def distinct(self):
        """Keys in order, whether two of the block's documents have them, and each pick's place."""
        own = self.ids[np.searchsorted(self.offsets, self.picks, "right") - 1]
        order = np.argsort(self.keys)
        k, own = self.keys[order], own[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        rank = np.cumsum(new) - 1
        place = np.empty(len(k), np.int64)
        place[order] = rank
        local = np.zeros(int(new.sum()), bool)
        local[rank[1:][~new[1:] & (own[1:] != own[:-1])]] = True
        return k[new], local, place

    def snippets(self, known: np.ndarray, place: np.ndarray, buckets: int):
        """Candidate strings as runs of neighbouring starts with one chosen run: starts, lengths and bucket of each."""
        good = np.flatnonzero(known[place])
        home = (self.keys[good] % np.uint64(buckets)).astype(np.int64)
        good = good[np.argsort(home, kind="stable")]
        return self.starts[good], self.counts[good], np.sort(home)


def sorted_by(places: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Places in the order of their keys, the first one first; each further key sorts only what the ones before left equal."""
    out = places
    at = group = None
    for k in keys:
        v = k[out if at is None else out[at]].astype(np.uint64)
        order = np.argsort(v) if at is None else np.lexsort((v, group))
        v = v[order]
        new = np.ones(len(v) + 1, bool)
        new[1:-1] = v[1:] != v[:-1]
        if at is None:
            out, at = out[order], np.arange(len(out))
        else:
            out[at] = out[at[order]]
            new[1:-1] |= group[1:] != group[:-1]
        tied = np.flatnonzero(~(new[:-1] & new[1:]))
        if not len(tied):
            break
        at, group = at[tied], (np.cumsum(new[:-1]))[tied]
    return out


def two_stage_order(data: np.ndarray, wanted: np.ndarray, depth: int, keys: list[np.ndarray]) -> np.ndarray:
    """The wanted suffixes (a mask over data) in the order of their first `depth` bytes. keys: for each place the big-endian words of those bytes."""
    n = len(data)
    smaller = np.zeros(n, bool)
    smaller[:-1] = data[:-1] < data[1:]
    alike = data[:-1] == data[1:]
    ends = np.flatnonzero(~alike)  # a run of one byte is as its end; the last run's suffixes are not smaller
    inner = np.flatnonzero(alike[: ends[-1] if len(ends) else 0])
    smaller[inner] = smaller[ends[np.searchsorted(ends, inner)]]
    # a suffix that is not smaller is induced from its successors, up to one that is
    need = wanted.copy()
    at = np.flatnonzero(wanted & ~smaller) + 1
    while len(at):
        at = at[at < n]
        at = at[~need[at]]
        need[at] = True
        at = at[~smaller[at]] + 1
    direct = sorted_by(np.flatnonzero(need & smaller), keys)
    edges = np.searchsorted(data[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induce_from = need & ~smaller

    def induce(places: np.ndarray) -> None:
        before = places[places > 0] - 1
        before = before[induce_from[before]]
        if len(before):
            lead = data[before]
            before = before[np.argsort(lead, kind="stable")]
            lead = data[before]
            cuts = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]]))
            for k, part in zip(lead[cuts].tolist(), np.split(before, cuts[1:]), strict=True):
                induced[k].append(part)

    if n and induce_from[n - 1]:
        induced[data[n - 1]].append(np.array([n - 1]))
    out = []
    for byte in range(256):
        k = 0
        while k < len(induced[byte]):  # grows while it is read: runs of one byte
            k, places = len(induced[byte]), np.concatenate(induced[byte][k:])
            induce(places)
        own = direct[edges[byte] : edges[byte + 1]]
        induce(own)
        out += [*induced[byte], own]
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def least_ids(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For every string (counts[i] of them from starts[i] on, with id ids[i]) the least id among its equals, in order."""
    places = ragged(starts, counts)
    wanted = np.zeros(len(data), bool)
    wanted[places] = True
    words = words_view(data, big=True, more=length + 8)
    # the last 8 bytes overlap those before, which are equal where they count
    keys = [words[k : k + len(data)] for k in [*range(0, length - 8, 8), length - 8]]
    order = two_stage_order(data, wanted, length, keys)
    new = np.ones(len(order), bool)  # a common prefix with the neighbour before that is shorter than the length
    same = np.arange(1, len(order))
    for k in keys:
        same = same[k[order[same]] == k[order[same - 1]]]
    new[same] = False
    own = np.full(len(data), LAST_ID)
    own[places] = np.repeat(ids, counts)
    least = np.empty(len(data), np.int64)
    if len(order):
        least[order] = np.minimum.reduceat(own[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return least[places]


def _shared_keys(blocks: DataFrame, length: int, gram: int) -> DataFrame:
    """For each block the places of its keys that another block has too, packed, in several rows.

    A row for each distinct key of a block is exchanged, of KEY_BITS bits: a chance match only makes a candidate more. What goes
    back is gathered by block."""

    def run(batches):
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                rows = from_ipc(payload.as_py())
                keys, _, _ = Grams(rows.column("text"), doc_ids(rows.column("doc_id")), length, gram).distinct()
                keys = (keys >> np.uint64(64 - KEY_BITS)).view(np.int64)
                for at in range(0, len(keys), 1 << 16):
                    own = keys[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), block)), pa.array(np.arange(at, at + len(own), dtype=np.int32))], ["key", "block", "place"])

    asked = blocks.mapInArrow(tidy(run), "key long, block long, place int")
    shared = asked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1").select("block", "place")
    return gathered(shared, {"place": "i4"})


def _known(told: pa.Table, local: np.ndarray) -> np.ndarray:
    """Which of a block's keys two or more documents have."""
    known = local.copy()
    for packed in told.column("place").drop_null().to_pylist():
        known[places_of(packed)] = True
    return known


class _Asked:
    """A block's candidate snippets, each distinct one once, by bucket."""

    def __init__(self, held: pa.Table, told: pa.Table, buckets: int, length: int, gram: int):
        self.rows = from_ipc(held.column("payload")[0].as_py())
        ids = doc_ids(self.rows.column("doc_id"))
        g = self.grams = Grams(self.rows.column("text"), ids, length, gram)
        _, local, place = g.distinct()
        self.starts, self.counts, self.home = g.snippets(_known(told, local), place, buckets)
        self.row = np.searchsorted(g.offsets, self.starts, "right") - 1
        self.first, self.place, self.ids = merged(g.words, self.starts, self.counts + length - 1, ids[self.row], self.home)
        self.edges = np.searchsorted(self.home[self.first], np.arange(buckets + 1))


def _strings(blocks: DataFrame, told: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    def run(held: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if held.num_rows:
            asked = _Asked(held, answers, buckets, length, gram)
            block = held.column("block")[0].as_py()
            for bucket in np.flatnonzero(np.diff(asked.edges)):
                own = asked.first[asked.edges[bucket] : asked.edges[bucket + 1]]
                text = asked.grams.data[ragged(asked.starts[own], asked.counts[own] + length - 1)]
                out.append((int(bucket), block, pack_planes(asked.counts[own].astype(np.uint32)), pack_planes(asked.ids[asked.edges[bucket] : asked.edges[bucket + 1]]), squeeze(text.tobytes(), 3)))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["bucket", "block", "counts", "ids", "text"])

    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(tidy(run), "bucket int, block long, counts binary, ids binary, text binary")


def _resolved(strings: DataFrame, length: int) -> DataFrame:
    """For each block and bucket the least doc_id of each of its strings."""

    def run(part: pa.Table) -> pa.Table:
        each = [unpack_planes(x, np.uint32).astype(np.int64) for x in part.column("counts").to_pylist()]
        counts = np.concatenate(each)
        ids = np.concatenate([unpack_planes(x, np.int64) for x in part.column("ids").to_pylist()])
        data = np.frombuffer(b"".join(map(unsqueeze, part.column("text").to_pylist())), np.uint8)
        sizes = counts + length - 1
        starts = np.cumsum(sizes) - sizes
        # snippets that several blocks sent are sorted once, with their least id
        first, place, ids = merged(words_view(data), starts, sizes, ids)
        own = data[ragged(starts[first], sizes[first])]
        own_starts = np.cumsum(sizes[first]) - sizes[first]
        least = least_ids(own, own_starts, counts[first], ids, length)
        at = np.cumsum(counts[first]) - counts[first]
        whole = least[ragged(at[place], counts)]
        ends = np.cumsum([x.sum() for x in each])
        out = [pack_planes(x) for x in np.split(whole, ends[:-1])]
        return pa.table({"block": part.column("block"), "bucket": part.column("bucket"), "least": pa.array(out, pa.binary())})

    return strings.groupBy("bucket").applyInArrow(tidy(run), "block long, bucket int, least binary")


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row (with_text: and the kept bytes)."""
    buckets = parts_for(text_bytes(docs), BUCKET_TEXT, 32)
    blocks, _ = staged(packed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), BLOCK_TEXT), "blocks")
    told, _ = staged(_shared_keys(blocks, length, gram), "shared")
    least = _resolved(_strings(blocks, told, buckets, length, gram), length)
    both = told.unionByName(least, allowMissingColumns=True)
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_text

    def finish(held: pa.Table, answers: pa.Table) -> pa.Table:
        asked = _Asked(held, answers, buckets, length, gram)
        data, offsets = asked.grams.data, asked.grams.offsets
        counts = asked.counts[asked.first]
        at = np.cumsum(counts) - counts
        values = np.full(int(counts.sum()), LAST_ID)
        edges = np.concatenate([at, [len(values)]])[asked.edges]
        told = answers.filter(answers.column("least").is_valid())
        for bucket, own in zip(told.column("bucket").to_pylist(), told.column("least").to_pylist(), strict=True):
            values[edges[bucket] : edges[bucket + 1]] = unpack_planes(own, np.int64)
        places = ragged(asked.starts, asked.counts)
        least_of = values[ragged(at[asked.place], asked.counts)]
        own_ids = np.repeat(asked.grams.ids[asked.row], asked.counts)
        hit = places[least_of < own_ids]
        cover = np.zeros(len(data) + 1, np.int32)
        cover[hit] = 1
        cover[hit + length] -= 1
        gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
        n_removed, n_spans = removed_runs(gone, offsets)
        kept = without(data, offsets, gone)
        columns = [asked.rows.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n_removed), pa.array(n_spans), pa.array([hashlib.sha256(x).hexdigest() for x in kept])] + [pa.array(kept, pa.binary())] * with_text
        return pa.table(columns, names=[k for k, _ in kinds])

    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(tidy(finish), fields)

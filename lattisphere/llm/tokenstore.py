"""A content-addressed store of token ids.

Documents are encoded, one row each, and dealt to parts by (doc_id, CRC of the text, salt); the bounds come from a size-weighted
sample, so parts hold about equal bytes of text and one doc_id may fill many. The ids of each document are cut into chunks by a
rolling hash as they are encoded, once; the cuts and digests travel with the ids. A chunk is known by its digest. A chunk of one part is stored there, once; a chunk that several
parts hold is stored once, as a row of its own under its digest; every occurrence is a digest in some document's recipe.
Each part is one row of the store: recipes, own chunks, the digests of shared ones, and a Merkle root over its documents'
leaves. The manifest holds the parts' roots, sizes and the ids before each part, and the corpus root stands over all of it.
Reading back joins the parts with the shared chunks they name, checks every digest and root, and gives the ids: a part or
chunk that is gone or was changed raises ValueError.

Null and empty texts hold the end id alone. Rows with a null doc_id come first, equal doc_ids are ordered by the text's
CRC, and each row is a document of its own. An empty table gives an empty store. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _planes, _ranks, _runs
from .shared import bytes_array, mix, new_path, slices, tidy, unpack_planes
from .wordbpe import coder, joined

#: Text of one part, and sampled rows for each; parts that are summed at once in the manifest; the end id; least, mean and most ids of a chunk.
PART_TEXT, SAMPLE, GROUP, END = 8 << 20, 32, 1024, 2
LEAST, MEAN, MOST = 16, 128, 1024  # MEAN: a power of two
#: Ids that are cut at once, whole documents at a time.
IDS_AT_ONCE = 1 << 18
NO_ID = -(1 << 63)
_MIXED = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def chunk_ends(ids: np.ndarray, doc_ends: np.ndarray) -> np.ndarray:
    """Ends of the chunks of concatenated documents: where the rolling hash of 8 ids says so, no sooner than LEAST and no later
    than MOST ids after the last, and at each document's end."""
    h = _MIXED[ids] if ids.max(initial=0) < len(_MIXED) else mix(ids.astype(np.uint64) + np.uint64(1))
    for step in (1, 2, 4):  # a gear hash over 8 ids: h[i] = g[i] + 2 g[i-1] + 4 g[i-2] ...
        h[step:] += h[:-step] << np.uint64(step)
    cuts = np.flatnonzero(h & np.uint64((MEAN - 1) << 16) == 0) + 1
    out, last, k = [], 0, 0
    cuts = cuts.tolist()
    for end in doc_ends.tolist():
        while k < len(cuts) and cuts[k] < end:
            c = cuts[k]
            k += 1
            while c - last > MOST:
                last += MOST
                out.append(last)
            if c - last >= LEAST:
                out.append(c)
                last = c
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end > last:
            out.append(end)
            last = end
    return np.array(out, np.int64)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    while len(leaves) > 1:
        leaves = [digest(b"".join(leaves[k : k + 2])) for k in range(0, len(leaves), 2)]
    return leaves[0] if leaves else digest(b"")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id (null: NO_ID), text and a salt that parts rows of one doc_id."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"), "text")


def _cuts(docs: DataFrame, part_text: int) -> list[tuple[int, int, int]]:
    """The first keys (doc_id, CRC, salt) of all parts but the first: a size-weighted sample is sorted by range and cut where
    it stands for the text of one part. 24 bytes for each part reach the driver and the executors."""
    share = part_text // SAMPLE
    text = F.coalesce("text", F.lit(""))
    rows = _keyed(docs).select("doc_id", F.crc32(text).alias("crc"), "salt", F.octet_length(text).alias("size"))
    coin = F.pmod(F.xxhash64("salt", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.where(coin < (F.col("size") + 64) / float(share)).withColumn("stands", F.greatest(F.col("size") + 64, F.lit(share)))
    order = ["doc_id", "crc", "salt"]

    def run(batches):
        held = 0
        for batch in batches:
            stands = batch.column("stands").to_pylist()
            keep = np.zeros(len(stands), bool)
            for k, n in enumerate(stands):
                held += n
                if held >= part_text:
                    keep[k], held = True, 0
            yield batch.select(order).filter(pa.array(keep))

    cuts = drawn.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(run), "doc_id long, crc long, salt long")
    return sorted(tuple(r) for r in cuts.collect())


def parts_of(cuts: list[tuple[int, int, int]], ids: np.ndarray, crcs: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """The part of each row: how many cuts are not above its key."""
    bounds = np.array([c[0] for c in cuts], np.int64)
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    for k in np.flatnonzero(low < high):  # a part begins inside this doc_id
        low[k] = bisect.bisect_right(cuts, (int(ids[k]), int(crcs[k]), int(salts[k])), int(low[k]), int(high[k]))
    return low


def _encoded(docs: DataFrame, path: str, cuts: list) -> DataFrame:
    """A row for each document: its part, key and ids, and the digests and sizes of its chunks."""

    def run(batches):
        tool, kind = coder(path), _kind(path)
        for batch in batches:
            for piece in slices(batch):
                texts = piece.column("text")
                coded, counts = tool.split(texts)
                data, at = joined(tool.coded(coded.dictionary, "H" if kind == "<u2" else "I"), coded.indices)
                ends = at[np.cumsum(counts)] // np.dtype(kind).itemsize
                flat = np.insert(data.view(kind), ends, END)
                ends += np.arange(1, len(ends) + 1)
                edges = np.concatenate([[0], ends])
                ids, salts = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "salt"))
                crcs = np.fromiter((zlib.crc32(x) for x in bytes_array(texts).to_pylist()), np.int64, len(ids))
                packed = [_pack(flat[a:b]) for a, b in zip(edges[:-1].tolist(), ends.tolist(), strict=True)]
                names, sizes = [], []
                for first, last in _runs(edges, IDS_AT_ONCE):
                    own = _chunks_of(flat[edges[first] : edges[last]].astype("<u4"), edges[first + 1 : last + 1] - edges[first])
                    names += own[0]
                    sizes += own[1]
                yield pa.RecordBatch.from_arrays([pa.array(parts_of(cuts, ids, crcs, salts)), pa.array(ids), pa.array(crcs), pa.array(packed, pa.binary()), pa.array(names, pa.binary()), pa.array(sizes, pa.binary())], ["part", "doc_id", "crc", "ids", "names", "sizes"])

    return _keyed(docs).mapInArrow(tidy(run), "part long, doc_id long, crc long, ids binary, names binary, sizes binary")


def _chunks_of(flat: np.ndarray, doc_ends: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """The digests of each document's chunks, one after another, and their sizes."""
    ends = chunk_ends(flat, doc_ends)
    data = memoryview(flat.tobytes())
    names = b"".join([digest(data[4 * a : 4 * b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)])
    sizes = np.diff(ends, prepend=0).astype("<u2").tobytes()
    edges = [0, *np.searchsorted(ends, doc_ends, "right").tolist()]
    return tuple([whole[width * a : width * b] for a, b in zip(edges[:-1], edges[1:], strict=True)] for whole, width in ((names, 16), (sizes, 2)))


_PACKER = zstandard.ZstdCompressor(level=1)


def _pack(ids: np.ndarray) -> bytes:
    """As pack_planes, with one compressor for all documents."""
    return _PACKER.compress(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, ids.dtype.itemsize).T))


def _kind(path: str) -> str:
    """Ids take two bytes where the vocabulary allows."""
    tool = coder(path)
    return "<u2" if tool.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


class Part:
    """The documents of a part in order, with their chunks."""

    def __init__(self, rows: pa.Table, kind: str):
        packed, names, sizes = (rows.column(c).to_pylist() for c in ("ids", "names", "sizes"))
        each = [unpack_planes(x, kind) for x in packed]
        order = np.lexsort((np.fromiter(map(len, each), np.int64, len(each)), rows.column("crc").to_numpy(), rows.column("doc_id").to_numpy()))
        listed = order.tolist()
        self.ids, self.recipes = rows.column("doc_id").to_numpy()[order], [names[k] for k in listed]
        self.sizes = np.fromiter((len(each[k]) for k in listed), np.int64, len(listed))
        self.per_doc = [len(x) // 16 for x in self.recipes]
        data = memoryview(np.concatenate([each[k] for k in listed]).astype("<u4").tobytes())
        edges = np.cumsum(np.frombuffer(b"".join([sizes[k] for k in listed]), "<u2"), dtype=np.int64).tolist()
        self.bodies = [data[4 * a : 4 * b] for a, b in zip([0, *edges[:-1]], edges, strict=True)]
        self.digests = _split_names(b"".join(self.recipes))


def _split_names(whole: bytes) -> list[bytes]:
    return [whole[k : k + 16] for k in range(0, len(whole), 16)]


def _names(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests as two columns of signed numbers."""
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


_PART = "part long, n_ids long, ids array<long>, sizes array<long>, chunks array<int>, recipe binary, own binary, own_sizes array<int>, bodies binary, foreign binary, root binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("chunks", pa.list_(pa.int32())), ("recipe", pa.binary()), ("own", pa.binary()), ("own_sizes", pa.list_(pa.int32())), ("bodies", pa.binary()), ("foreign", pa.binary()), ("root", pa.binary()), ("d1", pa.int64()), ("d2", pa.int64()), ("body", pa.binary())])
_CHUNK = "d1 long, d2 long, body binary"
_MANIFEST = "part long, n_ids long, n_docs long, root binary, start long"


def write_store(docs: DataFrame, path: str, out: str, part_text: int = PART_TEXT) -> None:
    """Writes the store of all documents: out/store (rows of kind 0: parts, of kind 1: chunks that several parts share), out/manifest, out/corpus."""
    spark = docs.sparkSession
    cuts = _cuts(docs, part_text)
    rows = _encoded(docs, path, cuts)
    kind = _kind(path)

    def ask(part: pa.Table) -> pa.Table:
        d1, d2 = _names(list(dict.fromkeys(_split_names(b"".join(part.column("names").to_pylist())))))
        return pa.table({"part": pa.repeat(part.column("part")[0], len(d1)), "d1": d1, "d2": d2})

    def store(part: pa.Table, told: pa.Table) -> pa.Table:
        if not part.num_rows:
            return _SCHEMA.empty_table()
        held, number = Part(part, kind), part.column("part")[0].as_py()
        names = np.stack([told.column("d1").to_numpy(), told.column("d2").to_numpy()], axis=1).astype("<i8").tobytes()
        owner = {names[16 * k : 16 * k + 16]: o for k, o in enumerate(told.column("owner").to_pylist())}
        own, given = {}, {}
        for d, body in zip(held.digests, held.bodies, strict=True):
            if d not in owner:
                own.setdefault(d, body)
            elif owner[d] == number:
                given.setdefault(d, body)
        leaves = [digest(own) for own in held.recipes]
        row = [0, number, int(held.sizes.sum()), held.ids.tolist(), held.sizes.tolist(), held.per_doc, b"".join(held.recipes), b"".join(own), [len(b) // 4 for b in own.values()], _planes(np.frombuffer(b"".join(own.values()), "<u4"), 1), names, merkle_root(leaves), None, None, None]
        tables = [pa.table([pa.array([v], f.type) for v, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA)]
        if given:
            d1, d2 = _names(list(given))
            bodies = pa.array([_narrow(b) for b in given.values()], pa.binary())
            filled = {"kind": pa.repeat(pa.scalar(1, pa.int32()), len(d1)), "d1": pa.array(d1), "d2": pa.array(d2), "body": bodies}
            tables.append(pa.table([filled.get(f.name, pa.nulls(len(d1), f.type)) for f in _SCHEMA], schema=_SCHEMA))
        return pa.concat_tables(tables).combine_chunks()

    asked = rows.groupBy("part").applyInArrow(tidy(ask), "part long, d1 long, d2 long")
    same = Window.partitionBy("d1", "d2")
    told = asked.withColumns({"owner": F.min("part").over(same), "last": F.max("part").over(same)}).where("owner < last").drop("last")
    parts = rows.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(tidy(store), f"kind int, {_PART}, {_CHUNK}")
    parts.write.option("compression", "zstd").parquet(f"{out}/store")
    _write_manifest(spark, out)


def _read(spark, out: str, kind: int, columns: str) -> DataFrame:
    return spark.read.schema(f"kind int, {_PART}, {_CHUNK}").parquet(f"{out}/store").where(F.col("kind") == kind).select(*[c.split()[0] for c in columns.split(", ")])


def _narrow(body: bytes) -> bytes:
    """A chunk of four-byte ids in two-byte ones where that loses nothing, behind a byte that tells."""
    ids = np.frombuffer(body, "<u4")
    return b"\x02" + ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else b"\x04" + bytes(body)


def _wide(body: bytes) -> bytes:
    return np.frombuffer(body, f"<u{body[0]}", offset=1).astype("<u4").tobytes()


def _write_manifest(spark, out: str) -> None:
    """For each part its root, size and the ids before it; and one root over all parts. GROUP parts are summed at a time."""
    held = _read(spark, out, 0, _PART).select("part", "n_ids", F.size("ids").cast("long").alias("n_docs"), "root", F.expr(f"part div {GROUP}").alias("group"))
    inside = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # a row for each GROUP parts
    first = held.groupBy("group").agg(F.sum("n_ids").alias("n")).select("group", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("first"))
    held = held.withColumn("before", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(first, "group")
    held.select("part", "n_ids", "n_docs", "root", (F.col("first") + F.col("before")).alias("start")).write.parquet(f"{out}/manifest")
    spark.createDataFrame([corpus_root(spark.read.schema(_MANIFEST).parquet(f"{out}/manifest"))], "n_parts long, n_ids long, root binary").coalesce(1).write.parquet(f"{out}/corpus")


def corpus_root(manifest: DataFrame) -> tuple[int, int, bytes]:
    """Parts, ids, and the root over the parts' roots, sizes and starts; a root for each GROUP parts reaches the driver."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        leaves = [digest(b"".join([r["root"], *(int(r[c]).to_bytes(8, "little", signed=True) for c in ("part", "n_ids", "n_docs", "start"))])) for r in rows.to_pylist()]
        return pa.table({"group": [rows.column("group")[0].as_py()], "n": [len(leaves)], "n_ids": [sum(rows.column("n_ids").to_pylist())], "root": pa.array([merkle_root(leaves)], pa.binary())})

    groups = manifest.withColumn("group", F.expr(f"part div {GROUP}")).groupBy("group").applyInArrow(tidy(run), "group long, n long, n_ids long, root binary").collect()
    groups = sorted(groups, key=lambda r: r["group"])
    return sum(r["n"] for r in groups), sum(r["n_ids"] for r in groups), merkle_root([bytes(r["root"]) for r in groups])


def _own_chunks(row: dict) -> dict[bytes, bytes]:
    """The chunks that a part stores, each checked against its digest."""
    flat, sizes, own = _ranks(row["bodies"]).astype("<u4").tobytes(), row["own_sizes"], row["own"]
    ends = np.cumsum([0, *sizes]).tolist()
    chunks = {own[16 * k : 16 * k + 16]: flat[4 * ends[k] : 4 * ends[k + 1]] for k in range(len(sizes))}
    for d, body in chunks.items():
        if digest(body) != d:
            raise ValueError(f"part {row['part']}: a chunk differs from its digest")
    return chunks


def read_store(spark, out: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (with_ids: and ids) of every document of the store, in no order.

    Raises ValueError if the manifest differs from the corpus root, and when it is read if a part or chunk is gone or changed."""
    parts, chunks = _read(spark, out, 0, _PART), _read(spark, out, 1, _CHUNK)
    manifest = spark.read.schema(_MANIFEST).parquet(f"{out}/manifest")
    told = spark.read.schema("n_parts long, n_ids long, root binary").parquet(f"{out}/corpus").first()
    if told is None or corpus_root(manifest) != (told["n_parts"], told["n_ids"], bytes(told["root"])):
        raise ValueError("the manifest differs from the corpus root")

    def ask(batches):
        for batch in batches:
            for part, foreign in zip(batch.column("part").to_pylist(), batch.column("foreign").to_pylist(), strict=True):
                d1, d2 = _names([foreign])
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(d1), pa.int64()), pa.array(d1), pa.array(d2)], ["part", "d1", "d2"])

    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids

    def rebuild(held: pa.Table, given: pa.Table) -> pa.Table:
        listed = given.filter(given.column("told").is_valid())
        if held.num_rows != 1 or listed.num_rows != 1:
            raise ValueError(f"part {(held if held.num_rows else given).column('part')[0].as_py()}: it is not once in the store and once in the manifest")
        row = {**held.to_pylist()[0], "start": listed.column("start")[0].as_py(), "told": listed.column("told")[0].as_py()}
        found, given = _own_chunks(row), given.filter(given.column("body").is_valid())
        for d1, d2, body in zip(given.column("d1").to_pylist(), given.column("d2").to_pylist(), given.column("body").to_pylist(), strict=True):
            d, body = np.array([d1, d2], "<i8").tobytes(), _wide(body)
            if digest(body) != d:
                raise ValueError(f"part {row['part']}: a shared chunk differs from its digest")
            found[d] = body
        recipe, at, start, out_rows, leaves = row["recipe"], 0, row["start"], [], []
        for doc_id, size, n in zip(row["ids"], row["sizes"], row["chunks"], strict=True):
            own = recipe[16 * at : 16 * (at + n)]
            try:
                data = b"".join([found[own[k : k + 16]] for k in range(0, len(own), 16)])
            except KeyError:
                raise ValueError(f"part {row['part']}: a chunk is gone") from None
            if len(data) != 4 * size:
                raise ValueError(f"part {row['part']}: a document has {len(data) // 4} ids for {size}")
            leaves.append(digest(own))
            out_rows.append((None if doc_id == NO_ID else doc_id, start, size, zlib.crc32(data), np.frombuffer(data, "<u4").tolist() if with_ids else None))
            at, start = at + n, start + size
        if merkle_root(leaves) != row["told"]:
            raise ValueError(f"part {row['part']}: its Merkle root differs from the manifest's")
        return pa.table([pa.array([r[k] for r in out_rows], t) for k, (_, t) in enumerate(kinds)], names=[k for k, _ in kinds])

    asked = parts.where(F.octet_length("foreign") > 0).select("part", "foreign").mapInArrow(tidy(ask), "part long, d1 long, d2 long")
    given = asked.join(chunks, ["d1", "d2"])  # a chunk that many parts share is a skewed key of a plain join
    given = given.unionByName(manifest.select("part", "start", F.col("root").alias("told")), allowMissingColumns=True)
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return parts.drop("root").groupBy("part").cogroup(given.groupBy("part")).applyInArrow(tidy(rebuild), fields)


def round_trip(docs: DataFrame, path: str, out: str | None = None) -> DataFrame:
    """Writes the store (to a new place in the shared folder unless told) and reads it back."""
    out = out or new_path(docs.sparkSession, "store")
    write_store(docs, path, out)
    return read_store(docs.sparkSession, out)

"""Each corpus operator against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import shutil
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lattisphere.llm import bpe, chunkdedup, decontamination, language, neardup, quality, sharding, simhash, suffixdedup, tokenstore, topk, wordbpe
from lattisphere.llm.components import components
from lattisphere.llm.queries import vocabulary
from lattisphere.llm.shared import mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone light walking quickly señor élan über straße don't we're 42 1,000 😀 x́ naïve".split()


def make(n=60, seed=3):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(WORDS) + str(rng.randrange(50)) * (rng.random() < 0.5) for _ in range(k))
    passage = text(70)
    rows = [(k, text(rng.randrange(1, 120))) for k in range(n)]
    rows[5] = (5, None)
    rows[6] = (6, "")
    rows[7] = (7, " \t\n ")
    rows[8] = (8, rows[3][1])
    rows[9] = (9, passage + " " + rows[9][1])
    rows[12] = (12, rows[12][1] + "\n" + passage)
    rows[13] = (13, "a<|endoftext|>b    c\x1cd é İstanbul \u0085x")
    rows[14] = (14, text(4000))
    rows[15] = (15, rows[14][1] + " tail")
    rows += [(16, rows[16][1]), (None, passage), (None, None)]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = [F.lit("x").alias(c) for c in ("fp", "block", "size", "score", "n_bytes", "ids", "bucket", "part")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", *extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tool():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def key(x):
    return tuple((v is not None, v if v is not None else 0) for v in x)


def test_bpe(docs, empty, rows, tool):
    path = vocabulary("word_bpe_49k.json")
    got = sorted((tuple(r) for r in bpe.encode_decode(docs, path, block_text=4000, extra=("ids", "decoded")).collect()), key=lambda r: key(r[:4]))
    want = []
    for i, t, *_ in rows:
        ids = tool.encode(t or "", add_special_tokens=False).ids
        text = tool.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert got == sorted(want, key=lambda r: key(r[:4]))
    assert bpe.encode_decode(empty, path).count() == 0


def test_pieces_by_the_pattern(tool):
    rng = random.Random(7)
    some = ["a", "b", *"stdmvrel", "'", '"', *"9²½ª \t\n.,!-é÷×ßÉÀ\x1c\x00", "'s", "'re", "'ll", "it's", " 'tis", "''s", "'d'll", "don't"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += ["", None, "'", "'r", "e's", "'", "s", "it'", "s", "'l", "l'", "v", "e", "'", "re", "2", "²"]
    coder = wordbpe.WordCoder(vocabulary("word_bpe_49k.json"))
    coded, counts = coder.split(pa.array(texts))
    found, ends = coded.to_pylist(), np.cumsum(counts).tolist()
    assert [found[e - n : e] for e, n in zip(ends, counts.tolist(), strict=True)] == [re.findall(wordbpe.PATTERN, (t or "").lower()) for t in texts]
    asked = []
    coder.encode = lambda piece, encode=coder.encode: asked.append(piece) or encode(piece)
    for _ in range(3):
        values = coder.coded(coded.dictionary, "H")
    assert asked == coded.dictionary.to_pylist()  # a piece that is known is not encoded again
    flat = values.take(coded.indices).to_pylist()
    assert [b"".join(flat[e - n : e]) for e, n in zip(ends, counts.tolist(), strict=True)] == [np.array(tool.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    coder.held = 3  # then the last ones stay known
    last = ["one", "two", asked[0]]
    assert coder.coded(pa.array(last, pa.large_string()), "H").to_pylist()[2] == values[0].as_py()
    assert coder.known["H"][0].to_pylist() == last and coder.coded(coded.dictionary, "H") == values


def test_token_store(docs, empty, rows, tool, spark, tmp_path):
    path, out = vocabulary("word_bpe_49k.json"), f"file://{tmp_path}/store"
    tokenstore.write_store(docs, path, out)
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in tokenstore.read_store(spark, out).collect()}
    start, want = 0, {}
    for i, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()))):
        ids = np.array([*tool.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[(i, start)] = (len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want
    stored, shared = tokenstore._read(spark, out, 0, tokenstore._PART).collect(), tokenstore._read(spark, out, 1, tokenstore._CHUNK).collect()
    chunks = [bytes(r.own[k : k + 16]) for r in stored for k in range(0, len(r.own), 16)] + [np.array([r.d1, r.d2], "<i8").tobytes() for r in shared]
    assert len(chunks) == len(set(chunks))
    assert tokenstore.round_trip(empty, path).count() == 0


def small_store(spark, out, hot=True):
    """A store of many parts, one doc_id with a third of all rows, copies and a text longer than a part."""
    rng = random.Random(3)
    text = lambda k: " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(k))
    common = text(120)
    rows = [(7 if hot and k % 3 == 0 else k, (common + " " if k % 2 else "") + text(40)) for k in range(240)] + [(500, text(3000)), (None, None)]
    tokenstore.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), vocabulary("word_bpe_49k.json"), out, part_text=4000)
    return rows


def test_store_of_many_parts(spark, tool, tmp_path):
    out = f"file://{tmp_path}/store"
    rows = small_store(spark, out)
    got = tokenstore.read_store(spark, out, with_ids=True).collect()
    want = sorted(((i is not None, i or 0), [*tool.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.ids) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [k for k, _ in want]
    parts = tokenstore._read(spark, out, 0, tokenstore._PART).collect()
    assert sum(7 in r.ids for r in parts) > 3 and tokenstore._read(spark, out, 1, tokenstore._CHUNK).count() > 0


def rewritten(spark, path, change):
    held = spark.read.parquet(path)
    rows = change(held.collect())
    spark.createDataFrame(rows, held.schema).write.mode("overwrite").parquet(path)


def test_store_tells_changes(spark, tmp_path):
    base = tmp_path / "whole"
    small_store(spark, f"file://{base}")
    new = lambda r, **values: r.__class__(**{**r.asDict(), **values})

    def changed(name, change, where="store"):
        out = tmp_path / name
        shutil.copytree(base, out)
        rewritten(spark, f"file://{out / where}", change)
        with pytest.raises(Exception) as told:
            tokenstore.read_store(spark, f"file://{out}").collect()
        return str(told.value)

    def of_kind(k, change):
        return lambda rows: [y for r in rows for y in (change(r) if r.kind == k else [r])]

    assert "not once in the store" in changed("lost part", of_kind(0, lambda r: [r] * (r.part != 3)))
    assert "not once in the store" in changed("part twice", of_kind(0, lambda r: [r] * (1 + (r.part == 3))))
    assert "chunk is gone" in changed("lost chunk", of_kind(1, lambda r: []))
    assert "shared chunk differs" in changed("changed chunk", of_kind(1, lambda r: [new(r, body=bytes([2]) + bytes(len(r.body) - 1))]))
    assert "differs from its digest" in changed("changed body", of_kind(0, lambda r: [new(r, bodies=tokenstore._planes(np.zeros(sum(r.own_sizes), "<u4")))]))
    swapped = lambda r: [new(r, recipe=bytes(r.recipe[16 * r.chunks[0] :]) + bytes(r.recipe[: 16 * r.chunks[0]]), ids=r.ids[1:] + r.ids[:1], sizes=r.sizes[1:] + r.sizes[:1], chunks=r.chunks[1:] + r.chunks[:1])]
    assert "Merkle root" in changed("changed recipe", of_kind(0, swapped))
    assert "corpus root" in changed("changed manifest", lambda rows: [new(r, root=bytes(16)) for r in rows], "manifest")
    assert "corpus root" in changed("lost manifest row", lambda rows: rows[1:], "manifest")


def test_chunks_of_ids():
    ids = np.random.default_rng(1).integers(0, 500, 5000)
    ends = tokenstore.chunk_ends(ids, np.array([10, 3000, 5000]))
    sizes = np.diff(np.concatenate([[0], ends]))
    assert sizes.max() <= tokenstore.MOST and {10, 3000, 5000} <= set(ends.tolist())
    later = tokenstore.chunk_ends(np.concatenate([[7], ids[10:3000]]), np.array([2991]))
    assert len({e - 1 for e in later.tolist()} & {e - 10 for e in ends.tolist() if 10 < e <= 3000}) > 0.7 * len(later)


def test_chunks_are_cut_and_named_once(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = np.array([1, 700, 1, 20, 3000, 1, 90, 2500, 16, 17])
    each = [np.append(rng.integers(3, 300, n - 1), tokenstore.END).astype("<u2") for n in sizes.tolist()]
    names, lengths = tokenstore._chunks_of(np.concatenate(each).astype("<u4"), np.cumsum(sizes))
    for ids, own, told in zip(each, names, lengths, strict=True):  # as if each document were alone
        ends = tokenstore.chunk_ends(ids.astype("<u4"), np.array([len(ids)])).tolist()
        assert np.cumsum(np.frombuffer(told, "<u2")).tolist() == ends
        assert own == b"".join(hashlib.blake2b(ids[a:b].astype("<u4").tobytes(), digest_size=16).digest() for a, b in zip([0, *ends], ends, strict=False))
    wide = np.array([1 << 16, 5, 1 << 20, *range(100)])
    assert tokenstore.chunk_ends(wide, np.array([103])).tolist() == tokenstore.chunk_ends(wide.astype("<u4"), np.array([103])).tolist()
    assert (tokenstore._MIXED[wide[3:]] == mix(wide[3:].astype(np.uint64) + np.uint64(1))).all()

    def again(*_):
        raise AssertionError("a part cuts or digests anew")

    monkeypatch.setattr(tokenstore, "chunk_ends", again)
    monkeypatch.setattr(tokenstore, "digest", again)
    rows = pa.table({"doc_id": pa.array([9 - k for k in range(10)]), "crc": pa.array([0] * 10), "ids": pa.array([tokenstore._pack(x) for x in each], pa.binary()), "names": pa.array(names, pa.binary()), "sizes": pa.array(lengths, pa.binary())})
    part = tokenstore.Part(rows, "<u2")
    assert part.ids.tolist() == list(range(10)) and part.sizes.tolist() == sizes[::-1].tolist() and part.recipes == names[::-1]
    assert b"".join(part.bodies) == np.concatenate(each[::-1]).astype("<u4").tobytes() and [len(x) // 16 for x in part.recipes] == part.per_doc
    assert [hashlib.blake2b(x, digest_size=16).digest() for x in part.bodies] == part.digests


def test_sharding(docs, empty, rows):
    got = sharding.assign_shards(docs, 8).collect()
    assert sorted((key((r.doc_id,)), r["size"], r.text_crc32) for r in got) == sorted((key((i,)), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    for k in range(8):
        own = [r for r in got if r.shard == k]
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert sharding.assign_shards(empty).count() == 0


def test_sharding_sizes(spark):
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    sums = [r[1] for r in sharding.assign_shards(hot, 8, range_bytes=2000).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sums) == 8 and max(sums) - min(sums) <= 200


def test_write_shards(spark, rows, tmp_path):
    docs = spark.createDataFrame([r for r in rows if r[0] is not None][:40], SCHEMA)
    placed = sharding.write_shards(docs, f"file://{tmp_path}/shards", 4)
    assert spark.read.parquet(f"file://{tmp_path}/shards").count() == placed.count() == 40


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, empty, rows):
    fps = [fingerprint(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(rows))]
    least = {c: min((rows[j][0] for j in range(len(rows)) if label[j] == c and rows[j][0] is not None), default=None) for c in set(label)}
    want = sorted((key((rows[i][0], least[label[i]])), fps[i]) for i in range(len(rows)))
    got = sorted((key((r.doc_id, r.component_id)), r.fp & (2**64 - 1)) for r in simhash.near_groups(docs).collect())
    assert got == want
    assert simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_near_pairs_lose_nothing(spark, small):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[:200] ^ (np.uint64(1) << rng.integers(0, 63, 200).astype(np.uint64))
    x = np.unique(np.concatenate([base, near, near ^ np.uint64(6)]))
    table = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    found = simhash.near_links(table) if not small else simhash.near_links(table, shard_rows=8, asked_rows=20)
    got = {r.node: r.root for r in components(found).collect()}
    forest = simhash.Forest(len(x))
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)
    forest.link(i, j)
    groups = lambda label: sorted(sorted(k for k in label if label[k] == v) for v in set(label.values()))
    want = {int(v): int(forest.label[k]) for k, v in enumerate(x.view(np.int64))}
    assert groups({int(v): got.get(int(v), int(v)) for v in x.view(np.int64)}) == groups(want)


def cut(rows, length):
    seen, out = {}, []
    data = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    for i, b in data:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            seen[s] = min(seen.get(s, i), i)
    for i, b in data:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup(docs, empty, rows):
    got = sorted((2**63 - 1 if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in suffixdedup.dedup(docs).collect())
    assert got == cut(rows, 50)
    assert suffixdedup.dedup(empty).count() == 0


def test_two_stage_order():
    rng = np.random.default_rng(2)
    for text in (b"banana" * 30, b"a" * 200, bytes(rng.integers(97, 100, 500, dtype=np.uint8)), bytes(range(256)) * 3):
        data = np.frombuffer(text, np.uint8)
        depth = 16
        words = suffixdedup.words_at(data, big=True)
        padded = np.concatenate([words, np.zeros(64, np.uint64)])
        wanted = np.zeros(len(data), bool)
        wanted[: len(data) - depth] = True
        order = suffixdedup.two_stage_order(data, wanted, depth, [padded[k : k + len(data)] for k in range(0, depth, 8)])
        strings = [text[k : k + depth] for k in order]
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist() and strings == sorted(strings)


def test_suffixes_are_read_as_far_as_they_are_equal():
    class Key:
        read = 0

        def __init__(self, values):
            self.values = values

        def __getitem__(self, at):
            Key.read += len(at)
            return self.values[at]

    data = np.frombuffer(np.random.default_rng(6).bytes(20_000) + b"one passage of more than fifty bytes, which is there twice; " * 2 + bytes(60), np.uint8)
    words = np.concatenate([suffixdedup.words_at(data, big=True), np.zeros(64, np.uint64)])
    wanted = np.arange(len(data)) < len(data) - 60
    order = suffixdedup.two_stage_order(data, wanted, 48, [Key(words[k : k + len(data)]) for k in range(0, 48, 8)])
    strings = [data[k : k + 48].tobytes() for k in order]
    assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist() and strings == sorted(strings)
    assert Key.read < 1.5 * len(data)  # six times about half of it, where every string is read whole


def test_strings_choose_their_runs_piece_by_piece(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abé \0") for _ in range(n)) for n in (0, 49, 50, 3, 700, 51, 0, 120)] + ["a" * 300, None, ""]
    ids = np.arange(len(texts))
    offsets = np.cumsum([0, *(len((t or "").encode()) for t in texts)])
    whole = suffixdedup.Grams(pa.array(texts), ids, 50, 16)
    strings = [k for a, b in zip(offsets[:-1], offsets[1:], strict=True) for k in range(a, b - 49)]
    data = whole.data.tobytes()
    assert [k + j for k, n in zip(whole.starts, whole.counts, strict=True) for j in range(n)] == strings
    assert all(k + n - 1 <= p <= k + 34 for k, n, p in zip(whole.starts, whole.counts, whole.picks, strict=True))
    run = dict(zip(strings, np.repeat(whole.picks - whole.starts, whole.counts) - np.concatenate([np.arange(n) for n in whole.counts]), strict=True))
    assert len({(data[k : k + 50], p) for k, p in run.items()}) == len({data[k : k + 50] for k in strings})  # equal strings choose equal runs
    for step in (1, 7, 50, 333):
        monkeypatch.setattr(suffixdedup, "AT_ONCE", step)
        own = suffixdedup.Grams(pa.array(texts), ids, 50, 16)
        assert all((getattr(own, c) == getattr(whole, c)).all() for c in ("picks", "starts", "counts", "keys")), step
    starts, sizes = whole.starts, whole.counts + 49
    first, place, least = suffixdedup.merged(whole.words, starts, sizes, -np.arange(len(starts)))
    spans = [data[k : k + n] for k, n in zip(starts, sizes, strict=True)]
    assert [spans[first[k]] for k in place] == spans and len(first) == len(set(spans))
    assert all(least[p] == -max(k for k, s in enumerate(spans) if s == spans[first[p]]) for p in range(len(first)))


def test_chunk_dedup(docs, empty, rows):
    got = {r.doc_id: r for r in chunkdedup.dedup(docs.drop("n_bytes")).collect() if r.doc_id is not None}
    texts = {i: t for i, t, *_ in rows if i is not None}
    assert got[0].text == texts[0] and got[5].text is None and got[6].text == ""
    assert got[9].n_removed == 0 and got[12].n_removed > 200  # the passage stays in the first document
    assert got[8].n_removed == len(texts[8].encode()) or len(texts[8].encode()) < 100
    assert got[15].n_removed > 0.9 * len(texts[14].encode())
    for i, r in got.items():
        assert r.n_bytes - r.n_removed == len((r.text or "").encode())
    assert chunkdedup.dedup(empty).count() == 0
    assert chunkdedup.keep_deduped(docs).columns == docs.columns


def test_chunks_resist_insertions():
    import pyarrow as pa

    text = " ".join(random.Random(1).choices(WORDS, k=3000)).encode()
    one = chunkdedup.Chunks(pa.array([text], pa.binary())).digests
    two = chunkdedup.Chunks(pa.array([b"inserted " + text[:5000] + b" here " + text[5000:]], pa.binary())).digests
    same = {tuple(x) for x in one.tolist()} & {tuple(x) for x in two.tolist()}
    assert len(same) > 0.95 * len({tuple(x) for x in one.tolist()})


def test_decontamination(spark, docs, empty, rows):
    items = [(1, " ".join(rows[20][1].split()[:30])), (2, "only four words here"), (3, ""), (4, None), (5, "".join(c.upper() if c.isascii() else c for c in " ".join(rows[14][1].split()[3000:3040]))), (5, "never seen anywhere at all"), (6, " ".join(rows[21][1].split()[-4:]))]
    table = spark.createDataFrame(items, "item_id long, text string")

    def grams(t, n=5):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[k : k + n]) for k in range(len(w) - n + 1)}

    want = set()
    for i, t, *_ in rows:
        for item, x in items:
            n = min(5, len((x or "").split()))
            if n and (asked := grams(x, n)) and len(asked & grams(t, n)) >= 0.8 * len(asked):
                want.add((i, item))
    got = {(r.doc_id, r.item_id) for r in decontamination.contained(docs, table).collect()}
    assert got == want and (14, 5) in got
    assert {(r.doc_id, r.item_id) for r in decontamination.contained(docs, table, item_bytes=200).collect()} == want
    assert decontamination.contained(empty, table).count() == 0
    assert decontamination.contained(docs, table.limit(0)).count() == 0
    kept = decontamination.keep_clean(docs, table)
    assert kept.columns == docs.columns and sorted((key((r.doc_id,)), r.text or "") for r in kept.collect()) == sorted((key((i,)), t or "") for i, t, *_ in rows if (i, t) not in {(i, t) for i, t, *_ in rows if any(n and (a := grams(x, n)) and len(a & grams(t, n)) >= 0.8 * len(a) for _, x in items for n in [min(5, len((x or "").split()))])})
    twins = spark.createDataFrame([(None, items[0][1]), (7, items[0][1]), (7, "a clean text of seven words here"), (None, None)], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in decontamination.keep_clean(twins, table, item_bytes=200).collect()} == {(7, "a clean text of seven words here"), (None, None)}


def test_quality(spark, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        good = k % 3 > 0
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(40)]
        rows.append((k, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), "en", "s", 1))
        labels.append((k, int(good), 0))
    rows += [(400, None, "en", "s", 0), (401, "", "en", "s", 0), (None, "alpha", "en", "s", 0)]
    labels += [(5000, 1, 0), (400, None, 0)]
    docs, table = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(docs, table).collect()}
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [r for i, r in got.items() if i is not None and i < 400 and r.held_out]
    assert held and all(r.predicted == (r.doc_id % 3 > 0) for r in held)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    assert {r.score for r in quality.score_quality(docs, table.limit(0)).collect()} == {0.5}
    assert quality.score_quality(empty, table).count() == 0


def test_language(spark, empty):
    rng = random.Random(4)
    kinds = {"en": "the and with thing which there".split(), "de": "der und nicht schön über straße".split(), "fr": "le être où garçon les déjà".split(), "es": "el señor niño más que año".split()}
    rows = [(k, " ".join(rng.choices(kinds[lang], k=rng.randrange(5, 40))), lang, "s", 1) for k, lang in enumerate(list(kinds) * 60)]
    rows += [(240, None, "en", "s", 0), (241, "123 !!", "en", "s", 0), (242, "", None, "s", 0), (None, "der und nicht", None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert got[240].lang_pred == got[241].lang_pred == got[242].lang_pred == "und" and got[None].lang_pred == "de"
    wrong = [i for i, _, lang, *_ in rows[:240] if got[i].lang_pred != lang]
    assert len(wrong) <= 2 and all(0 <= r.score <= 1 for r in got.values())
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} == {"x"} and kept.count() == 241
    assert language.identify(empty).count() == 0 and {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_top_k(spark):
    rng = np.random.default_rng(8)
    v = np.round(rng.normal(size=(300, 12)), 1).astype(np.float32)  # rounding makes ties
    rows = [(k, [float(x) for x in r], 0) for k, r in enumerate(v)]
    rows += [(20, rows[20][1], 0), (301, None, 0), (302, [1.0, None], 0), (303, [float("nan")] * 12, 0), (304, [float("inf")] * 12, 0), (None, rows[0][1], 0), (340, [], 0), (305, [1.0, 2.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    good = [(i, np.pad(np.floor(64 * np.array(e, np.float32).astype(float)).astype(int), (0, 12 - len(e)))) for i, e, _ in rows if i is not None and e is not None and None not in e and np.isfinite(np.array(e, float)).all()]
    want = []
    for i, q in good:
        if i % 20 == 0:
            best = sorted((-int(q @ x), j) for j, x in good if j != i)[:20]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    got = sorted({tuple(r) for r in topk.top_k(table).collect()})
    assert got == sorted(set(want))
    assert topk.top_k(table.limit(0)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 11), (7, 7), (20, 1), (12, 11), (11, 10)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 20: 1, 10: 10, 11: 10, 12: 10}


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = corpus_pipeline.run(spark, sf)
    got = found.collect()
    assert 0 < len(got) <= len(docs) and len({r.doc_id for r in got}) == len(got)
    assert all(r.n_tokens == len(r.ids) for r in got)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    step = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        step = stage(spark, step, sf)
        assert step.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def planted_copies():
    """Texts of several lengths, each with copies whose words were changed until they fall on both sides of a similarity of 0.8."""
    rng, rows = random.Random(11), []
    for n in (7, 12, 40, 200, 900) * 3:
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        rows.append((len(rows), " ".join(base)))
        for share in (0.003, 0.01, 0.015, 0.02, 0.025, 0.04):
            changed = list(base)
            for _ in range(max(1, round(share * n))):
                changed[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(changed + (["tail"] if rng.random() < 0.3 else []))))
    rows += [(len(rows), rows[0][1].upper()), (None, rows[7][1]), (len(rows) + 2, "one two"), (len(rows) + 3, "One  two"), (len(rows) + 4, "one two three")]
    return [(i, t, "en", "s", len(t)) for i, t in rows]


def near_brute(rows, threshold=0.8):
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for _, t, *_ in rows]
    near = [[j for j, y in enumerate(sets) if x == y or (x | y and len(x & y) / len(x | y) >= threshold)] for x in sets]
    label = list(range(len(rows)))
    while label != (label := [min(label[j] for j in own) for own in near]):
        pass
    least = {c: min((rows[j][0] for j in range(len(rows)) if label[j] == c and rows[j][0] is not None), default=None) for c in label}
    return sorted(key((rows[i][0], least[label[i]])) for i in range(len(rows)))


def test_near_duplicates_of_the_pipeline(spark, docs, empty, rows):
    import corpus_pipeline

    planted = planted_copies()
    for table, own in ((spark.createDataFrame(planted, SCHEMA).repartition(3), planted), (docs, rows)):
        assert sorted(key((r.doc_id, r.component_id)) for r in neardup.near_groups(table).collect()) == near_brute(own)
    gone = {i[1] for i, c in near_brute(planted) if i[0] and c != i}
    kept = corpus_pipeline.near_deduped(spark, spark.createDataFrame(planted, SCHEMA), "")
    assert gone and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [i for i, *_ in planted if i is not None and i not in gone]
    assert neardup.keep_one(docs.withColumn("__key0", F.lit(1))).columns == [*docs.columns, "__key0"] and neardup.keep_one(empty).count() == 0
    same_id = [(1, rows[0][1]), (1, rows[1][1]), (1, rows[1][1]), (None, rows[2][1]), (None, rows[1][1]), (2, rows[2][1]), (3, None), (4, "")]
    kept = neardup.keep_one(spark.createDataFrame(same_id, "doc_id long, text string").coalesce(1))
    assert sorted((key((r.doc_id,)), r.text or "") for r in kept.collect()) == sorted((key((i,)), t or "") for i, t in (same_id[0], same_id[1], same_id[5], same_id[6]))


def test_items_of_few_shingles_are_never_missed():
    import pyarrow as pa

    rng = random.Random(6)
    words = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    items = [(k, " ".join(words(5 + k % 4))) for k in range(1600)]
    texts = [" ".join([*words(rng.choice((0, 3, 30))), items[k][1].upper(), *words(40)]) for k in range(1600)]
    for threshold in (0.5, 0.8):
        found = decontamination.candidates(decontamination.Items(items, 5, threshold), pa.array(texts))
        assert found >= {(k, k) for k in range(1600)}
    partly = [" ".join([*text.split()[:6], "other", *text.split()[7:]]) for _, text in items[3::4]]  # two of four shingles
    found = decontamination.candidates(decontamination.Items(items[3::4], 5, 0.5), pa.array(partly))
    assert found >= {(k, k) for k in range(400)}


def planted_passages(n=300):
    """Passages of 51 words at many offsets in two documents each; rows and the passages, the second copy in document n + k."""
    rng = random.Random(9)
    words = lambda k: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(k))
    passages = [words(51) for _ in range(n)]
    rows = [(k + side * n, f"{words(rng.randrange(20, 90))} \u00e9{side} {p} {side}\u00e8 {words(rng.randrange(20, 90))}") for side in (0, 1) for k, p in enumerate(passages)]
    return [(i, t, "en", "s", len(t)) for i, t in rows], passages


def test_chunk_dedup_removes_whole_passages(spark):
    n = 300
    rows, passages = planted_passages(n)
    got = {r.doc_id: r for r in chunkdedup.dedup(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    for k, (i, text, *_) in enumerate(rows):
        if k < n:
            assert got[i].text == text and got[i].n_removed == 0
        else:
            a, b = text.split(f" {passages[k - n]} ")
            assert got[i].text == a + b and got[i].n_spans == 1

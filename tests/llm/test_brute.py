"""Operators without SQL against plain versions of the same rules: chunk dedup, the linear models, and every stage of the pipeline."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from test_corpus import SCHEMA, WORDS, key, make, planted_copies, planted_passages

from lattisphere.llm import chunkdedup, language, linear, quality
from lattisphere.llm.queries import vocabulary

LARGE = 2**63 - 1


def plain_cuts(b: bytes) -> list[int]:
    """Ends of the chunks of one text, window by window."""
    gear, n = chunkdedup._GEAR.tolist(), len(b)
    h = [sum(gear[b[i - k]] << k for k in range(min(16, i + 1))) & 0xFFFFFFFF for i in range(n)]
    good = [i >= 15 and not (i + 1 < n and b[i + 1] & 0xC0 == 0x80) and all(i - p < 0 or h[i] != h[i - p] for p in range(1, 9)) for i in range(n)]
    cuts = {n} if n else set()
    for a in range(n - 63):
        at = max(range(a, a + 64), key=lambda i: (-(h[i] if good[i] else 0xFFFFFFFF), i))
        if good[at]:
            cuts.add(at + 1)
    return sorted(cuts)


def plain_dedup(rows, least_run=100):
    """The bytes of each text that stay; doc_ids must differ but for null ones."""
    data = [((LARGE if i is None else i), (t or "").encode()) for i, t, *_ in rows]
    chunks = [[(a, e) for a, e in zip([0, *cuts], cuts, strict=False)] for cuts in (plain_cuts(b) for _, b in data)]
    places: dict[bytes, dict[int, list]] = {}
    for (i, b), own in zip(data, chunks, strict=True):
        for a, e in own:
            places.setdefault(b[a:e], {}).setdefault(i, []).append((b, a, e))
    out = []
    for (i, b), own in zip(data, chunks, strict=True):
        gone, k = [False] * len(b), 0
        least = [min(places[b[a:e]]) for a, e in own]
        while k < len(own):
            if least[k] >= i:
                k += 1
                continue
            last = k
            while last + 1 < len(own) and least[last + 1] < i:
                last += 1
            low, high = own[k][0], own[last][1]
            for j in range(k, min(k + 2, last + 1)):
                for other, a, _ in places[b[own[j][0] : own[j][1]]][least[j]][:4]:
                    n = 0
                    while n < min(256, own[j][0], a) and b[own[j][0] - n - 1] == other[a - n - 1]:
                        n += 1
                    low = min(low, own[j][0] - n)
            for j in range(max(k, last - 1), last + 1):
                for other, _, e in places[b[own[j][0] : own[j][1]]][least[j]][:4]:
                    n = 0
                    while n < min(256, len(b) - own[j][1], len(other) - e) and b[own[j][1] + n] == other[e + n]:
                        n += 1
                    high = max(high, own[j][1] + n)
            while low < own[k][0] and b[low] & 0xC0 == 0x80:
                low += 1
            while high > own[last][1] and high < len(b) and b[high] & 0xC0 == 0x80:
                high -= 1
            if high - low >= least_run:
                gone[low:high] = [True] * (high - low)
            k = last + 1
        out.append(bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


def test_cuts_of_plain_rule():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abé ü\n") for _ in range(rng.randrange(0, 700))) for _ in range(12)] + ["ab" * 300, "x" * 200, "", "éü" * 90]
    found = chunkdedup.Chunks(pa.array(texts))
    ends = np.split(found.ends, np.searchsorted(found.ends, found.offsets[1:-1], "right"))
    assert [(e - o).tolist() for e, o in zip(ends, found.offsets[:-1], strict=True)] == [plain_cuts(t.encode()) for t in texts]


def test_cuts_do_not_depend_on_what_is_searched_at_once(monkeypatch):
    rng = random.Random(4)
    sizes = [0, 1, 15, 16, 63, 64, 65, 127, 300, 700]
    texts = ["".join(rng.choice(some) for _ in range(n)) for n in sizes for some in ("ab", "abé ü\n😀")] + ["ab" * 90, "x" * 200, "abcdefghi" * 40, "", "éü" * 90]
    rng.shuffle(texts)
    for at_once in (1, 23, 64, 100, 1 << 16):
        monkeypatch.setattr(chunkdedup, "AT_ONCE", at_once)
        found = chunkdedup.Chunks(pa.array(texts))
        ends = np.split(found.ends, np.searchsorted(found.ends, found.offsets[1:-1], "right"))
        assert [(e - o).tolist() for e, o in zip(ends, found.offsets[:-1], strict=True)] == [plain_cuts(t.encode()) for t in texts], at_once


def test_digests_with_one_half_in_common_stay_apart():
    rng = np.random.default_rng(6)
    for halves in (3, 1 << 62):  # few values: first numbers coincide; many: none does
        found = chunkdedup.Chunks(pa.array(["a"]))
        found.digests, found.rows = rng.integers(0, halves, (500, 2)).astype(np.uint64), np.arange(500)
        found.digests[250:] = found.digests[:250]
        ids = rng.integers(0, 90, 500)
        d, least, place = found.distinct(ids)
        pairs = list(map(tuple, found.digests.tolist()))
        assert list(map(tuple, d.tolist())) == sorted(set(pairs)) and [tuple(x) for x in d[place].tolist()] == pairs
        assert least.tolist() == [min(i for p, i in zip(pairs, ids.tolist(), strict=True) if p == q) for q in sorted(set(pairs))]


def test_chunk_dedup_by_plain_rule(spark):
    rng = random.Random(8)
    passages, _ = planted_passages(12)
    lines = [" ".join(rng.choice(WORDS) for _ in range(30)) for _ in range(4)]
    rows = [r for r in make() if r[0] not in (14, 15)][:-3] + [(i + 1000, t, *rest) for i, t, *rest in passages]
    rows += [(2000 + k, "\n".join(rng.choice(lines) for _ in range(6)), "en", "s", 0) for k in range(20)] + [(None, passages[3][1], "en", "s", 0)]
    rows = list({r[0]: r for r in rows}.values())
    rng.shuffle(rows)
    kept = plain_dedup(rows)
    got = {r.doc_id: r for r in chunkdedup.dedup(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    for (i, t, *_), want in zip(rows, kept, strict=True):
        assert (got[i].text or "").encode() == want and got[i].n_removed == len((t or "").encode()) - len(want), i
    assert sum(len(w) < len((t or "").encode()) for (_, t, *_), w in zip(rows, kept, strict=True)) > 20


def test_hinge_fit_against_dense_descent():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=60) > 0, 1, -1)
    cost = np.full(60, 0.5)
    w = linear.fit_hinge([(np.arange(8), v) for v in x], y, 8, cost, rounds=400, tolerance=1e-7)
    full = np.column_stack([x, np.ones(60)])

    def loss(v):
        return v @ v / 2 + (cost * np.maximum(0, 1 - y * (full @ v))).sum()

    best, v = np.inf, np.zeros(9)
    for step in range(1, 40_001):  # subgradient descent
        v = v - (v - ((cost * y * (y * (full @ v) < 1)) @ full)) / (step + 10)
        best = min(best, loss(v))
    assert loss(w) <= best + 1e-3


def test_scores_do_not_depend_on_layout(spark):
    rng = random.Random(4)
    words = "alpha beta gamma delta Epsilon ZETA eta! theta".split()
    rows = [(k, " ".join(rng.choices(words, k=30)), ("en", "de", "fr")[k % 3], "s", 1) for k in range(300)] + [(7, "alpha", "en", "s", 1)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(300)], "doc_id long, quality int, toxic int")
    tables = [spark.createDataFrame(rows, SCHEMA).repartition(n, "text") for n in (1, 7)]
    one, other = (sorted((r.doc_id, r.score, r.predicted) for r in quality.score_quality(t, labels).collect()) for t in tables)
    assert one == other
    one, other = (sorted((r.doc_id, r.lang_pred, r.score) for r in language.identify(t).collect()) for t in tables)
    assert one == other


def holds(text, item, width=5, threshold=0.8):
    def grams(t, n):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    n = min(width, len((item or "").split()))
    asked = grams(item, n) if n else set()
    return bool(asked) and len(asked & grams(text, n)) >= threshold * len(asked)


def test_pipeline_by_plain_rules(spark, tmp_path):
    """Every stage on planted cases: texts without letters, near copies, repeated passages, benchmark items, null and repeated ids."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(21)
    kinds = {"en": "the and with thing which there stone river".split(), "de": "der und nicht schön über straße haus".split()}
    rows = [(k, " ".join(rng.choices(kinds[lang], k=3)) + " " + " ".join(f"{lang}{rng.randrange(10**7)}" for _ in range(rng.randrange(8, 60))), lang, "s", 1) for k, lang in enumerate(["en", "de"] * 30)]
    rows += [(i + 100 if i is not None else None, t, *rest) for i, t, *rest in planted_copies()]
    passages, _ = planted_passages(8)
    rows += [(i + 500, t, *rest) for i, t, *rest in passages]
    items = [(1, " ".join(rows[3][1].split()[2:14])), (2, passages[2][1][:80]), (3, "never seen in any text at all"), (4, None), (5, rows[10][1].split()[5])]
    rows += [(600, None, "en", "s", 0), (601, "12 34 !!", "en", "s", 0), (602, "", None, "s", 0), (None, items[0][1], "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")

    def same(step, want):
        got = sorted((key((r.doc_id,)), r.text) for r in step.collect())
        assert got == sorted((key((i,)), t) for i, t in want)
        assert step.columns == docs.columns

    stages, step = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{tmp_path}/documents.parquet")
    held = [(i, t) for i, t, *_ in rows if any(c.isalpha() for c in t or "")]
    step = stages["language_id"](spark, step, str(tmp_path))
    same(step, held)
    groups = {}
    for (i, t), c in zip(held, components_of(held), strict=True):
        groups.setdefault(c, []).append((LARGE if i is None else i, i, t))
    held = [min(g, key=lambda r: r[0])[1:] for g in groups.values()]
    step = stages["simhash_near_dedup"](spark, step, str(tmp_path))
    same(step, held)
    kept = plain_dedup(held)
    held = [(i, b.decode()) for (i, _), b in zip(held, kept, strict=True) if b]
    step = stages["substring_dedup"](spark, step, str(tmp_path))
    same(step, held)
    clean = [(i, t) for i, t in held if not any(holds(t, x) for _, x in items)]
    assert 0 < len(clean) < len(held)
    step = stages["benchmark_decontamination"](spark, step, str(tmp_path))
    same(step, clean)
    tool = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = sorted((key((i,)), tool.encode(t, add_special_tokens=False).ids) for i, t in clean)
    last = stages["bpe_encoding"](spark, step, str(tmp_path)).collect()
    assert sorted((key((r.doc_id,)), r.ids) for r in last) == want
    assert all(r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() for r in last)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((key((r.doc_id,)), r.ids) for r in whole.collect()) == want


def components_of(rows):
    """A label of each row's group by exact five-word similarity of 0.8 or more, chains included."""

    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for _, t in rows]
    near = [[j for j, y in enumerate(sets) if x == y or (x | y and len(x & y) / len(x | y) >= 0.8)] for x in sets]
    label = list(range(len(rows)))
    while label != (label := [min(label[j] for j in own) for own in near]):
        pass
    return label

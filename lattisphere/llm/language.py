"""Language by hierarchical discrimination: the family first, then one-versus-one linear support vector machines inside it.

A text is the shares of its hashed byte runs (one to four bytes of letters, anything else as a space), each scaled by its
usual share. Family models (one against the rest) choose the family; inside it each pair of languages has its own model and
the most votes win, ties to the larger sum of margins. Models learn from a bounded sample (PER_LANGUAGE rows of each
language, drawn by hash); every whole text is scored where it is read, without a shuffle.

A null text, or one without a letter, is `und` with score 0. If nothing was learnt every text is `und`; with one language
every text with a letter is that one. The score is the least of the chosen models' certainties, 0.5 to 1. Repeated rows each
get a row; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import fit_hinge, fit_scale, logistic
from .shared import buffer_of, give_back, mix, slices, tidy

PER_LANGUAGE = 1000
DIM, ORDERS = 1 << 16, (1, 2, 3, 4)
# Language families by ISO 639-1 code; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "celtic": "br cy ga gd",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 32
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def family(code: str) -> str:
    return _FAMILY.get(code, code)


def _codes(texts: pa.Array):
    """For each order the hashed codes at every byte and the offsets of the texts."""
    data, offsets = buffer_of(texts)
    data = _PLAIN[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    lead = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E)]
    data[lead] += 0x20  # capital letters of Latin-1
    grams, run = [], np.zeros(len(data), np.uint64)
    for n in ORDERS:
        run = run.copy()
        run[: len(data) - n + 1] = (run[: len(data) - n + 1] << np.uint64(8)) | data[n - 1 :] if len(data) >= n else 0
        grams.append((mix(run + np.uint64(n << 40)) % np.uint64(DIM // len(ORDERS))).astype(np.int64) + (n - 1) * (DIM // len(ORDERS)))
    return grams, offsets


def _shares(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    grams, offsets = _codes(texts)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        parts = [np.unique(g[a : max(a, b - n + 1)], return_counts=True) for n, g in zip(ORDERS, grams, strict=True)]
        out.append((np.concatenate([i for i, _ in parts]), np.concatenate([c / max(1, b - a) for _, c in parts])))
    return out


class Model:
    """languages, the models' names and one column of weights for each."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.families = sorted({family(x) for x in languages})
        self.tasks = [("family", f, None) for f in self.families] if len(self.families) > 1 else []
        for f in self.families:
            self.tasks += [("pair", a, b) for a, b in itertools.combinations([x for x in languages if family(x) == f], 2)]
        self.weights, self.bias = np.zeros((DIM, len(self.tasks)), np.float32), np.zeros(len(self.tasks))

    def fit(self, rows: list, names: np.ndarray) -> None:
        usual = np.full(DIM, 1e-6)
        for at, share in rows:
            usual[at] += share / len(rows)
        scale = 1 / np.sqrt(usual)
        scaled = [(at, share * scale[at]) for at, share in rows]
        kin = np.array([family(x) for x in names])
        for k, (kind, a, b) in enumerate(self.tasks):
            use = np.arange(len(rows)) if kind == "family" else np.flatnonzero((names == a) | (names == b))
            y = np.where((kin if kind == "family" else names)[use] == a, 1, -1)
            own = [scaled[i] for i in use]
            w = fit_hinge(own, y, DIM, np.full(len(own), 1.0))
            slope = fit_scale(np.array([w[at] @ v + w[-1] for at, v in own]), y)
            self.weights[:, k], self.bias[k] = slope * w[:-1] * scale, slope * w[-1]

    def margins(self, texts: pa.Array) -> np.ndarray:
        grams, offsets = _codes(texts)
        out = np.zeros((len(offsets) - 1, len(self.tasks)))
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes)
        for n, g in zip(ORDERS, grams, strict=True):
            value = self.weights[g]
            if n > 1:  # runs that leave the text do not count
                beyond = (offsets[full + 1][:, None] - np.arange(1, n)[None, :]).ravel()
                value[np.maximum(beyond, np.repeat(offsets[full], n - 1))] = 0
            if len(full):
                out[full] += np.add.reduceat(value, offsets[full], axis=0, dtype=np.float64)
        return out / np.maximum(1, sizes)[:, None] + self.bias

    def choose(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        certain = logistic(margins)
        n = len(margins)
        place = {t: k for k, t in enumerate(self.tasks)}
        if len(self.families) > 1:
            own = margins[:, [place["family", f, None] for f in self.families]]
            kin = own.argmax(axis=1)
            score = np.maximum(0.5, logistic(own[np.arange(n), kin]))
        else:
            kin, score = np.zeros(n, int), np.ones(n)
        names = np.empty(n, object)
        for f_at, f in enumerate(self.families):
            rows = np.flatnonzero(kin == f_at)
            own = [x for x in self.languages if family(x) == f]
            votes, sums, least = (np.zeros((len(rows), len(own))) for _ in range(3))
            least[:] = 1
            for (i, a), (j, b) in itertools.combinations(enumerate(own), 2):
                m, c = margins[rows, place["pair", a, b]], certain[rows, place["pair", a, b]]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                sums[:, i] += m
                sums[:, j] -= m
                least[:, i], least[:, j] = np.minimum(least[:, i], c), np.minimum(least[:, j], 1 - c)
            best = (votes + sums / (1 + np.abs(sums).max(axis=1, keepdims=True)) / 2).argmax(axis=1) if len(rows) else np.zeros(0, int)
            names[rows] = np.array(own, object)[best]
            score[rows] = np.minimum(score[rows], np.maximum(0.5, least[np.arange(len(rows)), best]))
        return names.tolist(), score


def _letters(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter (a character of a Unicode category L)."""

    def one(x) -> bool:
        return x is not None and (_ASCII_LETTER.search(x) is not None or any(map(str.isalpha, x.decode("utf-8", "replace"))))

    return np.array([one(x) for x in texts.cast(pa.large_binary()).to_pylist()], bool)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of the documents whose lang and text are not null."""
    good = docs.select(F.xxhash64("doc_id", F.lit(5)).alias("coin"), F.xxhash64("doc_id", "lang", "text").alias("key"), "lang", "text").where("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in good.groupBy("lang").count().collect()}  # one row for each language
    if not counts:
        return None
    shares = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(per_language / n)) for k, n in sorted(counts.items())))
    drawn = good.where(F.pmod("coin", F.lit(1 << 30)) / float(1 << 30) < shares[F.col("lang")])  # some per_language rows each at any size

    def run(batches):
        for batch in batches:
            for piece in slices(batch, most=1 << 21):
                rows = _shares(piece.column("text"))
                yield pa.RecordBatch.from_arrays([piece.column("lang"), piece.column("key"), pa.array([a.tolist() for a, _ in rows], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in rows], pa.list_(pa.float32()))], ["lang", "key", "at", "share"])

    table = drawn.select("lang", "key", "text").mapInArrow(tidy(run), "lang string, key long, at array<int>, share array<float>").toArrow()
    if not table.num_rows:
        return None
    at, share = table.column("at").combine_chunks(), table.column("share").combine_chunks()
    edges, flat, values = at.offsets.to_numpy().astype(np.int64), at.values.to_numpy(), share.values.to_numpy()
    order = pc.sort_indices(table.select(["key", "lang"]), [("key", "ascending"), ("lang", "ascending")]).to_numpy()  # the same however the files are laid out
    names = np.array(table.column("lang").to_pylist(), object)[order]
    model = Model(sorted(set(names.tolist())))
    model.fit([(flat[edges[k] : edges[k + 1]], values[edges[k] : edges[k + 1]].astype(np.float64)) for k in order.tolist()], names)
    del table, at, share, flat, values
    give_back()  # of the driver
    return model


def predicted(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs with the language and its score under these names, which take the place of columns of the same name."""
    docs = docs.drop(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights for each pair of languages

    def run(batches):
        model = held.value
        for batch in batches:
            for piece in slices(batch, most=1 << 21):
                texts = piece.column("text")
                found, score = model.choose(model.margins(texts)) if model else (["und"] * len(texts), np.zeros(len(texts)))
                good = _letters(texts)
                found = [x if ok else "und" for x, ok in zip(found, good, strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(found, pa.string()), pa.array(np.where(good, score, 0.0))], [*piece.schema.names, *names])

    return docs.mapInArrow(tidy(run), f"{fields}, `{names[0]}` string, `{names[1]}` double")


def held_out(of: int = 4, kept_out: int = 2):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string")), F.lit(of)) == kept_out, F.lit(False))


def identify(docs: DataFrame, of: int = 4, kept_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows whose crc32(doc_id) mod `of` is kept_out are not learnt from."""
    fold = held_out(of, kept_out)
    model = fit(docs.where(~fold))
    return predicted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", fold.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, of: int = 4, kept_out: int = 2) -> DataFrame:
    """The documents with a language, with their own columns: those that are `und` (null, or without a letter) go."""
    model = fit(docs.where(~held_out(of, kept_out)))
    own = [next(n for k in itertools.count() if (n := f"__{name}{k}") not in docs.columns) for name in ("language", "certainty")]
    return predicted(docs, model, (own[0], own[1])).where(F.col(own[0]) != "und").select(*[F.col(f"`{c}`") for c in docs.columns])

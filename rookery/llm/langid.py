"""Language ID by nearest centroids.

A text becomes the TF-IDF vector of its hashed byte trigrams (square-root term frequency, unit length). Each learnt
language has several centroids, found by spherical k-means of its training vectors. The language of the centroid with
the largest cosine wins. A text whose best cosine is below its language's distance bound for its number of trigrams is rejected.
The bounds are half of the 1% quantile of the cosines between each half of the language's training texts and centroids of the
other half, by powers of two of the number of trigrams; neighbouring powers are added until they hold `AT_LEAST` texts. A language
of a single training text has the bound zero.

Bound of the fit: about `max_rows` documents, shared equally by the languages (a hash of the id chooses them), whole
texts; prediction reads every whole text.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected; without learnable rows all
texts are `und`; ties go to the language that sorts first; repeated rows each get a row; an empty table gives an empty
result; other columns are kept by `only_known`, else ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, share_of, texts, tidy

DIMS = 8192
_SHIFT = np.uint32(32 - DIMS.bit_length() + 1)
#: ASCII that is no letter becomes a space.
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
BLOCK = 1 << 20
#: Training texts that a distance bound rests on, where the language has as many; powers of two of the number of trigrams.
AT_LEAST = 50
POWERS = 48
_MULT = np.uint32(2654435761)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts(text: str | None) -> np.ndarray:
    """How often each hashed trigram of the lower-cased text occurs; runs of other characters count as one space."""
    total = np.zeros(DIMS, np.int64)
    text = text or ""
    for at in range(0, len(text), BLOCK):
        data = b" " + b" ".join(text[at : at + BLOCK].lower().encode("utf-8").translate(_FOLD).split()) + b" "
        a = np.frombuffer(data, np.uint8).astype(np.uint32)
        if len(a) > 2:
            total += np.bincount((((a[:-2] << 16) | (a[1:-1] << 8) | a[2:]) * _MULT) >> _SHIFT, minlength=DIMS)
    return total


def power(n: np.ndarray) -> int:
    return min(POWERS - 1, int(n.sum(dtype=np.int64)).bit_length())


class Centroids:
    def __init__(self, langs: list[str], idf: np.ndarray, centres: np.ndarray, of: np.ndarray, bounds: np.ndarray):
        self.langs, self.idf, self.centres, self.of, self.bounds = langs, idf, centres, of, bounds

    def vector(self, n: np.ndarray) -> np.ndarray:
        v = np.sqrt(n, dtype=np.float32) * self.idf
        length = float(np.sqrt(v @ v))
        return v / length if length else v

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine between 0 and 1, rejected)"""
        if not self.langs or not has_letter(text):
            return "und", 0.0, True
        n = counts(text)
        cosines = self.centres @ self.vector(n)
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.langs[self.of[best]], score, score < float(self.bounds[self.of[best], power(n)])


def fit(rows: list[tuple[str, np.ndarray]], per_lang: int = 3, rounds: int = 8) -> Centroids:
    """From (language, trigram counts) of the training documents."""
    if not rows:
        return Centroids([], np.zeros(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros((0, POWERS)))
    langs = sorted({x for x, _ in rows})
    seen = np.zeros(DIMS)
    for _, n in rows:
        seen += n > 0
    idf = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + np.float32(0.1)
    shape = Centroids(langs, idf, np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros((0, POWERS)))
    centres, of, bounds = [], [], []
    for k, lang in enumerate(langs):
        x = np.stack([shape.vector(n) for y, n in rows if y == lang])
        c = _centres(x, per_lang, rounds)
        centres += list(c)
        of += [k] * len(c)
        bounds.append(_bounds(x, np.array([power(n) for y, n in rows if y == lang]), per_lang, rounds))
    return Centroids(langs, idf, np.stack(centres), np.array(of), np.stack(bounds))


def _centres(x: np.ndarray, per_lang: int, rounds: int) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    order = np.argsort(-(x @ x.mean(axis=0)), kind="stable")
    c = x[order[np.linspace(0, len(x) - 1, min(per_lang, len(x))).astype(int)]]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = np.stack([_unit(x[near == j].sum(axis=0)) if (near == j).any() else c[j] for j in range(len(c))])
    return c


def _bounds(x: np.ndarray, powers: np.ndarray, per_lang: int, rounds: int) -> np.ndarray:
    """The least cosine that is not rejected, by power of two of the number of trigrams."""
    if len(x) < 2:
        return np.zeros(POWERS)
    best = np.zeros(len(x))
    for half in (0, 1):
        best[half::2] = (x[half::2] @ _centres(x[1 - half :: 2], per_lang, rounds).T).max(axis=1)
    out, apart = [], np.abs(powers[:, None] - np.arange(POWERS))
    for p in range(POWERS):
        width = np.sort(apart[:, p])[min(AT_LEAST, len(x)) - 1]
        out.append(np.quantile(best[apart[:, p] <= width], 0.01) / 2)
    return np.maximum(out, 0.0)


def _unit(v: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(v)
    return v / length if length else v


def learn(docs: DataFrame, max_rows: int = 3000, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 3, skip: int = 1) -> Centroids:
    """Learns from the whole texts of about max_rows documents with a language, but of none whose crc32(key) mod folds is skip."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (crc_mod(F.col(key), folds) != skip)).select(key, text, lang)
    have = {r[lang]: r["count"] for r in rows.groupBy(lang).count().collect()}
    if not have:
        return fit([])
    share = max(1, max_rows // len(have))
    part = F.create_map(*[F.lit(x) for name, n in sorted(have.items()) for x in (name, min(2.0, share / n))])
    wanted = rows.where(share_of(F.col(key)) < part[F.col(lang)])
    bounded_batches(docs.sparkSession)

    def work(batches):
        for b in batches:
            known = [t.as_py() for t in b.column(0)]
            n = [np.minimum(counts(t), 65535).astype("<u2").tobytes() for t in known]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.binary()), b.column(1), pa.array([has_letter(t) for t in known])], ["n", "lang", "letter"])

    got = wanted.select(text, F.col(lang).alias("lang")).mapInArrow(tidy(work), "n binary, lang string, letter boolean").where("letter").drop("letter").toArrow()
    pairs = sorted(zip(got.column(1).to_pylist(), got.column(0).to_pylist(), strict=True))
    return fit([(y, np.frombuffer(n, "<u2")) for y, n in pairs])


def predict(docs: DataFrame, model: Centroids, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, rejected) of every document; no shuffle."""
    rows = texts(docs, key, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for b in batches:
            out = [sent.value.predict(t.as_py()) for t in b.column(1)]
            columns = [pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [key, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(tidy(work), f"`{key}` {dict(rows.dtypes)[key]}, lang_pred string, score double, rejected boolean")


def languages(docs: DataFrame, key: str = "doc_id", folds: int = 3, skip: int = 1, **more) -> DataFrame:
    """(key, held_out, lang_pred, score, rejected)"""
    found = predict(docs, learn(docs, key=key, folds=folds, skip=skip, **more), key)
    return found.select(key, (crc_mod(F.col(key), folds) == skip).alias("held_out"), "lang_pred", "score", "rejected")


def only_known(docs: DataFrame, model: Centroids, text: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns; no shuffle."""
    bounded_batches(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def work(batches):
        for b in batches:
            yield b.filter(pa.array([not sent.value.predict(t.as_py())[2] for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(tidy(work), docs.schema)

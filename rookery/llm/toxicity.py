"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its lower-cased words and their stems, word pairs, and pairs that skip a
word. FTRL-proximal
gives each coordinate its own rate and, by its L1 term, exact zeros; what is left is a short list of weights, at most
2^20 numbers whatever the corpus, which goes to all executors.

Bound of the fit: about `max_rows` labelled documents (a hash of the id chooses them); scoring reads every whole text.

Defined results: null and empty texts and texts without words get the intercept's score; without labelled rows the
score is 0.5 for all; a label of null is no label; repeated rows each get a row; documents labelled twice count twice
in the fit; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, sampled, bounded_batches, texts, word_blocks

BITS = 20
#: Lower-cases ASCII; other ASCII that is no letter, digit or apostrophe parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c == 39 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Lengths of the stems that stand beside each longer word, so that unseen endings are known.
STEMS = (4, 5, 6, 7)
_PAIR, _SKIP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


class _Words(dict):
    """The row in `hashes` of each word seen lately: the hash of the word, then of its stems (its first characters)."""

    SIZE = 200_000

    def __init__(self):
        super().__init__()
        self.hashes = np.zeros((self.SIZE, 1 + len(STEMS)), np.uint64)

    def __missing__(self, word: bytes) -> int:
        row = len(self)
        if row >= self.SIZE:
            raise _Full
        whole = xxhash.xxh64_intdigest(word)
        text = word.decode("utf-8", "replace")
        self.hashes[row] = [whole] + [xxhash.xxh64_intdigest(text[:n], n) if len(text) > n else whole for n in STEMS]
        self[word] = row
        return row

    def of(self, words: list[bytes]) -> np.ndarray:
        for part in range(0, len(words), self.SIZE // 2):
            own = words[part : part + self.SIZE // 2]
            try:
                rows = np.fromiter(map(self.__getitem__, own), np.int64, len(own))
            except _Full:
                self.clear()
                rows = np.fromiter(map(self.__getitem__, own), np.int64, len(own))
            yield self.hashes[rows]


class _Full(Exception):
    pass


_known = _Words()


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers below 2^BITS."""
    found = []
    for words in word_blocks((text or "").encode("utf-8").translate(_FOLD), 2):
        for table in _known.of(words):
            h = table[:, 0]
            for x in (table.ravel(), h[:-1] * _PAIR + h[1:], h[:-2] * _SKIP + (h[2:] ^ _PAIR)):
                x = (x ^ (x >> np.uint64(33))) * _MIX
                found.append((x >> np.uint64(64 - BITS)).astype(np.int32))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


class Ftrl:
    """FTRL-proximal (McMahan et al., 2013) for binary features; coordinate 2^BITS is the intercept, without L1."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0):
        self.alpha, self.beta, self.l2 = alpha, beta, l2
        self.z, self.n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)
        self.l1 = np.full(2**BITS + 1, l1)
        self.l1[-1] = 0

    def weights(self, at) -> np.ndarray:
        z, l1 = self.z[at], self.l1[at]
        w = (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = logistic(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(examples: list[tuple[np.ndarray, int]], epochs: int = 8) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature numbers, their weights, intercept)"""
    model, order = Ftrl(), np.random.default_rng(5)
    own = [(np.append(x, 2**BITS), y) for x, y in examples]
    for _ in range(epochs if own else 0):
        for i in order.permutation(len(own)):
            model.learn(*own[i])
    w = model.weights(slice(None))
    at = np.flatnonzero(w[:-1])
    return at.astype(np.int32), w[at].astype(np.float32), float(w[-1])


def examples(docs: DataFrame, labels: DataFrame, max_rows: int, key: str, text: str, label: str) -> list[tuple[np.ndarray, int]]:
    """Features of about max_rows labelled documents; the sample of labels is small and is sent to the documents."""
    known = sampled(labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("y")), max_rows, key)
    bounded_batches(docs.sparkSession)
    rows = docs.select(key, text).join(F.broadcast(known), key).select(text, "y")

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([features(t.as_py()).tobytes() for t in b.column(0)], pa.binary()), b.column(1)], ["x", "y"]
            )

    got = rows.mapInArrow(work, "x binary, y int").toArrow()
    pairs = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    return [(np.frombuffer(x, np.int32), y) for x, y in pairs]


def score(docs: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every document; no shuffle."""
    rows = texts(docs, key, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        at, w, bias = sent.value
        dense = np.zeros(2**BITS, np.float32)
        dense[at] = w
        for b in batches:
            s = [float(logistic(bias + dense[features(t.as_py())].sum(dtype=np.float64))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], [key, "score"])

    return rows.mapInArrow(work, f"`{key}` {dict(rows.dtypes)[key]}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 10000, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5) -> DataFrame:
    """(key, held_out, score, predicted); rows whose crc32(key) mod folds is 0 are never learnt from."""
    learnable = labels.where(crc_mod(F.col(key), folds) != 0)
    model = fit(examples(docs, learnable, max_rows, key, text, label))
    return score(docs, model, key, text).select(
        key, (crc_mod(F.col(key), folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )

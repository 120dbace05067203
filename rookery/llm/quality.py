"""Quality rules: hard rules on counts, then gradient-boosted trees over document statistics.

The trees are grown on histograms with Newton steps of the logistic loss. Features that may only speak for or against a
document have a monotone constraint: a split against it is not taken, and the values below a taken split stay on their
side of its middle. The fitted trees are flattened into node arrays (feature, threshold, child, value) which score a
whole batch of documents level by level with numpy.

Bound of the fit: about `max_rows` labelled documents (a hash of the id chooses them); statistics and scores read
every whole text.

Defined results: a null text counts as empty: no words, base_failed; without labelled rows the rules alone decide;
repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, sampled, bounded_batches, texts

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Statistics and their constraints: -1 where more can only speak against a document, 1 for, 0 free.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "duplicate_lines": -1, "repeated_words": -1,
    "distinct_words": 0, "upper_case": -1, "exclamations_per_word": -1, "stops_per_word": 0, "digits": 0, "words_per_line": 0,
}
CONSTRAINTS = np.array(list(FEATURES.values()))


def repeated_words(ids: np.ndarray, window: int = 3) -> int:
    """Words inside windows of consecutive words that occur twice or more."""
    n = len(ids)
    if n <= window:
        return 0
    code = ids[: n - window + 1]
    for k in range(1, window):
        top = int(ids.max()) + 1
        if int(code.max() + 1) * top >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
        code = code * top + ids[k : n - window + 1 + k]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(code), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for k in range(window):
        hit[k : n - window + 1 + k] |= twice
    return int(hit.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """([n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words], features)"""
    text = text or ""
    data = text.encode("utf-8")
    words = data.split()
    n = len(words)
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[bytes] = set()
    lines = duplicates = 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                duplicates += 1
            else:
                seen.add(line)
    repeats = repeated_words(ids)
    per, chars = max(n, 1), max(word_chars, 1)
    small = np.frombuffer(data, np.uint8)
    kinds = np.bincount(small, minlength=256)
    shape = [
        np.log1p(n), word_chars / per, symbols / per, duplicates / max(lines, 1), repeats / per, len(known) / per,
        kinds[65:91].sum() / chars, kinds[33] / per, (kinds[46] + kinds[44]) / per, kinds[48:58].sum() / chars, n / max(lines, 1),
    ]
    return [n, word_chars, symbols, duplicates, repeats], [float(x) for x in shape]


class Trees:
    """Flattened trees: node i of a tree goes to child[i] if its feature is at most threshold[i], else to child[i] + 1; leaves go to themselves."""

    def __init__(self, bias: float):
        self.bias = bias
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.depth = 0

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, threshold, child, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                leaf = child[at] == 0
                at = np.where(leaf, at, child[at] + (x[rows, feature[at]] > threshold[at]))
            total += value[at]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -35, 35)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0, bins: int = 64, least: float = 5.0) -> Trees:
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(p / (1 - p))))
    model.depth = depth
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    score = np.full(len(x), model.bias)
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-score))
        tree, value_of = _grow(binned, cuts, prob - y, prob * (1 - prob), depth, l2, bins, least)
        feature, threshold, child, value = tree
        model.trees.append((feature, threshold, child, value * rate))
        score += rate * value_of
    return model


def _grow(binned, cuts, g, h, depth, l2, bins, least):
    feature, threshold, child, value = [0], [0.0], [0], [0.0]
    at = np.zeros(len(g), np.int64)
    open_nodes = {0: (-np.inf, np.inf)}
    leaf = lambda a, b, bound: float(np.clip(-a / (b + l2), *bound))
    value[0] = leaf(g.sum(), h.sum(), open_nodes[0])
    for _ in range(depth):
        after = {}
        for node, bound in open_nodes.items():
            own = np.flatnonzero(at == node)
            best = _split(binned[own], cuts, g[own], h[own], bound, l2, bins, least)
            if best is None:
                continue
            j, b, left, right = best
            feature[node], threshold[node], child[node] = j, float(cuts[j][b]), len(child)
            for v in (left, right):
                feature.append(0), threshold.append(0.0), child.append(0), value.append(v)
            middle, c = (left + right) / 2, CONSTRAINTS[j]
            low, high = bound
            after[child[node]] = (low, middle) if c > 0 else (middle, high) if c < 0 else bound
            after[child[node] + 1] = (middle, high) if c > 0 else (low, middle) if c < 0 else bound
            at[own] = child[node] + (binned[own, j] > b)
        open_nodes = after
    arrays = (np.array(feature), np.array(threshold), np.array(child), np.array(value))
    return arrays, arrays[3][at]


def _split(binned, cuts, g, h, bound, l2, bins, least):
    total_g, total_h, best, best_gain = g.sum(), h.sum(), None, 1e-6
    for j, c in enumerate(cuts):
        if not len(c):
            continue
        gl = np.cumsum(np.bincount(binned[:, j], g, minlength=len(c) + 1))[:-1]
        hl = np.cumsum(np.bincount(binned[:, j], h, minlength=len(c) + 1))[:-1]
        gr, hr = total_g - gl, total_h - hl
        left, right = np.clip(-gl / (hl + l2), *bound), np.clip(-gr / (hr + l2), *bound)
        n = np.cumsum(np.bincount(binned[:, j], minlength=len(c) + 1))[:-1]
        gain = -(gl * left + (hl + l2) / 2 * left**2 + gr * right + (hr + l2) / 2 * right**2)
        whole = np.clip(-total_g / (total_h + l2), *bound)
        gain += total_g * whole + (total_h + l2) / 2 * whole**2
        bad = (n < least) | (len(binned) - n < least) | (CONSTRAINTS[j] * (right - left) < 0)
        gain[bad] = -1
        k = int(np.argmax(gain))
        if gain[k] > best_gain:
            best_gain, best = gain[k], (j, k, float(left[k]), float(right[k]))
    return best


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 12000, key: str = "doc_id", text: str = "text", label: str = "quality") -> Trees | None:
    """Trees from about max_rows labelled documents; None without rows of both labels."""
    known = sampled(labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("y")), max_rows, key)
    bounded_batches(docs.sparkSession)
    rows = docs.select(key, text).join(F.broadcast(known), key).select(text, "y")

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([statistics(t.as_py())[1] for t in b.column(0)], pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    got = rows.mapInArrow(work, "x array<double>, y int").toArrow()
    pairs = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    y = np.array([p[1] for p in pairs], float)
    if not len(y) or y.min() == y.max():
        return None
    return boost(np.array([p[0] for p in pairs]), y)


def judged(docs: DataFrame, model: Trees | None, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score); no shuffle."""
    rows = texts(docs, key, text)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            both = [statistics(t.as_py()) for t in b.column(1)]
            n = np.array([x[0] for x in both], np.int64)
            failed = (n[:, 0] < 50) | (100 * n[:, 4] > 50 * n[:, 0])
            score = sent.value.probability(np.array([x[1] for x in both])) if sent.value else np.ones(len(n))
            columns = [*(pa.array(c) for c in n.T), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [key, *names, "base_failed", "kept", "score"])

    schema = f"`{key}` {dict(rows.dtypes)[key]}, {', '.join(f'{n} bigint' for n in names)}, base_failed boolean, kept boolean, score double"
    return rows.mapInArrow(work, schema)


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", folds: int = 5, **more) -> DataFrame:
    """Judges every document; rows whose crc32(key) mod folds is 0 are never learnt from."""
    model = learn(docs, labels.where(crc_mod(F.col(key), folds) != 0), key=key, **more)
    return judged(docs, model, key)

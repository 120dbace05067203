"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Each template's word shingles are hashed; of every `window` neighbouring hashes the least is kept (winnowing), so a text
that shares `shingle + window - 1` words in a row with a template shares a kept fingerprint. The kept fingerprints of all
templates form an inverted index. All of a text's shingles are looked up; hits on neighbouring diagonals (place in the text
minus place in the template) form a candidate, and a banded alignment around the diagonal counts the template words that
stand in the text in order. What is left of a candidate after a match is aligned again until no match is found. Candidates of one
template that are no match by themselves are chained, if their diagonals are at most the template's words (and the band) apart,
and aligned together within their bands, so that a passage put into a notice or missing from it does not hide it. Matches that cover enough of their template are reported with their span in characters;
of matches that overlap, the one with more matched words stays, then the higher coverage, then the name that sorts first.

The index holds the templates alone, so its size is bounded by theirs; documents are never shuffled.

Defined results: null and empty texts have no match; a text is aligned with as many candidates as it has, none is dropped;
repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import texts, word_blocks
from .license_texts import TEMPLATES

#: A-Z to a-z; ASCII that is neither letter nor digit parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TABLE_BITS = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_known = _Hashes()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    h = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(31))) * _MIX + h[k : k + n]
    return out


def winnowed(hashes: np.ndarray, window: int) -> list[int]:
    """Places of the least hash (the last on ties) of every window; all of them if there are fewer than a window."""
    if len(hashes) <= window:
        return [int(np.argmin(hashes))] if len(hashes) else []
    kept = {i + window - 1 - int(np.argmin(hashes[i : i + window][::-1])) for i in range(len(hashes) - window + 1)}
    return sorted(kept)


class Scanner:
    def __init__(self, templates: dict[str, str], shingle: int = 3, window: int = 2, coverage: float = 0.75, band: int = 8):
        self.shingle, self.coverage, self.band = shingle, coverage, band
        self.names = sorted(templates)
        self.words = [templates[n].encode("utf-8").translate(_FOLD).split() for n in self.names]
        self.bags = [Counter(w) for w in self.words]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            hashes = shingle_hashes(words, min(shingle, max(len(words), 1)))
            for at in winnowed(hashes, window):
                self.index.setdefault(int(hashes[at]), []).append((t, at))
        self.seen = np.zeros(1 << _TABLE_BITS, bool)
        for h in self.index:
            self.seen[h >> (64 - _TABLE_BITS)] = True

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, start, end) of each match, in text order; start and end count characters."""
        data = (text or "").encode("utf-8")
        flat, matches, before = data.translate(_FOLD), [], 0  # before: words in earlier blocks
        carry = 3 * max(map(len, self.words), default=0) + 4 * self.band
        for words in word_blocks(flat, carry):
            first = before - min(carry, before)
            matches += [(t, c, m, a + first, b + first) for t, c, m, a, b in self._scan(words)]
            before = first + len(words)
        matches = _apart(sorted(set(matches)), self.names)
        if not matches:
            return []
        spots = [m.span() for m in _WORD.finditer(flat)]
        chars = lambda n: len(data[:n].decode("utf-8", "ignore"))
        return [(self.names[t], c, m, chars(spots[a][0]), chars(spots[b - 1][1])) for t, c, m, a, b in matches]

    def _scan(self, words: list[bytes]):
        hashes = shingle_hashes(words, self.shingle)
        spots = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        by_template: dict[int, list[tuple[int, int]]] = {}
        for at in spots.tolist():
            for t, place in self.index.get(int(hashes[at]), ()):
                by_template.setdefault(t, []).append((at - place, at))
        for t, hits in by_template.items():
            hits.sort()
            open_groups: list[list[tuple[int, int]]] = []
            found: list[tuple[float, int, int, int]] = []
            for group in _split(hits, self.band):
                new = list(self._matches(words, t, group))
                found += new
                rest = [h for h in group if all(not a <= h[1] < b for _, _, a, b in new)]
                if rest:
                    open_groups += _split(rest, self.band)
            open_groups.sort()
            for i, first in enumerate(open_groups):
                reach = first[0][0] + len(self.words[t]) + self.band
                chain = [g for g in open_groups[i:] if g[0][0] <= reach]
                if len(chain) > 1:
                    start, end = chain[0][0][0], chain[-1][-1][0] + len(self.words[t])
                    new = self._align(words, t, [(g[0][0], g[-1][0]) for g in chain], max(0, start - self.band), end + self.band)
                    if new:
                        found.append(new)
            yield from ((t, *f) for f in found)

    def _matches(self, words: list[bytes], t: int, hits: list[tuple[int, int]]):
        """All matches around the hits (diagonal, place), which are in order; of a long row of copies some at a time."""
        size, used = len(self.words[t]), 0
        while hits:
            low = hits[0][0]
            part = [d for d, _ in hits[: bisect_right(hits, (low + size, 1 << 60))]]
            pieces = [(max(used, low - self.band), part[-1] + size + self.band)]
            ends = []
            while pieces:
                start, end = pieces.pop()
                new = self._align(words, t, [(low, part[-1])], start, end)
                if new:
                    yield new
                    ends.append(new[3])
                    pieces += [(start, new[2]), (new[3], end)]
            if ends:
                used = max(ends)
                hits = [h for h in hits if h[1] >= used]
            else:
                hits = hits[bisect_right(hits, (max(low, low + size - 2 * self.band), 1 << 60)) :]

    def _align(self, words: list[bytes], t: int, diagonals: list[tuple[int, int]], start: int, end: int):
        """Longest common subsequence of the template and the words from start to end within `band` of the diagonals, given as
        ranges from the least to the greatest."""
        own = self.words[t]
        start, end = max(0, start), min(len(words), end)
        part = words[start:end]
        width = end - start
        if not own or width < self.coverage * len(own) or (self.bags[t] & Counter(part)).total() < self.coverage * len(own):
            return None
        # with the text used up to j: matched words, places of the first and the last of them
        count, first, last = [0] * (width + 1), [-1] * (width + 1), [-1] * (width + 1)
        for i, w in enumerate(own):
            c, f, z = count[:], first[:], last[:]
            done = 0
            for low, high in diagonals:
                a = min(width, max(done, low - self.band + i - start))
                b = max(a, min(width, high + self.band + i - start + 1))
                for j in range(done, a):
                    if c[j] <= c[j + 1]:
                        break
                    c[j + 1], f[j + 1], z[j + 1] = c[j], f[j], z[j]
                for j in range(a, b):
                    if part[j] == w and count[j] + 1 > c[j + 1]:
                        c[j + 1], f[j + 1], z[j + 1] = count[j] + 1, first[j] if count[j] else j, j
                    if c[j] > c[j + 1]:
                        c[j + 1], f[j + 1], z[j + 1] = c[j], f[j], z[j]
                done = b
            for j in range(done, width):
                if c[j] <= c[j + 1]:
                    break
                c[j + 1], f[j + 1], z[j + 1] = c[j], f[j], z[j]
            count, first, last = c, f, z
        matched = count[width]
        if matched < self.coverage * len(own):
            return None
        return matched / len(own), matched, start + first[width], start + last[width] + 1


def _split(hits: list[tuple[int, int]], band: int) -> list[list[tuple[int, int]]]:
    """Hits in order, parted where neighbouring diagonals are more than `band` apart."""
    out: list[list[tuple[int, int]]] = []
    for h in hits:
        if not out or h[0] - out[-1][-1][0] > band:
            out.append([])
        out[-1].append(h)
    return out


def _apart(matches, names):
    """Of overlapping matches the best one."""
    kept = []
    for m in sorted(matches, key=lambda m: (-m[2], -m[1], names[m[0]], m[3])):
        if all(m[4] <= k[3] or m[3] >= k[4] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m[3])


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """(key, n_matches, licenses, best_coverage, matches): licenses are the distinct names, sorted and comma-joined (null: none);
    matches is JSON, a list of [name, coverage, matched words, start, end]. No shuffle."""
    rows = texts(docs, key, text)
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates, **more))

    def work(batches):
        for b in batches:
            found = [sent.value.scan(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([",".join(sorted({m[0] for m in f})) or None for f in found], pa.string()),
                    pa.array([max((m[1] for m in f), default=0.0) for f in found], pa.float64()),
                    pa.array([json.dumps(f) for f in found], pa.string()),
                ],
                [key, "n_matches", "licenses", "best_coverage", "matches"],
            )

    return rows.mapInArrow(work, f"`{key}` {dict(rows.dtypes)[key]}, n_matches bigint, licenses string, best_coverage double, matches string")

"""Byte-level BPE by the backtracking encoder; decoding by an offset table.

A piece's tokens are found from the left: an Aho-Corasick automaton over the reversed tokens reports the longest token
that starts at every byte, a token is taken if it is compatible with the one before it, else the next shorter prefix
token is tried, and where none fits, the last token is taken back. Each end position is given up at most once, so the
work is linear in the piece. Two tokens are compatible if merging their bytes in merge order never joins bytes across
their border; the answers are kept in a table. This gives exactly the tokens of merging by rank.

Pieces of ordinary length that a block has for the first time go this way together, one lane each: a lane's longest tokens come
from the trie of tokens, and lanes take, shorten or give back their tokens in the same step. Longer ones run the automaton alone.

Decoding gathers the bytes of all tokens from one byte string through a table of offsets, then reads UTF-8 with
replacement characters for what is malformed.

Defined results: null and empty texts have no tokens and decode to the empty text; special tokens' strings in a text
become special tokens; repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import quoted, texts, tidy

#: How byte-level BPE cuts a text into pieces, a fixed value of the format.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _narrow_pieces() -> re.Pattern:
    """PIECES for texts of characters below U+10000, with the classes written out, which the plain engine runs in half the time."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    letter, number, space = (
        "".join(f"\\u{ord(m[0][0]):04x}-\\u{ord(m[0][-1]):04x}" for m in regex.finditer(kind, every)) for kind in (r"\p{L}+", r"\p{N}+", r"\s+")
    )
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


_NARROW = _narrow_pieces()
#: No piece reaches over a single space between two other characters.
_SAFE_CUT = regex.compile(r"(?<=[^\s]) (?=[^\s])")
BLOCK_CHARS = 1 << 19
#: Characters of short texts whose pieces are looked up together.
GROUP_CHARS = 1 << 18
KEPT_PIECES = 100_000
#: Bytes of the longest piece that is encoded beside others.
LANE_BYTES = 256
#: Slots of the table of pairs of tokens, a power of two.
KEPT_PAIRS = 1 << 18
_NEVER = 1 << 60


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class _Table:
    """Values under whole numbers from 0, by open addressing; both in one number of 64 bits."""

    VALUE_BITS = 20

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        entries, at, left = keys << self.VALUE_BITS | values, self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = entries[free]
            left = left[self.slots[at[left]] != entries[left]]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, -1 where there is none."""
        at = self._home(keys)
        found = self.slots[at]
        out = np.where(found >> self.VALUE_BITS == keys, found & ((1 << self.VALUE_BITS) - 1), -1)
        left = np.flatnonzero((out < 0) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
            found = self.slots[at[left]]
            same = found >> self.VALUE_BITS == keys[left]
            out[left[same]] = found[same] & ((1 << self.VALUE_BITS) - 1)
            left = left[~same & (found >= 0)]
        return out


class Bpe:
    def __init__(self, text: str):
        """text: a tokenizer's JSON."""
        spec = json.loads(text)
        model, of_char = spec["model"], byte_characters()
        raw = lambda token: bytes(of_char[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        # tokens in order of birth: bytes, then merges
        self.bytes_of: list[bytes] = []
        self.id_of: list[int] = []
        self.parts: list[tuple[int, int] | None] = []
        self.joined: dict[tuple[int, int], int] = {}
        born: dict[str, int] = {}
        for c, b in sorted(of_char.items(), key=lambda x: x[1]):
            if c in model["vocab"]:
                born[c] = len(self.bytes_of)
                self._add(bytes([b]), model["vocab"][c], None)
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            whole = left + right
            if whole not in born:
                born[whole] = len(self.bytes_of)
                self._add(raw(whole), model["vocab"][whole], (born[left], born[right]))
            self.joined.setdefault((born[left], born[right]), born[whole])
        self.n_bytes_tokens = sum(p is None for p in self.parts)
        self.length = [len(b) for b in self.bytes_of]
        self._known_pairs = np.full(KEPT_PAIRS, -1, np.int64)
        self._compatible = memoryview(self._known_pairs)
        self._automaton()
        self._lanes()
        self._offsets(model["vocab"], raw)
        self.cache = _Pieces(self)

    def _add(self, data: bytes, token_id: int, parts) -> None:
        self.bytes_of.append(data)
        self.id_of.append(token_id)
        self.parts.append(parts)

    def _automaton(self) -> None:
        self.longest = ahocorasick.Automaton()
        known = {}
        for t, data in enumerate(self.bytes_of):
            known[data] = t
            self.longest.add_word(data[::-1].decode("latin-1"), t)
        self.longest.make_automaton()
        self.shorter = [next((known[d[:n]] for n in range(len(d) - 1, 0, -1) if d[:n] in known), -1) for d in self.bytes_of]

    def _lanes(self) -> None:
        """What lanes of pieces look up: the trie's edges and the tokens at its nodes, merges, halves, lengths."""
        edges: dict[int, int] = {}
        token_at = [-1]
        for t, data in enumerate(self.bytes_of):
            node = 0
            for byte in data:
                node = edges.setdefault(node << 8 | byte, len(edges) + 1)
            token_at += [-1] * (len(edges) + 1 - len(token_at))
            token_at[node] = t
        numbers = lambda x: np.fromiter(x, np.int64)
        self._edges = _Table(numbers(edges), numbers(edges.values()))
        self._token_at = np.array(token_at)
        self._merges = _Table(numbers(a << 20 | b for a, b in self.joined), numbers(self.joined.values()))
        self._left, self._right = (numbers(-1 if p is None else p[i] for p in self.parts) for i in (0, 1))
        self._lengths, self._shorter, self._id_of = np.array(self.length), np.array(self.shorter), np.array(self.id_of, "<u4")

    def _offsets(self, vocab: dict[str, int], raw) -> None:
        by_id = {i: raw(t) for t, i in vocab.items() if all(c in _CHARACTERS for c in t)} | {i: s.encode() for s, i in self.special.items()}
        size = max(by_id) + 1
        self.lengths = np.zeros(size, np.int64)
        for i, d in by_id.items():
            self.lengths[i] = len(d)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(size)), np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        pair = a << 31 | b
        slot = (a * 0x9E3779B1 + b * 0x85EBCA6B >> 7) & (KEPT_PAIRS - 1)
        found = self._compatible[slot]
        if found >> 1 != pair:
            found = self._compatible[slot] = pair << 1 | self._stay_apart(a, b)
        return bool(found & 1)

    def _stay_apart(self, a: int, b: int) -> bool:
        """Runs the merges backwards along the border: x and y stand on its two sides until the births gone[0] and gone[1] swallow them."""
        x, y, x_gone, y_gone = a, b, _NEVER, _NEVER
        while True:
            whole = self.joined.get((x, y))
            # of equal merges the left one comes first: x would go with its left neighbour, y with x
            if whole is not None and whole < x_gone and whole <= y_gone:
                return False
            if self.parts[x] is None and self.parts[y] is None:
                return True
            if x > y:
                x_gone, x = x, self.parts[x][1]
            else:
                y_gone, y = y, self.parts[y][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        n = len(piece)
        start = [0] * n
        for end, token in self.longest.iter(piece[::-1].decode("latin-1")):
            at = n - 1 - end
            if self.length[token] > self.length[start[at]] or not start[at]:
                start[at] = token
        # a byte that is token 0 keeps the 0 it began with
        open_end = bytearray(b"\x01") * (n + 1)
        out, at, token = [], 0, start[0] if n else -1
        while at < n:
            while token >= 0 and not (open_end[at + self.length[token]] and (not out or self.compatible(out[-1], token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += self.length[token]
                token = start[at] if at < n else -1
            else:
                open_end[at] = 0
                token = out.pop()
                at -= self.length[token]
        return [self.id_of[t] for t in out]

    def _compatible_lanes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a << 31 | b
        slot = (a * 0x9E3779B1 + b * 0x85EBCA6B >> 7) & (KEPT_PAIRS - 1)
        found = self._known_pairs[slot]
        new = np.flatnonzero(found >> 1 != pair)
        if len(new):
            first, again = np.unique(pair[new], return_inverse=True)
            found[new] = (first << 1 | self._stay_apart_lanes(first >> 31, first & ((1 << 31) - 1)))[again]
            self._known_pairs[slot[new]] = found[new]
        return (found & 1).astype(bool)

    def _stay_apart_lanes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """_stay_apart for many pairs."""
        out, lane = np.ones(len(x), bool), np.arange(len(x))
        x_gone = y_gone = np.full(len(x), _NEVER)
        while len(lane):
            whole = self._merges.get(x << 20 | y)
            joined = (whole >= 0) & (whole < x_gone) & (whole <= y_gone)
            out[lane[joined]] = False
            left = ~joined & ((self._left[x] >= 0) | (self._left[y] >= 0))
            lane, x, y, x_gone, y_gone = (v[left] for v in (lane, x, y, x_gone, y_gone))
            by_x = x > y
            x_gone, y_gone = np.where(by_x, x, x_gone), np.where(by_x, y_gone, y)
            x, y = np.where(by_x, self._right[x], x), np.where(by_x, y, self._left[y])
        return out

    def _starts_lanes(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The longest token that starts at every byte, inside its piece."""
        start, at = np.zeros(len(data), np.int64), np.arange(len(data))
        node, ends = np.zeros(len(data), np.int64), np.repeat(ends, np.diff(ends, prepend=0))
        depth = 0
        while len(at):
            node = self._edges.get(node << 8 | data[at + depth])
            known = node >= 0
            at, node = at[known], node[known]
            token = self._token_at[node]
            full = token >= 0
            start[at[full]] = token[full]
            depth += 1
            inside = at + depth < ends[at]
            at, node = at[inside], node[inside]
        return start

    def encode_lanes(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pieces, each as little-endian unsigned 32-bit integers."""
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        all_ends = np.cumsum(sizes)
        start = self._starts_lanes(data, all_ends)
        open_end = np.ones(len(data) + 1, bool)
        taken, before = np.full(len(data), -1, np.int64), np.full(len(data), -1, np.int64)
        some = np.flatnonzero(sizes)
        at, end = (all_ends - sizes)[some], all_ends[some]
        token, last = start[at], np.full(len(at), -1, np.int64)
        while len(at):
            ahead = at + self._lengths[token]
            fits = open_end[ahead]
            ask = np.flatnonzero(fits & (last >= 0))
            fits[ask] = self._compatible_lanes(last[ask], token[ask])
            yes, no = np.flatnonzero(fits), np.flatnonzero(~fits)
            taken[at[yes]], before[at[yes]] = token[yes], last[yes]
            last[yes], at[yes] = token[yes], ahead[yes]
            token[no] = self._shorter[token[no]]
            back = no[token[no] < 0]
            open_end[at[back]] = False
            token[back] = last[back]
            at[back] -= self._lengths[last[back]]
            taken[at[back]], last[back] = -1, before[at[back]]
            going = at < end
            token[yes] = start[np.minimum(at[yes], len(data) - 1)]
            if not going.all():
                at, end, token, last = at[going], end[going], token[going], last[going]
        hit = taken >= 0
        ids = self._id_of[taken[hit]].tobytes()
        bounds = (4 * np.append(0, np.cumsum(hit))[np.append(0, all_ends)]).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def pieces(self, text: str) -> Iterator[list[str] | bytes]:
        """The text's pieces in blocks, and the ids of special tokens between them."""
        at = 0
        for m in self._special.finditer(text) if self._special else ():
            yield from self._plain(text[at : m.start()])
            yield self.special[m[0]].to_bytes(4, "little")
            at = m.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> Iterator[list[str]]:
        at = 0
        narrow = text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text)
        find = (_NARROW if narrow else PIECES).findall
        while at < len(text):
            cut = _SAFE_CUT.search(text, at + BLOCK_CHARS) if len(text) - at > BLOCK_CHARS else None
            end = cut.start() if cut else len(text)
            yield find(text, at, end) if cut is None else find(text[at:end])
            at = end

    def encode_blocks(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, block by block."""
        for block in self.pieces(text):
            yield from self.cache.ids([block])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.encode_blocks(text)), "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        ids = ids[ids < len(self.lengths)]
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends) or not ends[-1]:
            return b""
        return self.blob[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


_CHARACTERS = byte_characters()


class _Pieces:
    """Ids of pieces seen lately, in two halves: when the new one is full it takes the place of the old one."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.newer, self.older = bpe, {}, {}

    def ids(self, blocks: list[list[str] | bytes]) -> Iterator[bytes]:
        """Each block's ids; the pieces of all blocks that are not known are encoded together."""
        newer = self.newer
        new = set().union(*(b for b in blocks if isinstance(b, list))).difference(newer)
        again = new.intersection(self.older)
        newer.update(zip(again, map(self.older.__getitem__, again), strict=True))
        self._encode(list(new - again))
        for b in blocks:
            yield b"".join(map(newer.__getitem__, b)) if isinstance(b, list) else b
        if max(map(len, new), default=0) > 64:
            for piece in [p for p in new if len(p) > 64]:
                del newer[piece]
        if len(newer) >= KEPT_PIECES // 2:
            self.newer, self.older = {}, newer

    def _encode(self, new: list[str]) -> None:
        data = [p.encode("utf-8") for p in new]
        if max(map(len, data), default=0) > LANE_BYTES:
            for piece, d in zip(new, data, strict=True):
                if len(d) > LANE_BYTES:
                    self.newer[piece] = np.array(self.bpe.encode_piece(d), "<u4").tobytes()
            new = [p for p, d in zip(new, data, strict=True) if len(d) <= LANE_BYTES]
            data = [d for d in data if len(d) <= LANE_BYTES]
        self.newer.update(zip(new, self.bpe.encode_lanes(data), strict=True))


def spec_of(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


@lru_cache(2)
def loaded(path: str) -> Bpe:
    return Bpe(spec_of(path))


_by_digest: dict[str, Bpe] = {}


def _sent(spark: SparkSession, path: str) -> Callable[[], Bpe]:
    """For tasks: the tokenizer, from a file that only the driver needs to see; a worker builds it once."""
    spec = spec_of(path)
    digest, text = hashlib.sha256(spec.encode()).hexdigest(), spark.sparkContext.broadcast(spec)

    def known() -> Bpe:
        if digest not in _by_digest:
            _by_digest.clear()
            _by_digest[digest] = Bpe(text.value)
        return _by_digest[digest]

    return known


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def digest(bpe: Bpe, blocks: Iterable[bytes], ids: bool = False) -> tuple[int, str, str, np.ndarray | None]:
    """(n_tokens, ids_sha256, decoded_sha256, the ids if asked for); each block of ids is decoded in turn, blocks end between characters."""
    ids_hash, text_hash, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []
    for block in blocks:
        own = np.frombuffer(block, "<u4")
        n += len(own)
        ids_hash.update(block)
        text_hash.update(bpe.decode(own).encode("utf-8"))
        if ids:
            kept.append(block)
    return n, ids_hash.hexdigest(), text_hash.hexdigest(), np.frombuffer(b"".join(kept), "<i4") if ids else None


def digests(bpe: Bpe, all_of: Iterable[str | None], ids: bool = False) -> Iterator[tuple[int, str, str, np.ndarray | None]]:
    """digest() of every text: the pieces of short texts are looked up together, long texts block by block."""
    group: list[str] = []
    size = 0

    def of_group():
        cut = [list(bpe.pieces(t)) for t in group]
        found = bpe.cache.ids([b for blocks in cut for b in blocks])
        for blocks in cut:
            yield digest(bpe, islice(found, len(blocks)), ids)
        next(found, None)  # its end
        group.clear()

    for text in all_of:
        long = len(text or "") > GROUP_CHARS
        if group and (long or size > GROUP_CHARS):
            yield from of_group()
            size = 0
        if long:
            yield digest(bpe, bpe.encode_blocks(text), ids)
        else:
            group.append(text or "")
            size += len(group[-1])
    yield from of_group()


def encode_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256), and the ids themselves if asked for. No shuffle."""
    rows = texts(docs, key, text)
    tokenizer = _sent(docs.sparkSession, path or default_path())
    schema = f"`{key}` {dict(rows.dtypes)[key]}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))[: 3 + with_ids]

    def work(batches):
        bpe = tokenizer()
        for b in batches:
            all_of = list(digests(bpe, (t.as_py() for t in b.column(1)), with_ids))
            columns = [pa.array([x[i] for x in all_of], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [key, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids])

    return rows.mapInArrow(tidy(work), schema)


def decode_documents(encoded: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, text) of encoded documents (key, ids); null ids give the empty text."""
    tokenizer = _sent(encoded.sparkSession, path or default_path())
    rows = encoded.select(quoted(key), "ids")

    def work(batches):
        bpe = tokenizer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x.as_py() or []) for x in b.column(1)], pa.string())], [key, "text"])

    return rows.mapInArrow(tidy(work), f"`{key}` {dict(rows.dtypes)[key]}, text string")

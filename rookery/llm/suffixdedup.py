"""Repeated byte strings across documents by suffix order and previous factors, without one global suffix array.

What must meet: two equal strings of `length` bytes. Every such string holds a gram whose hash is the least of its grams (the
leftmost on ties); equal strings hold equal least grams at the same place. So each document is cut into runs: maximal ranges
of string starts with the same least gram, the run's anchor.

1. Anchors' hashes are counted (map-side first). An anchor that occurs once has no repeated string: most runs end here.
2. The runs of the other anchors are found by a join, and one piece of text is fetched for each distinct run.
3. The pieces of an anchor are compared by a suffix array of their bytes, cut at `length` bytes, many anchors to an array: previous
   and next smaller positions in suffix order give each position's longest previous factor (cut at `length`), and a factor of
   full length marks both the later copy and its source. A run that occurs more than once repeats as a whole, by its hashes, and
   stands in the array for the others; a run that is alone with its anchor needs no array.
4. An anchor with more than `array_runs` distinct runs is not brought together. Its pieces are cut into runs anew by their least
   grams of a larger size, which fewer strings share, and steps 1 to 4 work on these, until a gram is a whole string and all
   its strings are equal. Each size leaves a quarter of the room that the one before left for a gram inside a string.
5. The marked strings come back to the documents' texts, which move once for the pieces and once for this.

Hashes: polynomials over random 64-bit byte values modulo 2^64, mixed; an anchor's and a run's hash together (128 bits) tell that
two runs are equal, bytes decide everything else. Texts are known by 128 bits of XXH64; rows with equal texts have equal results.

Either all copies go, or the first stays: then runs and strings are compared by the order of their texts' least keys and places.

Defined results: null and empty texts have no bytes; texts shorter than `length` keep all; repeated rows are copies of each
other, but where the first copy stays, rows that repeat key and text are one document, and a null key comes last; an empty table
gives an empty result; other columns, whatever their names, are ignored by `repeated_bytes` and kept by `without_repeats`.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import bounded_batches, dropped, free_names, quoted, stored, text_hash, tidy

GRAM = 40
#: Bytes worked on at a time; longer texts are cut into parts whose runs may end at the border, which changes no result.
PART = 1 << 18
_POSITION_BITS = 20
ARRAY_BYTES = 1 << 19
#: Bits of a rank of which three make one key.
RANK_BITS = 21
#: Texts whose copies a task remembers at a time.
REMEMBERED = 100_000


@lru_cache(4)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes, and powers and inverse powers of an odd base."""
    rng = np.random.default_rng(20240229)
    values = rng.integers(0, 2**64, 256, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 2**64)
    power = lambda b: np.cumprod(np.append(np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)), dtype=np.uint64)
    return values, power(base), power(inverse)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_sizes(length: int) -> list[int]:
    """The gram's size at each level; the last is the whole string's."""
    room, sizes = length - min(GRAM, max(1, length // 5)), []
    while room:
        sizes.append(length - room)
        room //= 4
    return [*sizes, length]


class Runs:
    """Runs of a part's string starts with the same anchor, over one or more texts laid end to end."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, length: int, gram: int = GRAM):
        """ends: where each text of data ends; strings do not cross these."""
        values, power, inverse = _tables(PART + 65536 + length)
        n, width = len(data), length - gram + 1
        self.anchor = self.first = self.last = self.text = np.zeros(0, np.int64)
        self.gram_hash = self.run_hash = np.zeros(0, np.uint64)
        if n < length:
            return
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * power[:n], out=prefix[1:])
        hashes = (prefix[gram:] - prefix[: n - gram + 1]) * inverse[: n - gram + 1]
        low = np.uint64((1 << _POSITION_BITS) - 1)
        keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        padded = np.full(-(-len(keys) // width) * width, np.uint64(2**64 - 1))
        padded[: len(keys)] = keys
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = n - length + 1
        least = np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts]) & low
        left = np.concatenate([[0], ends[:-1]])
        of = np.repeat(np.arange(len(ends)), ends - left)[:starts]
        good = np.flatnonzero(np.arange(starts) + length <= ends[of])
        if not len(good):
            return
        at = least[good].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (good[1:] != good[:-1] + 1)]))
        self.anchor, self.first = at[new], good[new]
        self.last = good[np.concatenate([new[1:] - 1, [len(good) - 1]])]
        self.text = of[self.first]
        self.gram_hash = _mixed(hashes[self.anchor])
        over = (prefix[self.last + length] - prefix[self.first]) * inverse[self.first]
        shape = ((self.anchor - self.first) * 1024 + (self.last - self.first)).astype(np.uint64)
        self.run_hash = _mixed(over ^ _mixed(shape + np.uint64(1)))
        for name in ("anchor", "first", "last"):
            setattr(self, name, getattr(self, name) - left[self.text])


def _parts(encoded: list, length: int):
    """(texts' numbers, their data end to end, ends, offset in the text) by parts of about PART bytes."""
    numbers, pieces, size = [], [], 0
    for i, data in enumerate(encoded):
        if len(data) > PART:
            for at in range(0, len(data) - length + 1, PART):
                one = memoryview(data)[at : at + PART + length - 1]
                yield [i], np.frombuffer(one, np.uint8), np.array([len(one)]), at
            continue
        if len(data) < length:
            continue
        if size + len(data) > PART:
            yield numbers, np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([len(p) for p in pieces]), 0
            numbers, pieces, size = [], [], 0
        numbers.append(i), pieces.append(data)
        size += len(data)
    if pieces:
        yield numbers, np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([len(p) for p in pieces]), 0


def _runs(corpus: DataFrame, length: int, gram: int, whole: bool) -> DataFrame:
    """h of every run of corpus (k1, k2, data, rows), and if whole (h, seg, k1, k2, place): place packs the anchor, its run's first
    start before it and the run's size.

    Of rows with equal keys, or of a row that stands for more, a task writes the runs twice: two tell as well as more that they repeat.
    """
    bounded_batches(corpus.sparkSession)

    def work(batches):
        times: dict[tuple[int, int], int] = {}
        for b in batches:
            k1, k2, rows = (b.column(i).to_numpy() for i in (1, 2, 3))
            encoded = []
            for i, k in enumerate(zip(k1.tolist(), k2.tolist(), strict=True)):
                times[k] = times.get(k, 0) + 1
                encoded.append(b.column(0)[i].as_buffer() if times[k] <= 2 else b"")
            if len(times) > REMEMBERED:
                times.clear()
            for numbers, data, ends, offset in _parts(encoded, length):
                r = Runs(data, ends, length, gram)
                of = np.array(numbers)[r.text]
                again = np.where(rows[of] > 1, 2, 1)
                columns = [r.gram_hash.view(np.int64)]
                if whole:
                    place = ((r.anchor + offset) << 20) | ((r.anchor - r.first) << 10) | (r.last - r.first)
                    columns += [r.run_hash.view(np.int64), k1[of], k2[of], place]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c, again)) for c in columns], ["h", "seg", "k1", "k2", "place"][: len(columns)])

    rows = corpus.where(F.octet_length("data") >= length).select("data", "k1", "k2", "rows")
    return rows.mapInArrow(tidy(work), "h bigint" + ", seg bigint, k1 bigint, k2 bigint, place bigint" * whole)


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of each run."""
    first = (place >> 20) - ((place >> 10) & 1023)
    return first, first + (place & 1023)


# --- suffix order -------------------------------------------------------------------------------------------------


def cut_ranks(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the suffixes by their first `length` bytes, by prefix tripling (doubling where three ranks do not fit 64 bits); -1
    for suffixes that their text's end cuts shorter. Only suffixes that still share a rank are sorted again."""
    n = len(data)
    left = np.concatenate([[0], ends[:-1]])
    room = (np.repeat(ends, ends - left) - np.arange(n)).astype(np.int32)
    have = min(8, length)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64) >> np.uint64(64 - 8 * have)
    rank = np.full(n, -1, np.int64)
    shared = np.flatnonzero(room >= have)
    shared = _ranked(rank, shared, key[shared], None)
    three = n <= 1 << RANK_BITS
    while have < length and len(shared):
        more = min(length, have * (3 if three else 2))
        shared = shared[room[shared] >= more]
        old, far = rank[shared], rank[shared + (more - have)]
        if three:
            far |= rank[shared + min(have, more - have)] << RANK_BITS
        shared = _ranked(rank, shared, (old << (2 * RANK_BITS if three else 32)) | far, old)
        have = more
    rank[room < length] = -1
    return rank


def _ranked(rank: np.ndarray, at: np.ndarray, key: np.ndarray, old: np.ndarray | None) -> np.ndarray:
    """Sets the ranks of positions `at` by key: how many come before, from their old rank on. Returns those that share one."""
    if not len(at):
        return at
    order = np.argsort(key)
    k = key[order]
    new = np.empty(len(k), bool)
    new[0] = True
    np.not_equal(k[1:], k[:-1], out=new[1:])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(k)))
    if old is None:
        group_rank = first
    else:  # groups of one bucket follow each other from the bucket's old rank on
        bucket = old[order[first]]
        start = np.empty(len(first), bool)
        start[0] = True
        np.not_equal(bucket[1:], bucket[:-1], out=start[1:])
        group_rank = bucket + first - first[start][np.cumsum(start) - 1]
    moved = at[order]
    rank[moved] = np.repeat(group_rank, size)
    return moved[np.repeat(size > 1, size)]


def smaller_before(position: np.ndarray) -> np.ndarray:
    """For each place in suffix order, the nearest earlier place with a smaller text position (-1: none), by pointer jumping."""
    n = len(position)
    jump = np.arange(-1, n - 1)
    open_ = np.flatnonzero((jump >= 0) & (position[jump] > position)) if n else jump
    while len(open_):
        jump[open_] = jump[jump[open_]]
        open_ = open_[(jump[open_] >= 0) & (position[jump[open_]] > position[open_])]
    return jump


def previous_factors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(later, source): positions whose longest previous factor, cut at length, is full, and the earlier position of each.

    In suffix order the longest previous factor of a position starts at its previous or next smaller position; ties of the
    cut order stand by position, so common prefixes along the order are full exactly within a run of equal ranks.
    """
    rank = cut_ranks(data, ends, length)
    order = np.flatnonzero(rank >= 0)
    order = order[np.argsort(rank[order], kind="stable")]
    rank = rank[order]
    same = np.concatenate([[False], rank[1:] == rank[:-1]])[: len(rank)]
    # Only runs of two and more can give a full factor.
    kept = same | np.concatenate([same[1:], [False]])
    position, rank = order[kept], rank[kept]
    before = smaller_before(position)
    after = len(position) - 1 - smaller_before(position[::-1])[::-1]
    full_before = (before >= 0) & (rank[before] == rank)
    inside = after < len(position)
    full_after = inside & (rank[np.where(inside, after, 0)] == rank)
    later = np.concatenate([position[full_before], position[full_after]])
    source = np.concatenate([position[before[full_before]], position[after[full_after]]])
    return later, source


def _spans_by_array(segments: list[tuple[int, int, int, bytes]], length: int, first: bool = False) -> list[tuple[int, int, list[int]]]:
    """(h, seg, flat first and last starts of repeated strings) of segments (h, seg, rows, bytes), an anchor's together; a segment of
    more rows than one repeats as a whole. With first, of strings that an earlier segment or place holds."""
    # the strings of a run hold its anchor at different places, so a run alone has nothing to be compared with
    heads = [s[0] for s in segments]
    met = [i for i, h in enumerate(heads) if h in (heads[i - 1] if i else None, heads[i + 1] if i + 1 < len(heads) else None)]
    data = np.frombuffer(b"".join(segments[i][3] for i in met), np.uint8)
    sizes = np.array([len(segments[i][3]) for i in met], np.int64)
    ends, number = np.cumsum(sizes), np.arange(len(met))
    # marks lie as the bytes do, with one place between segments
    before = np.repeat(number, sizes)
    hit = np.zeros(len(data) + len(met), bool)
    if met:
        later, source = previous_factors(data, ends, length)
        hit[later + before[later]] = True
        if not first:
            hit[source + before[source]] = True
    edges = np.flatnonzero(np.diff(hit, prepend=False))
    starts = ends - sizes + number
    flat = edges - np.arange(len(edges)) % 2
    bounds = np.append(np.searchsorted(edges, starts), len(edges)).tolist()
    spans = {i: (flat[a:b] - at).tolist() for i, at, a, b in zip(met, starts.tolist(), bounds, bounds[1:], strict=False) if a < b}
    out = []
    for i, (h, seg, rows, text) in enumerate(segments):
        own = [0, len(text) - length] if rows > 1 and not first else spans.get(i)
        if own:
            out.append((h, seg, own))
    return out


# --- the distributed operator ---------------------------------------------------------------------------------------


def _by_arrays(pieces: DataFrame, length: int, first: bool) -> DataFrame:
    """(h, seg, spans) of pieces (h, seg, rows, piece, ord): an anchor's pieces meet in one suffix array, by their order."""

    def work(batches):
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and size > ARRAY_BYTES and held[-1][0] != row[0]:
                    yield _span_batch(_spans_by_array(held, length, first))
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield _span_batch(_spans_by_array(held, length, first))

    met = pieces.repartition("h").sortWithinPartitions("h", "ord").select("h", "seg", "rows", "piece")
    return met.mapInArrow(tidy(work), "h bigint, seg bigint, spans array<bigint>")


def _span_batch(rows):
    columns = [[r[i] for r in rows] for i in range(3)]
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["h", "seg", "spans"])


def _pieces(corpus: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """(h, seg, rows, ord, piece): the bytes of each chosen run (h, seg, rows, ord), from a text that has it."""
    own = chosen.groupBy(F.col("ord.k1").alias("k1"), F.col("ord.k2").alias("k2")).agg(F.collect_list(F.struct("h", "seg", "rows", "ord")).alias("runs"))
    own = stored(own, "asked")  # so that the join deals both sides itself, and can split the rows of a text that many documents are
    asked = corpus.where(F.octet_length("data") >= length).select("data", "k1", "k2").join(own, ["k1", "k2"]).select("data", "k1", "k2", "runs")

    def work(batches):
        for b in batches:
            flat, sizes = b.column(3).flatten(), np.diff(b.column(3).offsets.to_numpy())
            first, last = _unpacked(flat.field("ord").field("place").to_numpy())
            seen, pieces, wanted, at = set(), [], [], 0
            for i, (k1, k2) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                own = slice(at, at := at + int(sizes[i]))
                if new := (k1, k2) not in seen:
                    data = memoryview(b.column(0)[i].as_buffer())
                    pieces += [data[x : y + length] for x, y in zip(first[own].tolist(), last[own].tolist(), strict=True)]
                seen.add((k1, k2))
                wanted.append(new)
            flat = flat.filter(pa.array(np.repeat(wanted, sizes)))
            names = ["h", "seg", "rows", "ord"]
            yield pa.RecordBatch.from_arrays([*(flat.field(n) for n in names), pa.array(pieces, pa.binary())], [*names, "piece"])

    schema = StructType([chosen.schema[n] for n in ("h", "seg", "rows", "ord")] + [StructField("piece", BinaryType())])
    # texts with equal hashes are equal, so repeated answers are
    return asked.mapInArrow(tidy(work), schema).dropDuplicates(["h", "seg"])


def _repeats(corpus: DataFrame, leads: DataFrame | None, length: int, sizes: list[int], array_runs: int) -> DataFrame:
    """(k1, k2, spans): flat first and last starts of repeated strings in corpus (k1, k2, data, rows); more rows than one may tell
    of a key. With leads (k1, k2, lead) only of strings that an earlier text by lead, or an earlier place of the same text, holds too."""
    repeated = _runs(corpus, length, sizes[0], False).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    repeated = stored(repeated, "anchors")
    found = _runs(corpus, length, sizes[0], True).join(repeated, "h")
    runs = stored(found if leads is None else found.join(leads, ["k1", "k2"]), "runs")
    dropped(repeated)
    ord_ = F.struct(*["lead"] * (leads is not None), "k1", "k2", "place")
    chosen = stored(runs.groupBy("h", "seg").agg(F.count(F.lit(1)).alias("rows"), F.min(ord_).alias("ord")), "chosen")
    large = stored(chosen.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > array_runs).select("h"), "large")
    pieces = stored(_pieces(corpus, chosen, length), "pieces")
    first = leads is not None
    if len(sizes) > 1 and large.head(1):
        spans = stored(_by_arrays(pieces.join(large, "h", "left_anti"), length, first), "spans")
        again = stored(pieces.join(large, "h").select(F.col("h").alias("k1"), F.col("seg").alias("k2"), F.col("piece").alias("data"), "rows", F.col("ord").alias("lead")), "again")
        deeper = _repeats(again.drop("lead"), again.select("k1", "k2", "lead") if first else None, length, sizes[1:], array_runs)
        dropped(again)
        spans = spans.unionByName(deeper.select(F.col("k1").alias("h"), F.col("k2").alias("seg"), "spans"))
    else:
        spans = _by_arrays(pieces, length, first)
    start = F.shiftright("place", 20) - F.shiftright("place", 10).bitwiseAND(F.lit(1023))
    marked = F.transform("spans", lambda x: x + start)
    if first:  # what is not the first of its run is a later copy as a whole
        spans = chosen.select("h", "seg", F.col("ord").alias("first")).join(spans, ["h", "seg"], "left")
        marked = F.when(ord_ > F.col("first"), F.array(start, start + F.col("place").bitwiseAND(F.lit(1023)))).otherwise(marked)
    back = runs.join(stored(spans, "spans"), ["h", "seg"]).select("k1", "k2", marked.alias("spans")).where("spans is not null")
    out = stored(back.groupBy("k1", "k2").agg(F.flatten(F.collect_set("spans")).alias("spans")), "marks")
    for x in (runs, chosen, large, pieces):
        dropped(x)
    return out


def _covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal ranges of bytes from ranges that may meet."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_spans(docs: DataFrame, text: str, length: int, array_runs: int, first_by: str | None) -> tuple[DataFrame, str]:
    """docs with the starts of repeated strings, flat first and last, null where there are none, and that column's name."""
    t1, t2 = text_hash(quoted(text))
    k1, k2, spans, first = free_names(docs, "k1", "k2", "spans", "first")
    long = F.octet_length(quoted(text)) >= length
    corpus = docs.select(quoted(text).cast("binary").alias("data"), t1.alias("k1"), t2.alias("k2"), F.lit(1).alias("rows"))
    leads = None
    if first_by is not None:
        key = quoted(first_by)
        order = docs.where(long).select(key.alias("key"), t1.alias("k1"), t2.alias("k2")).groupBy("k1", "k2").agg(F.min("key").alias("key"))
        order = stored(order, "order")
        leads = order.select("k1", "k2", F.struct(F.col("key").isNull().alias("unknown"), "key").alias("lead"))
    found = _repeats(corpus, leads, length, gram_sizes(length), array_runs).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans").alias(spans))
    # Short texts have no marks; keys of their whole rows keep the commonest of them from meeting in one task.
    alone = F.xxhash64(*(quoted(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
    keyed = docs.withColumns({k1: F.when(long, t1).otherwise(alone), k2: F.when(long, t2)})
    if leads is None:
        return keyed.join(found, [k1, k2], "left").drop(k1, k2), spans
    # Rows of a text that have not its least key are copies as a whole.
    found = order.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("key").alias(first)).join(found, [k1, k2], "left")
    copy = long & ~F.col(first).eqNullSafe(key)
    all_of = F.array(F.lit(0).cast("bigint"), (F.octet_length(quoted(text)) - length).cast("bigint"))
    out = keyed.join(stored(found, "found"), [k1, k2], "left").withColumn(spans, F.when(copy, all_of).otherwise(F.col(spans)))
    return out.drop(k1, k2, first), spans


def _removed(data: bytes, starts, length: int) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed ranges, and the bytes that stay."""
    flat = starts or []
    gone = _covered([(a, b + length) for a, b in zip(flat[::2], flat[1::2], strict=True)])
    kept, at = [], 0
    for a, b in gone:
        kept.append(data[at:a])
        at = b
    return gone, b"".join(kept) + data[at:]


def repeated_bytes(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text", array_runs: int = 3000, with_spans: bool = False, keep_first: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) and, if asked for, the removed ranges as flat starts and ends.

    With keep_first the first copy of each string stays: that of the text with the least key, then of the earliest place.
    """
    docs = docs.select(quoted(key), quoted(text))
    rows, spans = _with_spans(docs, text, length, array_runs, key if keep_first else None)
    schema = f"`{key}` {dict(rows.dtypes)[key]}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", removed array<bigint>" * with_spans

    def work(batches):
        for b in batches:
            out = []
            for t, starts in zip(b.column(1), b.column(2), strict=True):
                data = (t.as_py() or "").encode("utf-8")
                gone, kept = _removed(data, starts.as_py(), length)
                out.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [x for g in gone for x in g]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))[: 4 + with_spans]
            columns = [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"][: 5 + with_spans])

    return rows.select(quoted(key), quoted(text), spans).mapInArrow(tidy(work), schema)


def without_repeats(docs: DataFrame, length: int = 200, text: str = "text", chars: str | None = "n_chars", array_runs: int = 3000, keep_first_by: str | None = None) -> DataFrame:
    """The documents with all their columns, repeated strings removed from the text (bytes of a character cut apart go too),
    its number of characters set anew; a document of which nothing but white space stays, though it had more, is dropped.
    With keep_first_by, a key column, the first copy of each string stays, by that key."""
    names = docs.columns
    rows, spans = _with_spans(docs, text, length, array_runs, keep_first_by)
    rows = rows.select(*map(quoted, names), spans)
    at, count = names.index(text), names.index(chars) if chars in names else None

    def work(batches):
        for b in batches:
            columns, new, keep = list(b.columns[:-1]), [], []
            for t, starts in zip(b.column(at), b.columns[-1], strict=True):
                known, flat = t.as_py(), starts.as_py()
                if flat:
                    known = _removed(known.encode("utf-8"), flat, length)[1].decode("utf-8", "ignore")
                new.append(known)
                keep.append(not flat or bool(known.strip()))
            columns[at] = pa.array(new, pa.string())
            if count is not None:
                old = columns[count].to_pylist()
                flat = [s.as_py() for s in b.columns[-1]]
                columns[count] = pa.array([len(t) if f else o for t, f, o in zip(new, flat, old, strict=True)], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(tidy(work), docs.schema)

"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius; two fingerprints within the
radius share a variant. The shuffle is on variants. All fingerprints under one variant lie within the
radius of each other (triangle inequality), so a star to their least one keeps every link of the
bucket without all its pairs, and a bucket has 65 distinct fingerprints at most for radius 2 however many documents
carry them. Links are deduplicated and verified by their differing bits.

`near_copies` is for a stage that must find near copies by the similarity of their shingles: two bits of radius lose most pairs of
Jaccard similarity 0.8, so blocks of minimal hashes give candidates beside the balls, and each candidate is checked by the exact
Jaccard similarity of the two sets of shingles. Under a block each set first meets the least one. Then all sets of a block that are not
yet connected meet, tile by tile, so that two sets of the similarity are connected whenever they share a block.

Defined results: null and empty texts and texts without words have fingerprint zero, linked like any
other; fewer words than a shingle form one shingle; repeated rows each get a row; a null doc_id takes
no part in the minimum (a component of null ids only has a null component_id); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, dropped, free_names, quoted, stored, text_hash, tidy, word_blocks
from .components import connected_components


def shingle_hashes(text: str | None, shingle_words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles, in blocks."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
    for words in word_blocks(data, shingle_words - 1):
        if len(words) < shingle_words:
            shingles = [b" ".join(words)] if words else []
        else:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
        yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)


def majority(hashes: Iterable[np.ndarray]) -> int:
    n, ones = 0, np.zeros(64, np.int64)
    for h in hashes:
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little") if n else 0


def fingerprint(text: str | None, shingle_words: int, seed: int = 42) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingles' XXH64."""
    return majority(shingle_hashes(text, shingle_words, seed))


def fingerprints(docs: DataFrame, shingle_words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, t1, t2, fp): a row for each document, its text's hash, and fp as a signed 64-bit integer."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key), F.col(text), *text_hash(F.col(text)))
    kind = dict(rows.dtypes)[key]

    def work(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(fp.view(np.int64))], ["key", "t1", "t2", "fp"])

    return rows.mapInArrow(tidy(work), f"key {kind}, t1 bigint, t2 bigint, fp bigint")


def near_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of `distinct` (fp), enough to connect all within the radius."""
    if radius not in (0, 2, 4):
        raise ValueError("the radius is 0, 2 or 4: all under a variant must lie within it")
    fp, ball = "fp", "array(fp)"
    if radius >= 2:
        ball = "concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))"
    if radius == 4:
        two = "flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> fp ^ shiftleft(1L, i) ^ shiftleft(1L, j))))"
        ball = f"concat({ball}, {two})"
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but each row becomes many
    variants = distinct.repartition(parts, fp).select(fp, F.explode(F.expr(ball)).alias("variant"))
    least = F.min("fp").over(Window.partitionBy("variant"))
    return (
        variants.select(F.col("fp").alias("a"), least.alias("b"))
        .where("b < a")
        .distinct()
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    )


def _labelled(docs: DataFrame, shingle_words: int, radius: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, t1, t2, fp) of each document, and (fp, root, component_id) of each fingerprint."""
    fps = stored(fingerprints(docs, shingle_words, key, text), "simhash")
    distinct = stored(fps.groupBy("fp").agg(F.min("key").alias("first_key")), "distinct")
    roots = connected_components(near_links(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_key")
    rooted = stored(rooted, "rooted")
    shared = rooted.where("fp <> root").select("root").distinct()
    least = rooted.join(shared, "root").groupBy("root").agg(F.min("first_key").alias("least"))
    labels = rooted.join(least, "root", "left").select("fp", "root", F.coalesce("least", "first_key").alias("component_id"))
    return fps, stored(labels, "labels")


def simhash_groups(docs: DataFrame, shingle_words: int = 5, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for each document; component_id is the least key that links reach."""
    fps, labels = _labelled(docs, shingle_words, radius, key, text)
    return fps.join(labels, "fp").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each_group(docs: DataFrame, shingle_words: int = 5, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the least key of every group, with all its columns: a null key comes last, equal keys go by their texts'
    hashes, and of rows that repeat key and text one stays. Texts move once."""
    return _first_of_groups(docs, *_labelled(docs, shingle_words, radius, key, text), key, text)


def _first_of_groups(docs: DataFrame, fps: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    order = F.struct(F.col("key").isNull().alias("unknown"), "key", "t1", "t2")
    first = fps.join(labels, "fp").groupBy("root", "key", "t1", "t2").agg(F.count(F.lit(1)).alias("n"))
    first = first.groupBy("root").agg(F.min(F.struct(order.alias("o"), "n")).alias("x"))
    own_key, a, b, n, k1, k2 = free_names(docs, "key", "a", "b", "n", "k1", "k2")
    names_of = {"x.o.key": own_key, "x.o.t1": a, "x.o.t2": b, "x.n": n}
    first = stored(first.select(*(F.col(c).alias(name) for c, name in names_of.items())), "first")
    t1, t2 = text_hash(quoted(text))
    names = [*map(quoted, docs.columns)]
    own = docs.withColumns({k1: t1, k2: t2})
    same = (F.col(k1) == F.col(a)) & (F.col(k2) == F.col(b)) & quoted(key).eqNullSafe(F.col(own_key))
    kept = own.join(first.where(F.col(n) == 1), same, "left_semi").select(*names)
    repeated = first.where(F.col(n) > 1)
    if repeated.head(1):
        again = own.join(repeated, same, "left_semi").dropDuplicates([key, k1, k2])
        kept = kept.unionByName(again.select(*names))
    return kept


BANDS, BAND_ROWS = 20, 5
#: Sets of a block's tile, and their shingles, on average: what one task holds of a block, twice.
TILE_SETS, TILE_SHINGLES = 2000, 1 << 19
_RNG = np.random.default_rng(20240807)
_FACTORS = _RNG.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(0, 2**64, BANDS * BAND_ROWS, dtype=np.uint64)


def shingle_set(text: str | None, shingle_words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The hashes of all shingles, in blocks, and the distinct ones in order."""
    hashes = list(shingle_hashes(text, shingle_words))
    return hashes, np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)


def bands(own: np.ndarray) -> np.ndarray:
    """A hash of each block of minimal hashes; sets of Jaccard similarity j share a block with probability j ** BAND_ROWS."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1 << 13):
        part = own[at : at + (1 << 13)]
        for k in range(len(least)):
            x = part * _FACTORS[k] + _TERMS[k]
            least[k] = min(least[k], (x ^ (x >> np.uint64(29))).min())
    return np.array([xxhash.xxh64_intdigest(least[i : i + BAND_ROWS].tobytes(), i) for i in range(0, len(least), BAND_ROWS)], np.uint64).view(np.int64)


def _sketches(docs: DataFrame, shingle_words: int, key: str, text: str) -> DataFrame:
    """(key, t1, t2, fp, simhash, bands) of each document; fp is a hash of its set of shingles."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), *text_hash(F.col(f"`{text}`")))

    def work(batches):
        for b in batches:
            found = []
            for t in b.column(1):
                hashes, own = shingle_set(t.as_py(), shingle_words)
                found.append((xxhash.xxh64_intdigest(own.tobytes()), majority(hashes), bands(own).tolist()))
            fp, sim = (pa.array(np.array([f[i] for f in found], np.uint64).view(np.int64)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), fp, sim, pa.array([f[2] for f in found], pa.list_(pa.int64()))], ["key", "t1", "t2", "fp", "simhash", "bands"])

    return rows.mapInArrow(tidy(work), f"key {dict(rows.dtypes)['key']}, t1 bigint, t2 bigint, fp bigint, simhash bigint, bands array<bigint>")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, fps: DataFrame, shingle_words: int, text: str) -> DataFrame:
    """(fp, own): the wanted sets of shingles, made anew from one text each."""
    one = fps.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("t1", "t2")).alias("x"))
    one = stored(one.select("fp", F.col("x.t1").alias("t1"), F.col("x.t2").alias("t2")), "one")
    t1, t2 = text_hash(quoted(text))
    rows = docs.select(quoted(text).alias("text"), t1.alias("t1"), t2.alias("t2")).join(one, ["t1", "t2"]).select("fp", "text")

    def work(batches):
        for b in batches:
            known, sets = set(), []
            for fp, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if fp not in known:
                    sets.append((fp, shingle_set(t.as_py(), shingle_words)[1].view(np.int64)))
                known.add(fp)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in sets], pa.int64()), pa.array([x[1] for x in sets], pa.list_(pa.int64()))], ["fp", "own"])

    sets = stored(rows.mapInArrow(tidy(work), "fp bigint, own array<bigint>").dropDuplicates(["fp"]), "sets")
    dropped(one)
    return sets


def _similar(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) whose sets of shingles have the Jaccard similarity."""
    both = links.join(sets.select(F.col("fp").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("own").alias("y")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("m"))
    return both.where(F.col("n") >= similarity * (F.col("m") - F.col("n")) - 1e-9).select("a", "b")


def _pairs(links: DataFrame, other: str) -> DataFrame:
    return links.where(f"{other} <> fp").select(F.greatest("fp", other).alias("a"), F.least("fp", other).alias("b")).distinct()


def near_copies(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As one_of_each_group, but groups are linked by the Jaccard similarity of their shingles."""
    fps = stored(_sketches(docs, shingle_words, key, text), "sketches")
    sets = stored(fps.groupBy("fp").agg(F.first("simhash").alias("simhash"), F.first("bands").alias("bands")), "distinct")
    rows = sets.select("fp", F.explode("bands").alias("band"))
    blocks = stored(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("least")).where("n > 1"), "blocks")
    met = stored(rows.join(blocks, "band"), "met")
    one = sets.groupBy("simhash").agg(F.min("fp").alias("least"))
    links = met.select("fp", "least").unionByName(sets.join(one, "simhash").select("fp", "least"))
    balls = near_links(one.select(F.col("simhash").alias("fp")), radius)
    of = lambda c, n: one.select(F.col("simhash").alias(c), F.col("least").alias(n))
    links = links.unionByName(balls.join(of("a", "fp"), "a").join(of("b", "least"), "b").select("fp", "least"))
    links = stored(_pairs(links, "least"), "candidates")
    wanted = met.select("fp").unionByName(links.select(F.col("a").alias("fp"))).unionByName(links.select(F.col("b").alias("fp"))).distinct()
    shingles = _shingle_sets(docs, wanted, fps, shingle_words, text)
    sure = stored(_similar(links, shingles, similarity), "links")
    roots = connected_components(sure)
    again = _meeting_again(met.select("band", "fp"), roots, sets, shingles, similarity)
    roots = connected_components(stored(sure.unionByName(again), "links"))
    labels = sets.select("fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return _first_of_groups(docs, fps.select("key", "t1", "t2", "fp"), stored(labels, "labels"), key, text)


def _meeting_again(met: DataFrame, roots: DataFrame, sketches: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of the Jaccard similarity between sets that share a block and are not connected yet, enough to connect all such sets.

    A block with several connected groups is dealt into tiles of bounded size, and every two tiles meet in one task, which holds no
    more than these two, so all pairs of a block are looked at however large it is. A pair that shares several blocks is compared in the
    first of them alone, and a pair that the task's links have connected is not compared."""
    rooted = met.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("band", "fp", F.coalesce("root", "fp").alias("root"))
    split = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    rooted = stored(rooted.join(split, "band"), "unconnected")
    own = stored(rooted.join(sets, "fp").join(sketches.select("fp", "bands"), "fp"), "meeting")
    size = own.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("own")).alias("shingles"))
    tiles = F.greatest(F.ceil(F.col("n") / TILE_SETS), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")
    dealt = own.join(size.select("band", tiles.alias("tiles")), "band").withColumn("tile", F.pmod(F.xxhash64("fp", "band"), "tiles").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("band", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "fp", "root", "bands", "own")

    def work(key, rows):
        return _linked(*(k.as_py() for k in key), rows, similarity)

    found = dealt.groupBy("band", "low", "high").applyInArrow(work, "a bigint, b bigint")
    return stored(found.distinct(), "again")


def _linked(band: int, low: int, high: int, rows: pa.Table, similarity: float) -> pa.Table:
    """The links of two tiles of a block (of one, if they are the same)."""
    fps, roots, tile = (rows.column(c).to_numpy() for c in ("fp", "root", "tile"))
    own = [x.values.to_numpy().view(np.uint64) for x in rows.column("own")]
    sizes = np.array([len(x) for x in own])
    bands_of = np.array(rows.column("bands").to_pylist(), np.int64)
    group = np.unique(roots, return_inverse=True)[1]
    first = np.argmax(bands_of == band, axis=1)
    found = []
    for i in np.flatnonzero(tile == low):
        others = (tile == high) & (group != group[i]) if low < high else (np.arange(len(fps)) < i) & (group != group[i])
        others &= np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9
        js = np.flatnonzero(others)
        js = js[~(bands_of[js, : first[i]] == bands_of[i, : first[i]]).any(axis=1)]
        if not len(js) or not sizes[i]:
            continue
        values = np.concatenate([own[j] for j in js])
        hits = own[i][np.minimum(np.searchsorted(own[i], values), sizes[i] - 1)] == values
        ends = np.cumsum(sizes[js])
        sums = np.concatenate([[0], np.cumsum(hits)])
        n = sums[ends] - sums[ends - sizes[js]]
        for j in js[n >= similarity * (sizes[i] + sizes[js] - n) - 1e-9]:
            if group[j] != group[i]:
                found.append((max(fps[i], fps[j]), min(fps[i], fps[j])))
                group[group == group[j]] = group[i]
    return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

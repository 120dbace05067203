"""Benchmark decontamination by a prefix-filtered set join.

Items become windows of consecutive words (an item of fewer words is one window). Words are ordered by rarity, counted
over all documents; as a match must hold every word of a window, its necessary prefix is its rarest word. A document
probes only the prefix words it has; a hit fixes where a window would start (positional bound) and how long it is
(length bound), and the words there are compared with the window exactly.

The documents are never shuffled: the index goes to them. Its size is checked; a benchmark beyond `block_bytes` of text
is split by a hash of its items into blocks of about that size which pass over the documents one after another, each
adding to the hits so far, so any size gives the same whole result.

Defined results: null and empty texts have no words; items without words have no windows; repeated items and windows
count once per distinct item id; an item with a null id marks words but is not listed; a document row is judged by
itself, so repeated rows repeat; an empty benchmark hits nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import bounded_batches, free_names, quoted, stored, tidy, word_blocks

#: A-Z to a-z; ASCII characters that are neither letter nor digit to a space; all other bytes stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8").translate(_FOLD)


class Index:
    """Windows of a block of items, under the rarest word of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, rarity: Counter):
        self.window = window
        self.items_of: dict[bytes, set[str | None]] = {}
        self.starts: dict[bytes, set[tuple[int, int]]] = {}
        for item, text in items:
            for words in windows(text, window):
                known = self.items_of.setdefault(b" ".join(words), set())
                if not known:
                    at = min(range(len(words)), key=lambda i: (rarity[words[i]], words[i], i))
                    self.starts.setdefault(words[at], set()).add((at, len(words)))
                known.add(item)

    def probe(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of words that windows cover, and the items of those windows."""
        prefix = set(self.starts).intersection(words) if len(words) > len(self.starts) else {w for w in words if w in self.starts}
        spans, items = [], set()
        if prefix:
            for at, word in enumerate(words):
                if word in prefix:
                    for offset, length in self.starts[word]:
                        first = at - offset
                        if first >= 0 and first + length <= len(words):
                            found = self.items_of.get(b" ".join(words[first : first + length]))
                            if found:
                                spans.append((first, first + length))
                                items |= found
        return spans, items

    def judge(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """(words, disjoint spans of hit words, items)"""
        carry, n, spans, items, first = self.window - 1, 0, [], set(), True
        for words in word_blocks(folded(text), carry):
            before = 0 if first else n - min(carry, n)
            found, more = self.probe(words)
            spans += [(a + before, b + before) for a, b in found]
            items |= more
            n, first = before + len(words), False
        return n, united(spans), items


def windows(text: str | None, window: int) -> list[list[bytes]]:
    words = folded(text).split()
    if not words:
        return []
    return [words[i : i + window] for i in range(max(1, len(words) - window + 1))]


def united(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(items: DataFrame, block_bytes: int, item: str, text: str) -> list[DataFrame]:
    rows = items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [rows.where(part == i) if n > 1 else rows for i in range(n)]


def word_rarity(docs: DataFrame, words: set[bytes], text: str) -> Counter:
    """In how many documents each of the given words occurs, counted over all documents."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(frozenset(words))

    def work(batches):
        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen: set[bytes] = set()
                for block in word_blocks(folded(t.as_py()), 0):
                    seen |= wanted.value.intersection(block)
                counts.update(seen)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    bounded_batches(spark)
    counted = docs.select(text).mapInArrow(tidy(work), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return Counter({bytes(r["word"]): r["n"] for r in counted.collect()})


def marked(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text",
           block_bytes: int = 16 << 20) -> DataFrame:
    """docs with three columns more, of names that docs does not have: the number of words, flat starts and ends of hit words, and items.
    No shuffle of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = item_blocks(items, block_bytes, item, item_text)
    more = free_names(docs, "words", "spans", "items")
    kinds = (LongType(), ArrayType(LongType()), ArrayType(StringType()))
    schema = StructType([*docs.schema.fields, *(StructField(n, k) for n, k in zip(more, kinds, strict=True))])
    out, at, docs_columns = docs, docs.columns.index(text), docs.columns
    for k, block in enumerate(blocks):
        listed = [(r["item"], r["text"]) for r in block.toLocalIterator()]
        vocabulary = {w for _, t in listed for w in folded(t).split()}
        index = spark.sparkContext.broadcast(Index(listed, window, word_rarity(docs, vocabulary, text) if vocabulary else Counter()))

        def work(batches, index=index, later=k > 0):
            for b in batches:
                own, before = b.columns[: len(docs_columns)], b.columns[len(docs_columns) + 1 :]
                counts, spans, found = [], [], []
                for i, t in enumerate(b.column(at)):
                    n, hit, items = index.value.judge(t.as_py())
                    if later:
                        old = before[0][i].as_py()
                        hit = united([*hit, *zip(old[::2], old[1::2], strict=True)])
                        items |= set(before[1][i].as_py())
                    counts.append(n)
                    spans.append([x for s in hit for x in s])
                    found.append(sorted(items, key=lambda x: (x is not None, x or "")))
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))],
                    schema.names,
                )

        out = out.mapInArrow(tidy(work), schema)
        if k + 1 < len(blocks):
            out = stored(out, "decontam")
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated, items) for each document."""
    found = marked(docs.select(quoted(key), quoted(text)), items, window, text, **more)
    words, spans, hits = found.columns[-3:]
    ids = F.array_compact(hits)
    pairs = F.sequence(F.lit(0), (F.size(spans) / 2).cast("int") - 1)
    n_hit = F.when(F.size(spans) == 0, F.lit(0)).otherwise(
        F.aggregate(pairs, F.lit(0).cast("bigint"), lambda s, i: s + F.get(spans, 2 * i + 1) - F.get(spans, 2 * i))
    )
    n_hit = n_hit.cast("bigint")
    return found.select(
        quoted(key),
        F.col(words).alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        ids.alias("items"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", **more) -> DataFrame:
    """The documents that no window of an item occurs in, as they are."""
    found = marked(docs, items, window, text, **more)
    return found.where(F.size(found.columns[-2]) == 0).select(*map(quoted, docs.columns))


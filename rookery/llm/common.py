"""What the operators of this subpackage share: tables, the shared store and text splitting."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import re
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.workdir import bounded_batches, shared_base

#: Bytes of text that are split into words at a time, so that one very long text needs little memory.
BLOCK_BYTES = 1 << 20
#: Shuffle files go when the query that made them has ended.
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_scope: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("scope", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str, owned: bool = True) -> DataFrame:
    """Writes df to the shared store and reads it back: cuts the lineage and survives lost executors; its shuffle files go.
    The table goes with the scratch() around, if it is owned by it."""
    spark = df.sparkSession
    path = f"{shared_base(spark)}/rookery/{uuid.uuid4().hex}-{label}"
    before = spark.conf.get(_CLEANUP_KEY, None)
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP_KEY) if before is None else spark.conf.set(_CLEANUP_KEY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if owned and (scope := _scope.get()) is not None:
        scope.append(out)
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, getattr(df, "stored_at", None)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end the tables that operators stored inside it. An operator's result reads some of them: write it inside."""
    token = _scope.set([])
    try:
        yield
    finally:
        for df in _scope.get():
            dropped(df)
        _scope.reset(token)


def give_back() -> None:
    """Returns to the system what this process freed: memory that the allocators keep counts as the executor's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(work: Callable[[Iterable], Iterator], every: float = 1.0) -> Callable[[Iterable], Iterator]:
    """work for mapInArrow, in a worker that gives back memory each so many seconds and at the task's ends. Workers outlive their tasks, so
    else what the largest batch of each operator took adds up in all of them."""

    def run(batches):
        gc.collect()  # the task before may have left cycles
        give_back()
        due = time.monotonic() + every
        for out in work(batches):
            yield out
            if time.monotonic() >= due:
                del out
                give_back()
                due = time.monotonic() + every
        gc.collect()
        give_back()

    return run


def quoted(name: str) -> Column:
    """The column of exactly this name."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """These names, with a number where df has a column of the name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        own, n = f"rookery_{name}", 0
        while own.lower() in taken:
            own, n = f"rookery_{name}_{n}", n + 1
        taken.add(own.lower())
        out.append(own)
    return out


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, whatever other columns there are."""
    bounded_batches(df.sparkSession)
    return df.select(quoted(key), quoted(text))


def text_hash(text: Column) -> list[Column]:
    """A text's 128-bit hash as t1 and t2; null counts as the empty text."""
    known = F.coalesce(text, F.lit(""))
    return [F.xxhash64(known).alias("t1"), F.xxhash64(F.lit(17), known).alias("t2")]


def word_blocks(data: bytes, carry: int) -> Iterator[list[bytes]]:
    """Words between white space, in blocks of about BLOCK_BYTES; each block starts with the last `carry` words before it and has
    more than those, unless the whole text has no more."""
    if len(data) <= BLOCK_BYTES:
        yield data.split()
        return
    at, last, new = 0, [], 0
    while at < len(data):
        cut = _SPACE.search(data, at + BLOCK_BYTES)
        end = cut.end() if cut else len(data)
        more = data[at:end].split()
        words, new, at = last + more, new + len(more), end
        if new and (len(words) > carry or at >= len(data)):
            yield words
            new, words = 0, words[-carry:] if carry else []
        last = words


def crc_mod(column, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % n


def sampled(df: DataFrame, rows: int, by: str, have: int | None = None) -> DataFrame:
    """About `rows` rows at most, chosen by a hash of `by`, the same at each run; all rows if there are fewer."""
    have = df.count() if have is None else have
    if have <= rows:
        return df
    return df.where(share_of(F.col(by)) < rows / have)


def share_of(column: Column) -> Column:
    """A number between 0 and 1 by the column's hash, as fine as doubles are."""
    return F.xxhash64(F.lit(7), column) / F.lit(2.0**64) + F.lit(0.5)

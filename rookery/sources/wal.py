"""The binary operation log: `00 | u32 LE length | event JSON` for an insert, `01 | 32 bytes` for a delete."""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workdir import bounded_batches
from .parse import parsed

#: Fixed numbers of the format.
INSERT, DELETE, MAX_RECORD = 0, 1, 16 * 1024 * 1024
_SCHEMA = "segment string, pos long, op string, raw string, id string, error string"
_NAMES, _TYPES = ["segment", "pos", "op", "raw", "id", "error"], [pa.string(), pa.int64(), *[pa.string()] * 4]
#: Records that are handed on together.
RUN = 1000


def encode_insert(raw: str) -> bytes:
    data = raw.encode("utf-8")
    return struct.pack("<BI", INSERT, len(data)) + data


def encode_delete(id_: str) -> bytes:
    return bytes([DELETE]) + bytes.fromhex(id_)


def decode(data: bytes) -> Iterator[tuple[int, str | None, str | None, str | None, str | None]]:
    """(pos, op, raw, id, error) of each record. The end and unknown operations stop; a torn or oversized record stops with an error."""
    at = 0
    while at < len(data):
        op, start = data[at], at
        if op == INSERT:
            if at + 5 > len(data):
                yield start, None, None, None, "truncated record"
                return
            (size,) = struct.unpack_from("<I", data, at + 1)
            if size > MAX_RECORD:
                yield start, None, None, None, f"record of {size} bytes exceeds maximum"
                return
            if at + 5 + size > len(data):
                yield start, None, None, None, "truncated record"
                return
            yield start, "insert", data[at + 5 : at + 5 + size].decode("utf-8", "replace"), None, None
            at += 5 + size
        elif op == DELETE:
            if at + 33 > len(data):
                yield start, None, None, None, "truncated record"
                return
            yield start, "delete", None, data[at + 1 : at + 33].hex(), None
            at += 33
        else:
            return


def decoded(segments: DataFrame) -> DataFrame:
    """(segment, pos, op, raw, id, error) of segments (path, content). A segment is decoded by one task: records have no marks to split at.
    The task holds one batch of segments, of bounded bytes (one segment at least), and one run of records."""
    bounded_batches(segments.sparkSession)

    def work(batches):
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                records = decode(content.as_py())
                while run := list(itertools.islice(records, RUN)):
                    columns = zip(*((name.as_py(), *r) for r in run), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    return segments.select("path", "content").mapInArrow(work, _SCHEMA)


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """The records of the segment files under path."""
    return decoded(spark.read.format("binaryFile").load(path))


def encoded(ops: DataFrame) -> DataFrame:
    """(path, content): operations (seq, op, id, raw) as segments, one for each partition of the given order."""

    def work(batches):
        for i, batch in enumerate(batches):
            parts = [encode_insert(r) if o == "insert" else encode_delete(d) for o, d, r in zip(batch["op"], batch["id"], batch["raw"], strict=True)]
            if parts:
                yield pd.DataFrame({"path": [f"segment-{batch['seq'].iloc[0]:020d}-{i}"], "content": [b"".join(parts)]})

    bounded_batches(ops.sparkSession)
    return ops.select("seq", "op", "id", "raw").sortWithinPartitions("seq").mapInPandas(work, "path string, content binary")


def operations(records: DataFrame) -> DataFrame:
    """Operations with events' columns: (segment, pos, op, id, ...). Inserts whose text is no event are left out, as are error rows."""
    inserts = parsed(records.where("op = 'insert'").select("segment", "pos", "op", "raw")).where("reason is null").drop("reason")
    deletes = records.where("op = 'delete'").select("segment", "pos", "op", "id")
    return inserts.unionByName(deletes, allowMissingColumns=True)


def pending_bytes(records: DataFrame) -> DataFrame:
    """One row: the bytes that the records take in the log."""
    size = F.when(F.col("op") == "insert", 5 + F.octet_length("raw")).when(F.col("op") == "delete", 33).otherwise(0)
    return records.agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("pending_bytes"))

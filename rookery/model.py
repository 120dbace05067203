"""Schemas and fixed numbers of the event model."""

from pyspark.sql import types as T

TAGS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("values", T.ArrayType(T.StringType()))]))
#: The append-only log: seq is the order of arrival.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.StringType()),
        T.StructField("pubkey", T.StringType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("kind", T.LongType()),
        T.StructField("tags", TAGS),
        T.StructField("content", T.StringType()),
        T.StructField("sig", T.StringType()),
        T.StructField("raw", T.StringType()),
        T.StructField("raw_bytes", T.LongType()),
    ]
)
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()
#: One filter of one subscription of one connection.
SUBSCRIPTION_SCHEMA = (
    "conn string, sub_id string, filter_no int, ids array<string>, authors array<string>, kinds array<bigint>,"
    " tags map<string,array<string>>, since bigint, until bigint"
)
#: Kind classes, fixed values of the protocol: from, to (exclusive).
EPHEMERAL = (20000, 30000)
REPLACEABLE = (10000, 20000)
ADDRESSABLE = (30000, 40000)
MAX_KIND = 2**32 - 1

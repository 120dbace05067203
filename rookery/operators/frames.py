"""Protocol frames: rendering and parsing, in columns. All texts are escaped, so every frame is valid JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json_string

#: Texts of the acknowledgements by outcome, fixed values of the protocol.
OK_TEXTS = {"stored": "", "ephemeral": "ephemeral: will not be stored", "duplicate": "duplicate: already have this event"}
MESSAGE = "struct<type:string,id:string,event:string,filters:array<string>,accepted:boolean,message:string,error:string>"


def _frame(*parts: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def event_frame(sub_id: Column, raw: Column) -> Column:
    return _frame(F.lit('"EVENT"'), json_string(sub_id), raw)


def eose_frame(sub_id: Column) -> Column:
    return _frame(F.lit('"EOSE"'), json_string(sub_id))


def close_frame(sub_id: Column) -> Column:
    return _frame(F.lit('"CLOSE"'), json_string(sub_id))


def notice_frame(message: Column) -> Column:
    return _frame(F.lit('"NOTICE"'), json_string(message))


def ok_frame(id_: Column, accepted: Column, message: Column) -> Column:
    return _frame(F.lit('"OK"'), json_string(id_), accepted.cast("string"), json_string(message))


def request_frame(sub_id: Column, filters: Column) -> Column:
    """filters: array of JSON objects, each an element of the frame."""
    return _frame(F.lit('"REQ"'), json_string(sub_id), F.array_join(filters, ","))


def ok_frames(outcomes: DataFrame, *more: str) -> DataFrame:
    """(seq, frame) and the columns more for outcomes (seq, id, outcome): all are accepted."""
    text = F.lit("")
    for outcome, said in OK_TEXTS.items():
        text = F.when(F.col("outcome") == outcome, F.lit(said)).otherwise(text)
    return outcomes.select("seq", ok_frame(F.col("id"), F.lit(True), text).alias("frame"), *more)


def parse_message(frame) -> Column:
    """A frame as a struct of MESSAGE: type and its fields, or error, the first thing that is wrong. Events and filters stay JSON."""
    c = F.col(frame) if isinstance(frame, str) else frame
    v = F.try_parse_json(c)
    at = lambda i: F.try_variant_get(v, f"$[{i}]", "variant")
    kind_at = lambda i: F.coalesce(F.schema_of_variant(at(i)), F.lit(""))
    text = lambda i: F.when(kind_at(i) == "STRING", F.try_variant_get(v, f"$[{i}]", "string"))
    n = F.coalesce(F.size(F.try_variant_get(v, "$", "array<variant>")), F.lit(-1))
    is_array = F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    name = text(0)
    missing = {"EVENT": (2, "Missing event data"), "REQ": (3, "Missing filters"), "CLOSE": (2, "Missing subscription ID"), "EOSE": (2, "Missing EOSE id"), "NOTICE": (2, "Missing notice message"), "OK": (4, "Missing OK fields")}
    wrong = {"REQ": "Missing subscription ID", "CLOSE": "Invalid subscription ID", "EOSE": "Invalid EOSE id", "NOTICE": "Invalid notice message", "OK": "Invalid OK id"}
    error = F.when(v.isNull(), "JSON parse error").when(~is_array, "Expected JSON array").when(n == 0, "Empty array").when(name.isNull(), "Invalid message type")
    error = error.when(~name.isin(list(missing)), F.concat(F.lit("Unknown message type: "), name))
    for k, (least, said) in missing.items():
        error = error.when((name == k) & (n < least), said)
    for k, said in wrong.items():
        error = error.when((name == k) & text(1).isNull(), said)
    error = error.when((name == "OK") & (kind_at(2) != "BOOLEAN"), "Invalid OK accepted field").when((name == "OK") & text(3).isNull(), "Invalid OK message")
    parts = F.transform(F.slice(F.try_variant_get(v, "$", "array<variant>"), F.lit(3), F.greatest(n, F.lit(0))), lambda x: F.to_json(x))
    good = error.isNull()
    return F.struct(
        F.when(good, name).alias("type"),
        F.when(good & name.isin("REQ", "CLOSE", "EOSE", "OK"), text(1)).alias("id"),
        F.when(good & (name == "EVENT"), F.to_json(at(1))).alias("event"),
        F.when(good & (name == "REQ"), parts).alias("filters"),
        F.when(good & (name == "OK"), F.try_variant_get(v, "$[2]", "boolean")).alias("accepted"),
        F.when(good & (name == "OK"), text(3)).when(good & (name == "NOTICE"), text(1)).alias("message"),
        error.alias("error"),
    )

from .events import (
    approximate_size,
    d_tag,
    event_tags,
    hex_tag_values,
    is_addressable,
    is_ephemeral,
    is_hex,
    is_replaceable,
    is_single_letter,
    kind_class,
    replacement_key,
    route_key,
    shard_of,
    tag_value,
)
from .hashing import canonical_json, event_id, fold128
from .signatures import verify_signature
from .text import capacity, format_bytes, json_string, percent_of

__all__ = [
    "approximate_size", "canonical_json", "capacity", "d_tag", "event_id", "event_tags", "fold128", "format_bytes", "hex_tag_values",
    "is_addressable", "is_ephemeral", "is_hex", "is_replaceable", "is_single_letter", "json_string", "kind_class", "percent_of",
    "replacement_key", "route_key", "shard_of", "tag_value", "verify_signature",
]

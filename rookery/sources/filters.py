"""Filters: what a subscription asks for. Parsed on the driver, turned into columns."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

_HEX64 = re.compile(r"[0-9a-fA-F]{64}")


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class Filter:
    """Conditions that all must hold; None asks nothing, an empty list is never met."""

    ids: tuple[str, ...] | None = None
    authors: tuple[str, ...] | None = None
    kinds: tuple[int, ...] | None = None
    tags: dict[str, tuple[str, ...]] = field(default_factory=dict)
    since: int | None = None
    until: int | None = None
    limit: int | None = None

    @property
    def e_tags(self) -> tuple[str, ...] | None:
        return self.tags.get("e")

    @property
    def p_tags(self) -> tuple[str, ...] | None:
        return self.tags.get("p")

    def to_json(self) -> str:
        out = {k: list(v) for k in ("ids", "kinds", "authors") if (v := getattr(self, k)) is not None}
        out |= {f"#{k}": list(v) for k, v in self.tags.items()}
        out |= {k: v for k in ("since", "until", "limit") if (v := getattr(self, k)) is not None}
        return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def hex_values(values) -> tuple[str, ...]:
    """Those of the values that are 64 hex digits, lower-cased."""
    return tuple(v.lower() for v in values if _HEX64.fullmatch(v))


def _list(name: str, value, kind: type) -> list:
    if not isinstance(value, list) or any(type(v) is not kind for v in value):
        raise FilterError(f"{name} must be a list of {kind.__name__}")
    return value


def _number(name: str, value, most: int = 2**64 - 1) -> int:
    if type(value) is not int or not 0 <= value <= most:
        raise FilterError(f"{name} must be a whole number from 0 to {most}")
    return value


def parse_filter(source: str | dict) -> Filter:
    """From JSON. `#x` with one character is a tag condition; longer ones and unknown keys are ignored; a bare `#` is an error,
    as are ids and authors that are not 64 hex digits."""
    try:
        raw = json.loads(source) if isinstance(source, str) else source
    except ValueError as e:
        raise FilterError(str(e)) from None
    if not isinstance(raw, dict):
        raise FilterError("a filter is an object")
    got: dict = {"tags": {}}
    for key, value in raw.items():
        if key in ("ids", "authors"):
            if value is not None:
                known = hex_values(_list(key, value, str))
                if len(known) != len(value):
                    raise FilterError(f"{key} must be 64 hex digits each")
                got[key] = known
        elif key == "kinds":
            if value is not None:
                got[key] = tuple(_number(key, v, 2**32 - 1) for v in _list(key, value, int))
        elif key in ("since", "until", "limit"):
            if value is not None:
                got[key] = _number(key, value)
        elif key.startswith("#"):
            if len(key) == 1:
                raise FilterError("empty tag filter key")
            if len(key) == 2:
                got["tags"][key[1]] = tuple(_list(key, value, str))
    return Filter(**got)

"""Settings: defaults, then a YAML file of plain `key: value` lines, then the environment, then the session's `rookery.*` keys."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    bind_addr: str = "0.0.0.0:8080"
    target_ram_percent: int = 80
    max_bytes: int = 0
    max_subscriptions: int = 300
    max_limit: int = 5000
    persistence_path: str | None = None
    persistence_interval: int = 60
    prometheus_url: str | None = None

    def budget(self, total_memory: int) -> int:
        """Bytes that the store may take: the exact limit, else a share of the machine; 0 is no limit."""
        return self.max_bytes or total_memory * self.target_ram_percent // 100


def load(path: str | None = None, environment: dict[str, str] | None = None, spark=None) -> Config:
    found: dict[str, str] = {}
    if path:
        with open(path, encoding="utf-8") as f:
            for line in f:
                key, colon, value = line.split("#", 1)[0].partition(":")
                if colon and value.strip():
                    found[key.strip()] = value.strip().strip("\"'")
    given = os.environ if environment is None else environment
    found |= {f.name: given[f.name.upper()] for f in fields(Config) if f.name.upper() in given}
    if spark is not None:
        found |= {f.name: v for f in fields(Config) if (v := spark.conf.get(f"rookery.{f.name}", None)) is not None}
    numbers = {f.name for f in fields(Config) if f.type == "int"}
    return replace(Config(), **{k: int(v) if k in numbers else v for k, v in found.items() if k in {f.name for f in fields(Config)}})

"""Thresholds, durations and properties."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

import yaml

#: Milliseconds of each duration unit.
UNITS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000}


def duration_ms(text: str) -> int:
    """``500ms``, ``30s``, ``2m`` or ``1h`` in milliseconds."""
    m = re.fullmatch(r"(\d+)(ms|s|m|h)", str(text))
    if not m:
        raise ValueError(f"bad duration {text!r}: use 500ms, 30s, 2m or 1h")
    return int(m[1]) * UNITS[m[2]]


def expand_env(text: str, env: Mapping[str, str] | None = None) -> str:
    """Replaces ``${env:NAME}`` and ``${env:NAME:-default}``; a missing name without default is an error."""
    env = os.environ if env is None else env

    def value(m: re.Match) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[2] is None:
            raise KeyError(f"environment variable {m[1]} is not set")
        return m[2]

    return re.sub(r"\$\{env:([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}", value, text)


def load_properties(text: str, env: Mapping[str, str] | None = None) -> tuple[dict[str, str], dict[str, str]]:
    """(settings of the monitor, i.e. those that begin with ``sq.``; properties for the client)."""
    rows = (line.strip() for line in text.splitlines())
    pairs = dict(tuple(p.strip() for p in re.split(r"\s*[=:]\s*", r, maxsplit=1)) for r in rows if r and r[0] not in "#!" and re.search("[=:]", r))
    pairs = {k: expand_env(v, env) for k, v in pairs.items()}
    return {k: v for k, v in pairs.items() if k.startswith("sq.")}, {k: v for k, v in pairs.items() if not k.startswith("sq.")}


@dataclass
class Thresholds:
    """Settings by precedence: field, topic, defaults, then the default of the code."""

    raw: dict = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Thresholds:
        return cls(yaml.safe_load(text) or {})

    def _window(self, key: str, default: str) -> int:
        return duration_ms((self.raw.get("window") or {}).get(key) or default)

    @property
    def window_ms(self) -> int:
        return self._window("size", "60s")

    @property
    def disorder_ms(self) -> int:
        return self._window("max_out_of_orderness", "10s")

    @property
    def idle_ms(self) -> int:
        return self._window("idle_timeout", "30s")

    @property
    def event_time_field(self) -> str:
        return self.raw.get("event_time_field") or "ts"

    @property
    def history_windows(self) -> int:
        return int(self.raw.get("history_windows", 30))

    @property
    def rebaseline_after(self) -> int:
        return int(self.raw.get("rebaseline_after", self.history_windows))

    @property
    def topics(self) -> list[str]:
        return list(self.raw.get("topics") or {})

    def _topic(self, topic: str) -> dict:
        return (self.raw.get("topics") or {}).get(topic) or {}

    def fields(self, topic: str) -> list[str]:
        return list(self._topic(topic).get("fields") or {})

    def _field(self, topic: str, name: str) -> dict:
        return (self._topic(topic).get("fields") or {}).get(name) or {}

    def required(self, topic: str, name: str) -> bool:
        return self._field(topic, name).get("required") is True

    def cardinality(self, topic: str, name: str) -> bool:
        return self._field(topic, name).get("cardinality") is True

    def get(self, topic: str, check: str, key: str, default, name: str | None = None):
        """The first value of the right type in field (if named), topic, defaults."""
        kind = bool if isinstance(default, bool) else (int, float) if isinstance(default, (int, float)) else str
        levels = [*([self._field(topic, name)] if name else []), self._topic(topic), self.raw.get("defaults") or {}]
        for level in levels:
            part = level.get(check)
            value = part.get(key) if isinstance(part, dict) else None
            if isinstance(value, kind) and (kind is bool or not isinstance(value, bool)):
                return value
        return default

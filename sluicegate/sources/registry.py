"""Schema registries: clients, circuit breaker, and the schema table that records are joined with."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

FOUND, MISSING, AWAY = "found", "missing", "away"
#: Failures that open the breaker, how long it stays open, and how long a missing schema is remembered.
FAILURES, OPEN_S, MISSING_S = 3, 60.0, 30.0
ALIASES = {"confluent": "confluent", "karapace": "confluent", "apicurio": "apicurio", "apicurio-v3": "apicurio", "apicurio-ccompat": "confluent"}


@dataclass(frozen=True)
class Registered:
    kind: str
    text: str
    references: tuple = field(default=())


class Breaker:
    """Open for a while after failures in a row; then one trial decides."""

    def __init__(self, failures: int = FAILURES, open_s: float = OPEN_S, clock: Callable[[], float] = time.monotonic) -> None:
        self.limit, self.open_s, self.clock = failures, open_s, clock
        self.failed, self.until, self.trial = 0, 0.0, False

    def allows(self) -> bool:
        if self.failed < self.limit:
            return True
        if self.clock() >= self.until and not self.trial:
            self.trial = True
            return True
        return False

    def record(self, ok: bool) -> None:
        self.failed = 0 if ok else self.failed + 1
        self.trial = False
        if self.failed >= self.limit:
            self.until = self.clock() + self.open_s


def _fetch(url: str, timeout: float = 5.0) -> dict | str:
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310  a registry's URL from the configuration
        body = r.read().decode()
    try:
        return json.loads(body)
    except ValueError:
        return body


class ConfluentClient:
    """The ``/schemas/ids`` and ``/subjects`` interface."""

    def __init__(self, url: str, fetch: Callable[[str], dict] = _fetch) -> None:
        self.url, self.fetch = url.rstrip("/"), fetch

    @staticmethod
    def _schema(r: dict) -> Registered:
        return Registered((r.get("schemaType") or "AVRO").upper(), r["schema"], tuple((x["name"], x["subject"], x["version"]) for x in r.get("references") or []))

    def by_id(self, schema_id: int) -> Registered:
        return self._schema(self.fetch(f"{self.url}/schemas/ids/{schema_id}"))

    def latest(self, subject: str) -> Registered:
        return self._schema(self.fetch(f"{self.url}/subjects/{urllib.parse.quote(subject, safe='')}/versions/latest"))

    def version(self, subject: str, number: int) -> Registered:
        return self._schema(self.fetch(f"{self.url}/subjects/{urllib.parse.quote(subject, safe='')}/versions/{number}"))

    def ping(self) -> bool:
        self.fetch(f"{self.url}/config")
        return True


class ApicurioClient:
    """The native v3 interface: the newest version of an artifact. It knows no ids, so nothing is framed."""

    supports_ids = False

    def __init__(self, url: str, group: str = "default", fetch: Callable[[str], dict] = _fetch) -> None:
        self.url, self.group, self.fetch = url.rstrip("/"), group, fetch

    def latest(self, subject: str) -> Registered:
        r = self.fetch(f"{self.url}/groups/{self.group}/artifacts/{urllib.parse.quote(subject, safe='')}/versions/branch=latest/content")
        return Registered("JSON", r if isinstance(r, str) else json.dumps(r))

    def ping(self) -> bool:
        self.fetch(f"{self.url}/system/info")
        return True


class Schemas:
    """Cached lookups by id and subject on the driver. The last good answer stays while the registry is away."""

    def __init__(self, client, breaker: Breaker | None = None, clock: Callable[[], float] = time.monotonic) -> None:
        self.client, self.breaker, self.clock = client, breaker or Breaker(clock=clock), clock
        self.known: dict = {}
        self.missing: dict = {}

    def _ask(self, key, call: Callable[[], Registered]) -> tuple[str, Registered | None]:
        if self.missing.get(key, -1.0) > self.clock():
            return MISSING, None
        if not self.breaker.allows():
            return (FOUND, self.known[key]) if key in self.known else (AWAY, None)
        try:
            self.known[key] = call()
            self.breaker.record(True)
            return FOUND, self.known[key]
        except urllib.error.HTTPError as e:
            self.breaker.record(e.code == 404)
            if e.code == 404:
                self.missing[key] = self.clock() + MISSING_S
                return MISSING, None
        except Exception:  # noqa: BLE001  whatever keeps the registry from answering
            self.breaker.record(False)
        return (FOUND, self.known[key]) if key in self.known else (AWAY, None)

    def by_id(self, schema_id: int) -> tuple[str, Registered | None]:
        if schema_id in self.known:
            return FOUND, self.known[schema_id]
        return self._ask(schema_id, lambda: self.client.by_id(schema_id))

    def latest(self, subject: str) -> tuple[str, Registered | None]:
        return self._ask(subject, lambda: self.client.latest(subject))

    def imports(self, schema: Registered, depth: int = 0) -> dict[str, str]:
        """Texts of all referenced schemas by name."""
        out: dict[str, str] = {}
        if depth <= 8:
            for name, subject, number in schema.references:
                found = self.client.version(subject, number)
                out |= {name: found.text} | self.imports(found, depth + 1)
        return out


def schema_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(schema_id, kind, schema, imports as JSON): one small row for each id in use."""
    return spark.createDataFrame(rows, "schema_id int, kind string, schema string, imports string")

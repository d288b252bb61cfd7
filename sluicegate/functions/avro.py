"""Avro binary to JSON values by the writer's schema. Logical types stay in their plain form; bytes are base64."""

from __future__ import annotations

import base64
import json
import struct

PRIMITIVE = ("null", "boolean", "int", "long", "float", "double", "bytes", "string")


class Reader:
    """Reads one datum; ``at`` is the place in the bytes."""

    def __init__(self, schema: str | dict | list) -> None:
        self.named: dict[str, dict] = {}
        self.schema = json.loads(schema) if isinstance(schema, str) and schema.strip()[:1] in '{["' else schema
        self._learn(self.schema, "")

    def _learn(self, s, space: str) -> None:
        if isinstance(s, list):
            for x in s:
                self._learn(x, space)
        elif isinstance(s, dict):
            space = s.get("namespace", space)
            if s["type"] in ("record", "error", "enum", "fixed"):
                self.named[s["name"]] = s
                self.named[f"{space}.{s['name']}"] = s
            for f in s.get("fields", []):
                self._learn(f["type"], space)
            for k in ("items", "values"):
                self._learn(s.get(k), space)
            if isinstance(s["type"], (dict, list)):
                self._learn(s["type"], space)

    def read(self, data: bytes):
        self.data, self.at = data, 0
        return self._value(self.schema)

    def _take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("truncated Avro body")
        self.at += n
        return self.data[self.at - n : self.at]

    def _long(self) -> int:
        value = shift = 0
        while True:
            b = self._take(1)[0]
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return (value >> 1) ^ -(value & 1)
            shift += 7
            if shift > 63:
                raise ValueError("too long a number")

    def _blocks(self):
        while n := self._long():
            if n < 0:
                n = -n
                self._long()
            yield from range(n)

    def _value(self, s):
        if isinstance(s, list):
            return self._value(s[self._long()])
        kind = s["type"] if isinstance(s, dict) else s
        if isinstance(kind, (dict, list)):
            return self._value(kind)
        if kind == "null":
            return None
        if kind == "boolean":
            return self._take(1) != b"\0"
        if kind in ("int", "long"):
            return self._long()
        if kind in ("float", "double"):
            return struct.unpack("<f" if kind == "float" else "<d", self._take(4 if kind == "float" else 8))[0]
        if kind == "string":
            return self._take(self._long()).decode()
        if kind == "bytes":
            return base64.b64encode(self._take(self._long())).decode()
        if kind == "array":
            return [self._value(s["items"]) for _ in self._blocks()]
        if kind == "map":
            return {self._take(self._long()).decode(): self._value(s["values"]) for _ in self._blocks()}
        if kind in ("record", "error"):
            return {f["name"]: self._value(f["type"]) for f in s["fields"]}
        if kind == "enum":
            return s["symbols"][self._long()]
        if kind == "fixed":
            return base64.b64encode(self._take(s["size"])).decode()
        return self._value(self.named[kind])

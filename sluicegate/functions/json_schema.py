"""JSON Schema keywords compiled to Catalyst predicates over a VARIANT column."""

from __future__ import annotations

import json


from pyspark.sql import Column
from pyspark.sql import functions as F

#: The five JSON types that checks tell apart.
TAGS = ("string", "number", "boolean", "object", "array")


def type_tag(value: Column) -> Column:
    """string, number, boolean, object or array; null for JSON null and for what is missing."""
    s = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (s == "VOID"), F.lit(None).cast("string"))
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .otherwise("number")
    )


def at(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, "$" + "".join(f"['{p}']" for p in path.split(".") if p), "variant")


class Doc:
    """Values and type tags of a document's paths; what ``ready`` names is taken from columns made before."""

    def __init__(self, doc: Column, ready: dict[str, tuple[Column, Column]] | None = None) -> None:
        self.doc, self.ready = doc, ready or {}

    def value(self, path: str) -> Column:
        return self.ready[path][0] if path in self.ready else at(self.doc, path) if path else self.doc

    def tag(self, path: str) -> Column:
        return self.ready[path][1] if path in self.ready else type_tag(self.value(path))


def paths(schema: dict, path: str = "") -> list[str]:
    """All paths that a schema looks at."""
    below = lambda k: f"{path}.{k}" if path else k
    out = [path, *[below(k) for k in schema.get("required", [])]]
    for k, sub in schema.get("properties", {}).items():
        out += paths(sub, below(k))
    return list(dict.fromkeys(out))


def errors(doc: Doc, schema: dict, path: str = "") -> list[Column]:
    """Messages of violated keywords (null where one holds), in the order of the schema. Understood: type, required,
    properties, enum, const, minLength, maxLength, pattern, minimum, maximum, exclusive bounds, items' type."""
    value = doc.value(path)
    name, tag, found = f"${'.' + path if path else ''}", doc.tag(path), []
    text, number = (F.try_variant_get(value, "$", t) for t in ("string", "double"))
    given = value.isNotNull()

    def fail(when: Column, message: Column | str) -> None:
        found.append(F.when(given & when, message if isinstance(message, Column) else F.lit(message)))

    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        own = F.coalesce(tag, F.lit("null"))
        whole = (own == "number") & (number == F.floor(number))
        ok = own.isin([k for k in kinds if k != "integer"]) | (whole if "integer" in kinds else F.lit(False))
        fail(~ok, F.concat(F.lit(f"{name}: "), own, F.lit(f" found, {' or '.join(kinds)} expected")))
    if "enum" in schema or "const" in schema:
        allowed = schema.get("enum", [schema.get("const")])
        fail(~F.coalesce(F.to_json(value), F.lit("null")).isin([json.dumps(a, ensure_ascii=False, separators=(",", ":")) for a in allowed]), f"{name}: value not allowed")
    for key, test in (("minLength", lambda n: F.length(text) < n), ("maxLength", lambda n: F.length(text) > n), ("pattern", lambda p: ~text.rlike(p))):
        if key in schema:
            fail((tag == "string") & test(schema[key]), f"{name}: {key} {schema[key]} violated")
    for key, test in (("minimum", lambda n: number < n), ("maximum", lambda n: number > n), ("exclusiveMinimum", lambda n: number <= n), ("exclusiveMaximum", lambda n: number >= n)):
        if key in schema:
            fail((tag == "number") & test(schema[key]), f"{name}: {key} {schema[key]} violated")
    for key in schema.get("required", []):
        child = doc.value(f"{path}.{key}" if path else key)
        fail((tag == "object") & child.isNull(), f"{name}: required property '{key}' not found")
    for key, sub in schema.get("properties", {}).items():
        found += errors(doc, sub, f"{path}.{key}" if path else key)
    if isinstance(schema.get("items"), dict) and "type" in schema["items"]:
        kinds = schema["items"]["type"] if isinstance(schema["items"]["type"], list) else [schema["items"]["type"]]
        items = F.try_variant_get(value, "$", "array<variant>")
        fail((tag == "array") & F.exists(items, lambda x: ~F.coalesce(type_tag(x), F.lit("null")).isin(["number" if k == "integer" else k for k in kinds])), f"{name}: item type")
    return found


def first_error(doc: Doc, schema: dict | None) -> Column:
    """The first violated keyword's message; null when the document is valid or no schema is known."""
    if schema is None:
        return F.lit(None).cast("string")
    found = errors(doc, schema)
    return F.coalesce(*found) if found else F.lit(None).cast("string")

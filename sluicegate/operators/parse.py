"""The parse stage: one projection that decodes, checks and routes records.

A record that can't be used gets one reject reason (the first that holds); missing required fields and schema
violations are reported too but the record is still analysed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicegate.config import Thresholds
from sluicegate.functions.json_schema import Doc, at, first_error, paths, type_tag

#: Numbers below this are seconds, others milliseconds.
SECONDS_BELOW = 100_000_000_000
#: How far event times may lie ahead of now.
AHEAD_MS = 24 * 3_600_000
DETAIL = 200
DUPLICATES = "spark.sql.variant.allowDuplicateKeys"


def event_time_ms(value: Column, tag: Column) -> Column:
    """Epoch milliseconds of a number, a whole-number text or an ISO instant with a zone; -1 for anything else, null
    when the field is missing or null."""
    text = F.try_variant_get(value, "$", "string")
    number = F.when(tag == "number", F.try_variant_get(value, "$", "double").cast("long")).when(text.rlike(r"^-?\d+$"), text.try_cast("long"))
    scaled = F.when(F.abs(number) < SECONDS_BELOW, number * 1000).otherwise(number)
    instant = F.when(text.rlike(r"^\d{4}-\d\d-\d\dT.*(Z|[+-]\d\d:?\d\d)$"), F.unix_millis(text.try_cast("timestamp")))
    return F.when(tag.isNotNull(), F.coalesce(scaled, F.when(tag == "string", instant), F.lit(-1)))


def detail(text: Column) -> Column:
    return F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, DETAIL)


def _named(by_topic: dict[str, list[str]] | list[str]) -> list[str]:
    return list(dict.fromkeys(f for names in by_topic.values() for f in names)) if isinstance(by_topic, dict) else list(by_topic)


def _own(by_topic: dict[str, list[str]] | list[str], names: list[str]) -> Column:
    """The names that count for a record's topic; a list counts for all topics."""
    if not isinstance(by_topic, dict):
        return F.array(*map(F.lit, names)).cast("array<string>")
    table = [x for topic, own in by_topic.items() for x in (F.lit(topic), F.array(*map(F.lit, own)).cast("array<string>"))]
    return F.coalesce(F.try_element_at(F.create_map(*table), F.col("topic")), F.array().cast("array<string>")) if table else F.array().cast("array<string>")


def by_topic(thresholds: Thresholds) -> dict:
    """fields and required of each topic of the thresholds, as arguments of parse."""
    fields = {t: thresholds.fields(t) for t in thresholds.topics}
    return {"fields": fields, "required": {t: [f for f in own if thresholds.required(t, f)] for t, own in fields.items()}}


def parse(records: DataFrame, thresholds: Thresholds, fields: list[str] | dict[str, list[str]], required: list[str] | dict[str, list[str]] = (), schema: dict | str | None = None, now: Column | None = None, writers: dict[int, dict] | None = None) -> DataFrame:
    """records (topic, ingest_ts, value and others) with: reject (struct reason, detail or null), warnings (array of
    the same), event_ms, from_payload, fields (map of text), types (map of tags), keys, structural (0 skipped, 1 valid,
    2 invalid), structural_error, undecoded.

    ``fields`` and ``required`` are lists for all topics or lists by topic. ``schema`` is one for all topics. What
    ``decode.decode`` adds to records is used where it is there: its rejects come first, undecoded records pass with
    volume only, Avro is valid by construction, Protobuf isn't checked, and framed JSON is checked by its writer's
    schema (``writers``, by id)."""
    if records.sparkSession.conf.get(DUPLICATES, None) is None:
        records.sparkSession.conf.set(DUPLICATES, "true")  # of equal keys the last counts; text behind a document is passed over anyway
    schema = json.loads(schema) if isinstance(schema, str) else schema
    decoded, writers = {"text", "kind", "undecoded", "reject"} <= set(records.columns), writers or {}
    own_fields, own_required = fields, required
    fields, required = _named(own_fields), _named(own_required)
    schemas = [s for s in (schema, *writers.values()) if s]
    wanted = list(dict.fromkeys(["", thresholds.event_time_field, *fields, *required, *(p for s in schemas for p in paths(s))]))
    # one-row generators keep the optimizer from copying these expressions into every filter and column that uses them
    once = lambda df, **columns: df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    if decoded:
        records = records.withColumnsRenamed({"reject": "_refused", "undecoded": "_undecoded"})
        text, refused, undecoded, kind = F.col("text"), F.col("_refused"), F.col("_undecoded"), F.col("kind")
    else:
        text, refused, undecoded, kind = F.col("value").cast("string"), F.lit(None).cast("struct<reason:string,detail:string>"), F.lit(False), F.lit(None).cast("string")
    staged = once(records, _doc=F.when(~undecoded, F.try_parse_json(text)))
    staged = once(staged, **{f"_v{k}": at(F.col("_doc"), p) if p else F.col("_doc") for k, p in enumerate(wanted)})
    staged = once(staged, **{f"_t{k}": type_tag(F.col(f"_v{k}")) for k in range(len(wanted))})
    doc = Doc(F.col("_doc"), {p: (F.col(f"_v{k}"), F.col(f"_t{k}")) for k, p in enumerate(wanted)})
    event = thresholds.event_time_field
    staged = once(staged, _event=event_time_ms(doc.value(event), doc.tag(event)))
    limit = F.unix_millis(F.coalesce(now, F.col("ingest_ts")).cast("timestamp") if now is not None else F.col("ingest_ts").cast("timestamp")) + AHEAD_MS
    issue = lambda when, reason, more: F.when(when, F.struct(F.lit(reason).alias("reason"), detail(more).alias("detail")))
    seen = ~undecoded
    reject = F.coalesce(
        issue(F.col("value").isNull(), "null_payload", F.lit("tombstone / null value")),
        refused,
        issue(seen & F.col("_doc").isNull(), "invalid_json", F.when(F.trim(text) == "", F.lit("empty payload")).otherwise(F.lit("payload is not JSON"))),
        issue(seen & ~F.coalesce(doc.tag("") == "object", F.lit(False)), "not_a_json_object", F.lit("payload is not a JSON object")),
        issue((F.col("_event") < 0) | (F.col("_event") > limit), "bad_timestamp", F.concat(F.lit(f"{event}="), F.coalesce(F.try_variant_get(doc.value(event), "$", "string"), F.lit("")))),
    )
    wants = _own(own_fields, fields)
    pairs = lambda f: F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in fields]).cast("array<string>"), F.array(*[f(n) for n in fields]).cast("array<string>")), lambda k, v: v.isNotNull() & F.array_contains(wants, k))
    as_text = lambda n: F.when(doc.tag(n).isin("object", "array"), F.to_json(doc.value(n))).otherwise(F.try_variant_get(doc.value(n), "$", "string"))
    absent = F.array(*[F.when(doc.tag(n).isNull(), F.lit(n)) for n in required]).cast("array<string>")
    missing = F.array_join(F.filter(absent, lambda x: x.isNotNull() & F.array_contains(_own(own_required, required), x)), ",")
    bad, checked = first_error(doc, schema), F.lit(schema is not None)
    if decoded:
        framed = F.col("schema_id").isNotNull()
        known = F.col("schema_id").isin(list(writers)) if writers else F.lit(False)
        by_writer = F.coalesce(*[F.when(F.col("schema_id") == i, first_error(doc, w)) for i, w in writers.items()], F.lit(None).cast("string"))
        bad = F.when(kind.isin("AVRO", "PROTOBUF"), None).when(framed, by_writer).otherwise(bad)
        checked = F.when(F.coalesce(kind, F.lit("")) == "AVRO", True).when(kind == "PROTOBUF", False).when(framed, known).otherwise(checked)
    analysed, usable = F.col("reject").isNull(), F.col("reject").isNull() & seen
    warnings = F.filter(F.array(issue(missing != "", "required_field_missing", missing), issue(bad.isNotNull(), "schema_violation", bad)), lambda x: x.isNotNull())
    nothing = F.create_map().cast("map<string,string>")
    return (
        once(staged, reject=reject)
        .withColumns({
            "warnings": F.when(usable, warnings),
            "event_ms": F.when(analysed, F.coalesce("_event", F.unix_millis(F.col("ingest_ts").cast("timestamp")))),
            "from_payload": usable & F.col("_event").isNotNull(),
            "fields": F.when(usable, pairs(as_text)).when(analysed, nothing),
            "types": F.when(usable, pairs(doc.tag)).when(analysed, nothing),
            "keys": F.when(usable, F.array_distinct(F.json_object_keys(text))),
            "structural": F.when(analysed, F.when(undecoded | ~checked, 0).when(bad.isNull(), 1).otherwise(2)).cast("tinyint"),
            "structural_error": F.when(usable, bad),
            "undecoded": undecoded,
        })
        .drop("_doc", "_event", "_refused", "_undecoded", *[f"_{x}{k}" for k in range(len(wanted)) for x in "vt"])
    )


def dead_letters(parsed: DataFrame) -> DataFrame:
    """A row for each reason of each record: reason, detail, topic, source_partition, source_offset, its own time
    (``timestamp`` where there is one, else that of ingestion), key (where there is one) and value."""
    reasons = F.filter(F.concat(F.array("reject"), F.coalesce("warnings", F.array().cast("array<struct<reason:string,detail:string>>"))), lambda x: x.isNotNull())
    time = F.coalesce(F.col("timestamp").cast("timestamp"), F.col("ingest_ts").cast("timestamp")) if "timestamp" in parsed.columns else F.col("ingest_ts").cast("timestamp")
    key = F.col("key").cast("binary") if "key" in parsed.columns else F.lit(None).cast("binary")
    return parsed.select(F.explode(reasons).alias("r"), "topic", "source_partition", "source_offset", "ingest_ts", time.alias("source_ts"), key.alias("key"), "value").select("r.reason", "r.detail", "topic", "source_partition", "source_offset", "ingest_ts", "source_ts", "key", "value")


def dead_letter_json(letters: DataFrame) -> DataFrame:
    """Key and JSON value of the dead-letter topic; nulls are written."""
    body = F.struct("reason", "detail", F.col("topic").alias("source_topic"), "source_partition", "source_offset", F.unix_millis("source_ts").alias("source_timestamp_ms"), F.base64("key").alias("key_b64"), F.base64(F.col("value").cast("binary")).alias("value_b64"))
    return letters.select("key", F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def analysed(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject").isNull())

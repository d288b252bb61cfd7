"""Parsing of odd documents, by topic, and of what decoding hands on."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from sluicegate.config import Thresholds
from sluicegate.operators import parse, windows
from sluicegate.operators.decode import decode
from sluicegate.sources.registry import schema_table

NOW = datetime(2023, 11, 15, 12)
T = Thresholds.parse("{event_time_field: when.at, topics: {cars: {fields: {plate: {required: true}, wheels: {}}}, boats: {fields: {name: {required: true}, crew: {}, when: {}}}}}")


def parsed(spark, rows, fields=None, **more):
    df = spark.createDataFrame([(t, k, NOW, v) for k, (t, v) in enumerate(rows)], "topic string, k int, ingest_ts timestamp, value string")
    return {r["k"]: r for r in parse.parse(df, T, fields or [], **more).collect()}


def test_fields_and_required_are_those_of_the_topic(spark):
    rows = [("cars", '{"plate":"x","wheels":4,"name":"n","crew":2}'), ("boats", '{"plate":"x","crew":[1,2],"when":{"at":1700000000}}'), ("planes", '{"plate":"x","name":"n"}')]
    df = spark.createDataFrame([(t, k, NOW, v) for k, (t, v) in enumerate(rows)], "topic string, k int, ingest_ts timestamp, value string")
    got = {r["k"]: r for r in parse.parse(df, T, **parse.by_topic(T)).collect()}
    assert got[0]["fields"] == {"plate": "x", "wheels": "4"} and got[0]["types"] == {"plate": "string", "wheels": "number"} and not got[0]["warnings"]
    assert got[1]["fields"] == {"crew": "[1,2]", "when": '{"at":1700000000}'} and [(w["reason"], w["detail"]) for w in got[1]["warnings"]] == [("required_field_missing", "name")]
    assert got[2]["fields"] == {} and not got[2]["warnings"] and got[2]["reject"] is None
    assert got[1]["event_ms"] == 1700000000000 and got[1]["from_payload"] and not got[0]["from_payload"]


def test_tolerated_and_refused_documents(spark):
    bodies = ['{"plate":"a","plate":"b"}', '{"plate":"a"} and more', '{"plate":"a"', "", "  ", "[]", '"text"', "null", None, '{"plate":"\\u00e9"}', '{"when":{"at":"2023-11-14T10:00:00+02:00"}}', '{"when":{"at":"tomorrow"}}', '{"when":{"at":1700222400}}', '{"when":{"at":null}}', '{"when":{"at":true}}']
    got = parsed(spark, [("cars", b) for b in bodies], ["plate"])
    reasons = [r["reject"]["reason"] if r["reject"] else None for _, r in sorted(got.items())]
    assert reasons == [None, None, *["invalid_json"] * 3, *["not_a_json_object"] * 3, "null_payload", None, None, "bad_timestamp", "bad_timestamp", None, "bad_timestamp"]
    assert got[0]["fields"] == {"plate": "b"} and got[0]["keys"] == ["plate"] and got[1]["fields"] == {"plate": "a"} and got[9]["fields"] == {"plate": "é"}
    assert got[10]["event_ms"] == 1699948800000 and got[3]["reject"]["detail"] == "empty payload" and got[13]["event_ms"] == int(NOW.timestamp() * 1000)


def test_long_details_are_cut(spark):
    got = parsed(spark, [("cars", json.dumps({"when": {"at": "x\ny" * 300}}))])
    assert len(got[0]["reject"]["detail"]) == 200 and "\n" not in got[0]["reject"]["detail"]


def test_undecoded_records_count_for_volume_only(spark):
    avro = '{"type":"record","name":"A","fields":[{"name":"plate","type":"string"}]}'
    frame = lambda i, b: bytearray(b"\0" + i.to_bytes(4, "big") + b)
    rows = [("cars", 0, NOW, frame(5, b"\x02z")), ("cars", 1, NOW, frame(6, b"\x02z")), ("cars", 2, NOW, bytearray(b'{"plate":"y"}'))]
    df = spark.createDataFrame(rows, "topic string, k int, ingest_ts timestamp, value binary")
    schemas = schema_table(spark, [(5, "AVRO", avro, None)])
    schema = {"type": "object", "properties": {"plate": {"maxLength": 0}}}
    away = parse.parse(decode(df, schemas, registry_up=False), T, ["plate"], schema=schema)
    got = {r["k"]: r for r in away.collect()}
    assert [got[k]["undecoded"] for k in range(3)] == [False, True, False] and [got[k]["structural"] for k in range(3)] == [1, 0, 2]
    assert got[1]["fields"] == {} and got[1]["reject"] is None and not got[1]["from_payload"] and got[1]["keys"] is None
    w = windows.topic_windows(parse.analysed(away), ["plate"], 3600).first()
    assert (w["n"], w["decoded"], w["present_plate"], w["checked"], w["invalid"], w["skipped"]) == (3, 2, 2, 2, 1, 1)
    up = {r["k"]: r for r in parse.parse(decode(df, schemas), T, ["plate"]).collect()}
    assert up[1]["reject"]["reason"] == "unknown_schema_id" and up[0]["fields"] == {"plate": "z"}
    letters = parse.dead_letters(parse.parse(decode(df.withColumns({"source_partition": F.lit(0), "source_offset": F.col("k")}), schemas), T, ["plate"])).collect()
    assert [(r["reason"], r["source_offset"]) for r in letters] == [("unknown_schema_id", 1)]


def test_rankings_are_cut(spark, monkeypatch):
    monkeypatch.setattr(windows, "KEYS_KEPT", 3)
    monkeypatch.setattr(windows, "ERRORS_KEPT", 2)
    schema = {"properties": {"a": {"type": "string"}, "b": {"type": "string"}, "c": {"type": "string"}}}
    bodies = ['{"a":1,"x":0}'] * 5 + ['{"b":1,"y":0}'] * 3 + ['{"c":1,"y":0}'] * 3 + ['{"z":1}']
    df = spark.createDataFrame([("cars", NOW, b) for b in bodies], "topic string, ingest_ts timestamp, value string")
    records = parse.parse(df, T, [], schema=schema)
    both = windows.tallies(records, 3600).first()
    assert both["keys"] == {"y": 6, "a": 5, "x": 5} == windows.key_counts(records, 3600).first()["keys"]
    errors = {r["error"]: r["c"] for r in windows.top_errors(records, 3600).collect()}
    assert both["errors"] == errors and sorted(errors.values()) == [3, 5] and any("$.b" in e for e in errors)

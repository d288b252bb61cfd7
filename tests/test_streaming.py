"""The monitor on a file stream: closed windows, state across batches, and a restart that repeats nothing."""

import base64
import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sluicegate.config import Thresholds
from sluicegate.operators import parse
from sluicegate.sources.records import file_stream, heartbeats
from sluicegate.streaming import monitor

T0 = datetime(2024, 1, 1)
SCHEMA = "topic string, ingest_ts timestamp, value string"
THRESHOLDS = Thresholds.parse("{window: {size: 60s, max_out_of_orderness: 1s}, event_time_field: ts, topics: {t: {fields: {id: {cardinality: true}}}}}")


def put(spark, path, minutes, per_minute):
    rows = [("t", T0 + timedelta(minutes=m, seconds=s), f'{{"id":"{m}-{s}"}}' if s % 4 else '{"id":null}') for m in minutes for s in range(per_minute)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_monitor_keeps_state_over_restarts(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run():
        parsed = parse.analysed(parse.parse(file_stream(spark, source, SCHEMA), THRESHOLDS, ["id"]))
        monitor.start(parsed, None, THRESHOLDS, ["id"], ["id"], out, checkpoint, available_now=True).awaitTermination()

    put(spark, source, range(8), 40)
    run()
    put(spark, source, range(8, 12), 8)
    run()
    run()
    results = spark.read.parquet(f"{out}/results/*").where("check_type = 'volume'")
    got = {r["window_start"]: r["status"] for r in results.collect()}
    assert len(got) == results.count() == 11
    assert [got[k] for k in sorted(got)] == ["ok"] * 8 + ["fail"] * 3
    assert {r["baseline"] for r in results.where("status = 'fail'").collect()} == {round(40 / 60, 4)}
    beats = heartbeats(spark.read.parquet(f"{out}/heartbeats/*"))
    assert beats.count() == spark.read.parquet(f"{out}/heartbeats/*").select("ts").distinct().count() > 1
    nulls = spark.read.parquet(f"{out}/results/*").where("check_type = 'null_rate'")
    assert {r["value"] for r in nulls.collect()} == {0.25} and nulls.agg(F.count("*")).first()[0] == 11


def test_ticks_make_silent_windows(spark, tmp_path):
    source, beat, out, checkpoint = (str(tmp_path / n) for n in ("in", "ticks", "out", "checkpoint"))
    put(spark, source, range(8), 40)
    ticks = [(t, T0 + timedelta(minutes=m, seconds=30), True) for m in range(12) for t in ("t", "quiet")]
    spark.createDataFrame(ticks, "topic string, ingest_ts timestamp, synthetic boolean").write.parquet(beat)
    parsed = parse.analysed(parse.parse(file_stream(spark, source, SCHEMA), THRESHOLDS, ["id"]))
    query = monitor.start(parsed, file_stream(spark, beat, "topic string, ingest_ts timestamp, synthetic boolean"), THRESHOLDS, ["id"], ["id"], out, checkpoint, available_now=True)
    query.awaitTermination()
    got = {(r["topic"], (r["window_start"] - T0).seconds // 60): (r["value"], r["status"]) for r in spark.read.parquet(f"{out}/results/*").where("check_type = 'volume'").collect()}
    assert got == {("t", m): (40 / 60, "ok") if m < 8 else (0.0, "fail") for m in range(11)} | {("quiet", m): (0.0, "fail") for m in range(11)}
    assert not spark.read.parquet(f"{out}/results/*").where("check_type = 'null_rate' AND topic = 'quiet'").count()
    assert monitor.metrics(query.recentProgress)["rows"] >= 8 * 40 + 24


def test_late_rows_are_counted(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run():
        parsed = parse.analysed(parse.parse(file_stream(spark, source, SCHEMA), THRESHOLDS, ["id"]))
        query = monitor.start(parsed, None, THRESHOLDS, ["id"], [], out, checkpoint, available_now=True)
        query.awaitTermination()
        return monitor.metrics(query.recentProgress)

    put(spark, source, range(5), 20)
    assert run()["late_rows"] == 0
    put(spark, source, [1, 6], 10)
    assert run()["late_rows"] > 0  # rows after partial aggregation: Spark counts what reaches the state
    windows = spark.read.parquet(f"{out}/windows/*").collect()
    assert sorted(r["n"] for r in windows if r["window_start"] == T0 + timedelta(minutes=1)) == [20]


def test_schema_drift_and_dead_letters_of_a_stream(spark, tmp_path):
    source, out, letters = (str(tmp_path / n) for n in ("in", "out", "letters"))
    body = lambda m, s: None if s == 7 else "{oops" if s == 8 else f'{{"id":"{m}-{s}","{"new" if m > 7 else "old"}":1}}'
    rows = [("t", T0 + timedelta(minutes=m, seconds=s), body(m, s), 0, 100 * m + s, f"k{s}".encode()) for m in range(11) for s in range(20)]
    schema = f"{SCHEMA}, source_partition int, source_offset long, key binary"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    parsed = lambda: parse.parse(file_stream(spark, source, schema), THRESHOLDS, ["id"])
    monitor.start_keys(parse.analysed(parsed()), THRESHOLDS, out, str(tmp_path / "c1"), available_now=True).awaitTermination()
    monitor.start_dead_letters(parsed(), str(tmp_path / "c2"), letters, available_now=True).awaitTermination()
    got = {(r["window_start"] - T0).seconds // 60: (r["status"], r["value"], r["details"]) for r in spark.read.parquet(f"{out}/results/*").collect()}
    assert [got[m][:2] for m in range(10)] == [("ok", 0.0)] * 8 + [("warn", 2.0)] * 2
    assert json.loads(got[8][2])["appeared"] == ["new"] and json.loads(got[8][2])["disappeared"] == ["old"]
    sent = parse.dead_letter_json(spark.read.parquet(letters)).collect()
    bodies = [json.loads(r["value"]) for r in sent]
    assert sorted({b["reason"] for b in bodies}) == ["invalid_json", "null_payload"] and len(bodies) == 22
    assert {base64.b64decode(b["key_b64"]) for b in bodies} == {b"k7", b"k8"} == {bytes(r["key"]) for r in sent}


def test_compaction_keeps_what_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(monitor, "COMPACT_EVERY", 2)
    out = str(tmp_path / "out")
    write = monitor.sink(out, THRESHOLDS, [], [], keyed=False)
    schema = "topic string, window_start timestamp, n long, decoded long, measured long, p50_ms double, p95_ms double, p99_ms double, max_ms double, future long, checked long, invalid long, skipped long"
    for batch in range(8):
        topics = ["a"] if batch % 2 else ["a", "b"]
        rows = [(t, T0 + timedelta(minutes=batch), 60, 60, 0, None, None, None, None, 0, 0, 0, 60) for t in topics]
        for _ in range(2):  # replayed
            write(spark.createDataFrame(rows, schema), batch)
    folders = [monitor._number(p) for p in monitor.earlier(spark, f"{out}/state", 8)]
    assert folders == [6, 7] and sorted(map(monitor._number, monitor._folders(spark, f"{out}/state"))) == [4, 5, 6, 7]
    state = monitor.newest_state(spark.read.schema(monitor.STATE).parquet(*monitor.earlier(spark, f"{out}/state", 8)), 8)
    assert {r["topic"]: len(json.loads(r["state"])["history"]) for r in state.collect()} == {"a": 8, "b": 4}

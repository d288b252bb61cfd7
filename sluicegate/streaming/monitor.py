"""The monitor as Structured Streaming: parsed records and ticks in one watermarked window aggregation; closed windows
are judged per micro-batch with the same fold as in batch, the state coming from the batch before.

Batch n reads the states of the batches below it and overwrites its own folders, so a replayed batch leaves the same
tables. Only series with closed windows are in a batch's state; older ones are found in older batches, and every
``COMPACT_EVERY`` batches the whole state is written anew, so no batch reads further back than that; what is older
than the compaction before is deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.config import Thresholds
from sluicegate.operators import baseline, checks, parse
from sluicegate.operators.baseline import RESULT
from sluicegate.operators.results import result_rows
from sluicegate.operators.windows import KEYS_KEPT, most_frequent

STATE = "topic string, check_type string, field string, state string, batch long"
COMPACT_EVERY = 50
VERSION = "1"


def windowed(parsed: DataFrame, ticks: DataFrame | None, thresholds: Thresholds, fields: list[str]) -> DataFrame:
    """Streaming window statistics with sketches; ticks make empty windows close with n = 0."""
    columns = ["topic", "ingest_ts", "event_ms", "from_payload", "fields", "types", "structural", "undecoded"]
    rows = parsed.select(*columns, F.lit(False).alias("synthetic"))
    if ticks is not None:
        rows = rows.unionByName(ticks.select("topic", "ingest_ts", "synthetic"), allowMissingColumns=True)
    rows = rows.withWatermark("ingest_ts", f"{thresholds.disorder_ms} milliseconds")
    real = ~F.col("synthetic")
    late = F.when(F.col("from_payload"), F.greatest(F.unix_millis("ingest_ts") - F.col("event_ms"), F.lit(0)).cast("double"))
    aggregates = [F.count_if(real).alias("n"), F.count_if(real & ~F.col("undecoded")).alias("decoded"), F.count("_late").alias("measured"), F.max("_late").alias("max_ms"), F.count_if(F.col("from_payload") & (F.unix_millis("ingest_ts") < F.col("event_ms"))).alias("future"), F.expr("kll_sketch_agg_double(_late, 200)").alias("lags")]
    aggregates += [F.count_if(F.col("structural") > 0).alias("checked"), F.count_if(F.col("structural") == 2).alias("invalid"), F.count_if(real & (F.col("structural") == 0)).alias("skipped")]
    for f in fields:
        value, tag = F.col("fields").getItem(f), F.col("types").getItem(f)
        aggregates += [F.count(value).alias(f"present_{f}"), F.hll_sketch_agg(value, 12).alias(f"hll_{f}"), *[F.count_if(tag == t).alias(f"{t}_{f}") for t in checks.TAGS]]
    grouped = rows.withColumn("_late", late).groupBy(F.window("ingest_ts", f"{thresholds.window_ms} milliseconds").alias("w"), "topic").agg(*aggregates)
    out = grouped.withColumns({f"distinct_{f}": F.hll_sketch_estimate(f"hll_{f}") for f in fields} | {f"p{q}_ms": F.when(F.col("measured") > 0, F.expr(f"kll_sketch_get_quantile_double(lags, 0.{q}D)")) for q in (50, 95, 99)})
    return out.select(F.col("w.start").alias("window_start"), *[c for c in out.columns if c not in ("w", "lags") and not c.startswith("hll_")])


def windowed_keys(parsed: DataFrame, thresholds: Thresholds) -> DataFrame:
    """Streaming counts of top-level keys by topic and window; the empty key stands for all decoded records."""
    rows = parsed.where("NOT undecoded").select("topic", "ingest_ts", F.explode(F.concat(F.array(F.lit("")), F.coalesce("keys", F.array().cast("array<string>")))).alias("key")).withWatermark("ingest_ts", f"{thresholds.disorder_ms} milliseconds")
    counted = rows.groupBy(F.window("ingest_ts", f"{thresholds.window_ms} milliseconds").alias("w"), "topic", "key").agg(F.count(F.lit(1)).alias("c"))
    return counted.select("topic", F.col("w.start").alias("window_start"), "key", "c")


def key_windows(counted: DataFrame) -> DataFrame:
    """Closed key counts as windows (topic, window_start, n, decoded, keys)."""
    total = counted.where("key = ''").select("topic", "window_start", F.col("c").alias("n"), F.col("c").alias("decoded"))
    kept = most_frequent(counted.where("key <> ''"), ["topic", "window_start"], "key", KEYS_KEPT)
    keys = kept.groupBy("topic", "window_start").agg(F.map_from_entries(F.collect_list(F.struct("key", "c"))).alias("keys"))
    return total.join(keys, ["topic", "window_start"], "left").withColumn("keys", F.coalesce("keys", F.create_map().cast("map<string,bigint>")))


def metrics(progress: list) -> dict[str, float]:
    """Figures of a query's progress reports: rows read, rows a second, rows that came too late for their window, rows
    of state, and how far the watermark lies behind the newest event, in ms."""
    from datetime import datetime

    out = {"rows": 0, "late_rows": 0, "rows_per_s": 0.0, "state_rows": 0, "behind_ms": 0.0}
    for p in progress:
        out["rows"] += p["numInputRows"]
        out["late_rows"] += sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])
        out["rows_per_s"] = p.get("processedRowsPerSecond") or out["rows_per_s"]
        out["state_rows"] = sum(o["numRowsTotal"] for o in p["stateOperators"])
        times = {k: datetime.fromisoformat(v.replace("Z", "+00:00")) for k, v in (p.get("eventTime") or {}).items()}
        if "max" in times:
            out["behind_ms"] = (times["max"] - times["watermark"]).total_seconds() * 1000
    return out


def newest_state(state: DataFrame, below: int) -> DataFrame:
    return state.where(F.col("batch") < below).groupBy("topic", "check_type", "field").agg(F.max_by("state", "batch").alias("state"))


def judge_batch(closed: DataFrame, state: DataFrame, thresholds: Thresholds, batch: int, fields: list[str], distinct_fields: list[str], only: list[str] | None = None) -> DataFrame:
    """Verdicts and new states of the series that have closed windows: the result columns and state (null in all
    rows of a series but its last)."""
    series = baseline.samples(closed, fields, distinct_fields, only)
    keys = ["topic", "check_type", "field"]
    joined = series.join(newest_state(state, batch), keys, "left")
    size, history, rebaseline = thresholds.window_ms / 1000, thresholds.history_windows, thresholds.rebaseline_after

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("window_start").to_dict("records")
        for r in rows:
            r["start_ms"] = int(r["window_start"].timestamp() * 1000)
        before = rows[0]["state"]
        out, after = baseline.fold(rows, checks.settings(thresholds, key[0], key[1], key[2]), size, history, rebaseline, json.loads(before) if isinstance(before, str) else None)
        got = [(*key, r["window_start"], float(v.value), float(v.threshold), v.status, v.details_json(), None) for r, v in out]
        if got:
            got[-1] = (*got[-1][:-1], baseline.state_json(after))
        return pd.DataFrame(got, columns=[*keys, "window_start", "value", "threshold", "status", "details", "state"])

    return joined.groupBy(*keys).applyInPandas(run, f"{RESULT}, state string")


def sink(folder: str, thresholds: Thresholds, fields: list[str], distinct_fields: list[str], keyed: bool = False, job_id: str = "monitor") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes windows, results, states and a heartbeat below a folder. ``keyed``: the
    batches are key counts, judged for schema drift, else window statistics for all other checks."""

    def write(closed: DataFrame, batch: int) -> None:
        spark = closed.sparkSession
        closed.write.mode("overwrite").parquet(f"{folder}/windows/batch_id={batch}")
        closed = spark.read.parquet(f"{folder}/windows/batch_id={batch}")
        closed = key_windows(closed) if keyed else closed
        states = f"{folder}/state"
        before = earlier(spark, states, batch)
        state = spark.read.schema(STATE).parquet(*before) if before else spark.createDataFrame([], STATE)
        path = f"{folder}/judged/batch_id={batch}"
        judge_batch(closed, state, thresholds, batch, fields, distinct_fields, ["schema_drift"] if keyed else None).write.mode("overwrite").parquet(path)
        judged = spark.read.parquet(path)
        rows = judged.drop("state")
        if not keyed:
            rows = rows.unionByName(checks.plain_rows(closed, thresholds, fields))
        result_rows(rows, thresholds.window_ms // 1000, job_id).write.mode("overwrite").parquet(f"{folder}/results/batch_id={batch}")
        new = judged.where("state IS NOT NULL").select("topic", "check_type", "field", "state", F.lit(batch).cast("long").alias("batch"))
        if batch and batch % COMPACT_EVERY == 0:
            new = newest_state(state.unionByName(new), batch + 1).withColumn("batch", F.lit(batch).cast("long"))
        new.write.mode("overwrite").parquet(f"{states}/batch_id={batch}")
        spark.range(1).select(F.lit(job_id).alias("job_id"), F.current_timestamp().alias("ts"), F.lit(VERSION).alias("version"), F.lit("up").alias("kafka_status"), F.lit(None).cast("string").alias("registry_status"), F.lit(batch).cast("long").alias("seq")).write.mode("overwrite").parquet(f"{folder}/heartbeats/batch_id={batch}")
        if batch and batch % COMPACT_EVERY == 0:  # neither this batch's replay nor a later one reads these
            files = _files(spark, states)
            for old in _folders(spark, states):
                if _number(old) < batch - COMPACT_EVERY:
                    files.delete(spark._jvm.org.apache.hadoop.fs.Path(old), True)

    return write


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _number(path: str) -> int:
    return int(path.rpartition("=")[2])


def _folders(spark: SparkSession, states: str) -> list[str]:
    """The folders of states; a storage error is raised, not taken for a first batch."""
    top, files = spark._jvm.org.apache.hadoop.fs.Path(states), _files(spark, states)
    found = files.listStatus(top) if files.exists(top) else []
    return sorted((p.getPath().toString() for p in found if p.getPath().getName().startswith("batch_id=")), key=_number)


def earlier(spark: SparkSession, states: str, batch: int) -> list[str]:
    """The folders that a batch reads: of the batches below it, from the last compaction on."""
    since = (batch - 1) // COMPACT_EVERY * COMPACT_EVERY if batch else 0
    return [p for p in _folders(spark, states) if since <= _number(p) < batch]


def _started(frame: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool):
    writer = frame.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")).start()


def start(parsed: DataFrame, ticks: DataFrame | None, thresholds: Thresholds, fields: list[str], distinct_fields: list[str], folder: str, checkpoint: str, available_now: bool = False):
    """Starts the main query over analysed records. Append mode: a window is judged once, when the watermark passes its
    end. The watermark follows the newest event of all partitions, so an idle one holds nothing back; ticks move it on
    when all are idle, and give silent topics windows without records."""
    return _started(windowed(parsed, ticks, thresholds, fields), sink(folder, thresholds, fields, distinct_fields), checkpoint, available_now)


def start_keys(parsed: DataFrame, thresholds: Thresholds, folder: str, checkpoint: str, available_now: bool = False):
    """Starts schema drift as a query of its own, as it counts by key."""
    return _started(windowed_keys(parsed, thresholds), sink(folder, thresholds, [], [], keyed=True), checkpoint, available_now)


def start_dead_letters(parsed: DataFrame, checkpoint: str, folder: str | None = None, kafka: dict[str, str] | None = None, available_now: bool = False):
    """Starts the dead letters of all parsed records, as files or (``kafka``: its options) as messages."""
    letters = parse.dead_letters(parsed)
    frame = parse.dead_letter_json(letters) if kafka else letters
    writer = frame.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="2 seconds")
    return writer.format("kafka").options(**kafka).start() if kafka else writer.format("parquet").start(folder)


def consumer_delay(records: DataFrame, now_column: str = "ingest_ts") -> DataFrame:
    """Largest delay per topic between a record's own time and its ingestion, not below 0; times of 0 are ignored."""
    delay = F.unix_millis(F.col(now_column).cast("timestamp")) - F.unix_millis(F.col("timestamp").cast("timestamp"))
    return records.where(F.unix_millis(F.col("timestamp").cast("timestamp")) > 0).groupBy("topic").agg(F.greatest(F.max(delay), F.lit(0)).alias("delay_ms"))

"""The catalogue of queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.config import Thresholds
from sluicegate.operators import baseline, checks, decode, parse, results, windows
from sluicegate.plans import alerts, analytics
from sluicegate.sources import records as record_sources
from sluicegate.sources import topics
from sluicegate.sources.fixtures import DUCK_RECORDS, event_records
from sluicegate.sources.registry import schema_table
from sluicegate.streaming.monitor import consumer_delay

SIZE_S = 6 * 3600
FIELDS, REQUIRED, DISTINCT = ["id", "user_id", "amount"], ["id"], ["user_id"]
SCHEMA = {"type": "object", "required": ["id"], "properties": {"id": {"type": "string", "minLength": 1}, "amount": {"type": "number", "minimum": 0}}}
THRESHOLDS = Thresholds.parse("""
window: {size: 6h, max_out_of_orderness: 10s}
event_time_field: event_time
history_windows: 30
rebaseline_after: 4
defaults:
  null_rate: {warn: 0.05, fail: 0.20}
topics:
  ev.click: {fields: {id: {required: true}, user_id: {cardinality: true, null_rate: {warn: 0.30, fail: 0.50}}, amount: {}}}
  ev.view: {null_rate: {warn: 0.10}, fields: {id: {required: true}, user_id: {cardinality: true}, amount: {}}}
  ev.error: {fields: {id: {required: true}, user_id: {cardinality: true}, amount: {}}}
  ev.purchase: {fields: {id: {required: true}, user_id: {cardinality: true}, amount: {}}}
  ev.signup: {fields: {id: {required: true}, user_id: {cardinality: true}, amount: {}}}
""")
SEASONAL = Thresholds(THRESHOLDS.raw | {"defaults": {"volume": {"seasonality": "daily"}}})
NOW = "TIMESTAMP_NTZ'2024-01-30 12:00:00'"
FIXED_TS = "TIMESTAMP_NTZ'2024-01-01'"
DUCK_NOW = "TIMESTAMP '2024-01-30 12:00:00'"

#: Results made of the events, in SQL that Spark and DuckDB read alike: statuses from counts, no baseline.
SEED = """SELECT topic, check_type, field, window_start, window_start + INTERVAL '6' HOUR AS window_end, value, threshold, status, seq FROM (
SELECT topic, 'volume' AS check_type, '' AS field, window_start, CAST(n AS DOUBLE) AS value, CAST(12 AS DOUBLE) AS threshold, CASE WHEN n < 9 THEN 'fail' WHEN n < 13 THEN 'warn' ELSE 'ok' END AS status, n AS seq FROM w
UNION ALL SELECT topic, 'null_rate', 'user_id', window_start, CAST(nulls AS DOUBLE) / n, CAST(0.3 AS DOUBLE), CASE WHEN nulls * 10 > n * 4 THEN 'fail' WHEN nulls * 10 > n * 3 THEN 'warn' ELSE 'ok' END, n FROM w
UNION ALL SELECT topic, 'null_rate', 'id', window_start, CAST(fives AS DOUBLE) / n, CAST(0.35 AS DOUBLE), CASE WHEN fives * 100 > n * 35 THEN 'fail' WHEN fives * 100 > n * 30 THEN 'warn' ELSE 'ok' END, n FROM w
UNION ALL SELECT topic, 'freshness', '', window_start, CAST(latest AS DOUBLE), CAST(30000 AS DOUBLE), CASE WHEN latest > 50000 THEN 'fail' WHEN latest > 30000 THEN 'warn' ELSE 'ok' END, n FROM w) r"""
SEED_WINDOWS = """SELECT 'ev.' || event_type AS topic, date_trunc('day', ts) + INTERVAL '6' HOUR * CAST(floor(extract(hour FROM ts) / 6) AS INT) AS window_start, count(*) AS n,
sum(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) AS nulls, sum(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS fives, max(event_id % 61) * 1000 AS latest FROM {events} GROUP BY 1, 2"""
DUCK_SEED = f"WITH w AS ({SEED_WINDOWS.format(events='events')}), results AS ({SEED}) "
DUCK_STATUS = "CASE WHEN status = 'fail' THEN 2 WHEN status = 'warn' THEN 1 ELSE 0 END"

DUCK_PARSED = f"""WITH records AS ({DUCK_RECORDS}),
docs AS (SELECT *, CASE WHEN json_valid(value) THEN value END AS j FROM records),
objects AS (SELECT *, CASE WHEN json_type(j) = 'OBJECT' THEN j END AS o FROM docs),
parsed AS (SELECT topic, source_partition, source_offset, ingest_ts, value, o,
  CASE WHEN value IS NULL THEN 'null_payload' WHEN j IS NULL THEN 'invalid_json' WHEN o IS NULL THEN 'not_a_json_object' WHEN json_extract_string(o, '$.event_time') = 'yesterday' THEN 'bad_timestamp' END AS reason,
  json_extract_string(o, '$.id') AS id, json_extract_string(o, '$.user_id') AS user_id, json_extract_string(o, '$.amount') AS amount,
  CASE json_type(o, '$.amount') WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN NULL ELSE 'number' END AS amount_type,
  CAST(CASE WHEN json_extract_string(o, '$.event_time') <> 'yesterday' THEN json_extract_string(o, '$.event_time') END AS BIGINT) AS event_ms,
  time_bucket(INTERVAL '6 hours', ingest_ts, TIMESTAMP '1970-01-01') AS window_start FROM objects),
good AS (SELECT *, greatest(epoch_ms(ingest_ts) - event_ms, 0) AS late, CASE WHEN id IS NULL THEN '$: required property ''id'' not found' WHEN amount_type = 'string' THEN '$.amount: string found, number expected' END AS error FROM parsed WHERE reason IS NULL) """
DUCK_SPINE = """, span AS (SELECT topic, min(window_start) AS lo FROM good GROUP BY topic), hi AS (SELECT max(window_start) AS hi FROM good),
spine AS (SELECT topic, unnest(generate_series(lo, hi, INTERVAL '6 hours')) AS window_start FROM span, hi),
vol AS (SELECT s.topic, s.window_start, count(g.topic) AS n FROM spine s LEFT JOIN good g USING (topic, window_start) GROUP BY ALL) """

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            out = f(spark, sf_dir)
            return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in out.dtypes])

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return keep


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse(event_records(spark, sf_dir), THRESHOLDS, FIELDS, REQUIRED, SCHEMA)


def good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.analysed(parsed(spark, sf_dir))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.topic_windows(good(spark, sf_dir), FIELDS, SIZE_S, distinct_fields=DISTINCT)


def with_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = stats(spark, sf_dir)
    return windows.with_silence(w, record_sources.window_spine(w.select("topic", "window_start"), SIZE_S))


def seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type")
    return spark.sql(f"WITH w AS ({SEED_WINDOWS}) {SEED}", events=events)


# ---- parsing ----


@query("parse_main", DUCK_PARSED + "SELECT topic, source_offset, coalesce(event_ms, epoch_ms(ingest_ts)) AS event_ms, id, user_id, amount, amount_type, CAST(len(json_keys(o)) AS BIGINT) AS n_keys, CASE WHEN error IS NULL THEN 1 ELSE 2 END AS structural FROM good")
def parse_main(spark, sf_dir):
    item = lambda f: F.col("fields").getItem(f).alias(f)
    return good(spark, sf_dir).select("topic", "source_offset", "event_ms", item("id"), item("user_id"), item("amount"), F.col("types").getItem("amount").alias("amount_type"), F.size("keys").alias("n_keys"), "structural")


DUCK_LETTERS = DUCK_PARSED + ", letters AS (SELECT reason, topic, source_offset FROM parsed WHERE reason IS NOT NULL UNION ALL SELECT 'required_field_missing', topic, source_offset FROM good WHERE id IS NULL UNION ALL SELECT 'schema_violation', topic, source_offset FROM good WHERE error IS NOT NULL) "


@query("parse_dead_letter", DUCK_LETTERS + "SELECT reason, topic, source_offset FROM letters")
def parse_dead_letter(spark, sf_dir):
    return parse.dead_letters(parsed(spark, sf_dir)).select("reason", "topic", "source_offset")


@query("dlq_reason_counts", DUCK_LETTERS + "SELECT reason, count(*) AS n FROM letters GROUP BY reason")
def dlq_reason_counts(spark, sf_dir):
    return parse.dead_letters(parsed(spark, sf_dir)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("dead_letter_messages", DUCK_PARSED + "SELECT json_object('reason', reason, 'source_offset', source_offset) AS message, base64(encode(value)) AS value_b64 FROM parsed WHERE reason IN ('invalid_json', 'not_a_json_object')")
def dead_letter_messages(spark, sf_dir):
    sent = parse.dead_letter_json(parse.dead_letters(parsed(spark, sf_dir)).where("reason IN ('invalid_json', 'not_a_json_object')"))
    body = F.from_json("value", "reason string, source_offset long, value_b64 string").alias("b")
    return sent.select(body).select(F.to_json(F.struct("b.reason", "b.source_offset")).alias("message"), "b.value_b64")


# ---- window statistics and checks without memory ----


@query("volume_windows", DUCK_PARSED + "SELECT topic, window_start, count(*) AS n FROM good GROUP BY ALL")
def volume_windows(spark, sf_dir):
    return good(spark, sf_dir).groupBy("topic", windows.window_start(F.col("ingest_ts"), SIZE_S).alias("window_start")).agg(F.count(F.lit(1)).alias("n"))


@query("volume_with_silence", DUCK_PARSED + DUCK_SPINE + "SELECT topic, window_start, n FROM vol")
def volume_with_silence(spark, sf_dir):
    return with_silence(spark, sf_dir).select("topic", "window_start", "n")


def _check_sql(value: str, warn: str, fail: str, check: str, name: str, where: str, source: str = "good") -> str:
    return DUCK_PARSED + f", v AS (SELECT topic, window_start, {value} AS value FROM {source} GROUP BY topic, window_start HAVING {where}), t AS (SELECT *, CAST({warn} AS DOUBLE) AS warn, CAST({fail} AS DOUBLE) AS fail FROM v) SELECT topic, '{name}' AS field, '{check}' AS check_type, window_start, round(value, 6) AS value, CASE WHEN value > fail THEN 'fail' WHEN value > warn THEN 'warn' ELSE 'ok' END AS status, CASE WHEN value > fail THEN fail ELSE warn END AS threshold FROM t"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6)).select("topic", "field", "check_type", "window_start", "value", "status", "threshold")


@query("null_rate_windows", _check_sql("(count(*) - count(amount)) / count(*)::DOUBLE", "CASE WHEN topic = 'ev.view' THEN 0.10 ELSE 0.05 END", "0.20", "null_rate", "amount", "count(*) > 0"))
def null_rate_windows(spark, sf_dir):
    return _rounded(checks.null_rate(stats(spark, sf_dir), THRESHOLDS, "amount"))


@query("null_rate_precedence", _check_sql("(count(*) - count(user_id)) / count(*)::DOUBLE", "CASE topic WHEN 'ev.click' THEN 0.30 WHEN 'ev.view' THEN 0.10 ELSE 0.05 END", "CASE WHEN topic = 'ev.click' THEN 0.50 ELSE 0.20 END", "null_rate", "user_id", "count(*) > 0"))
def null_rate_precedence(spark, sf_dir):
    return _rounded(checks.null_rate(stats(spark, sf_dir), THRESHOLDS, "user_id"))


@query("cardinality_exact", DUCK_PARSED + "SELECT topic, window_start, count(DISTINCT user_id) AS distinct_users FROM good GROUP BY ALL")
def cardinality_exact(spark, sf_dir):
    return stats(spark, sf_dir).select("topic", "window_start", F.col("distinct_user_id").alias("distinct_users"))


@query("sketches_merged", DUCK_PARSED + "SELECT topic, count(*) AS days, sum(n)::BIGINT AS n, true AS hll_within, true AS kll_within FROM (SELECT topic, date_trunc('day', ingest_ts) AS d, count(*) AS n FROM good GROUP BY ALL) x GROUP BY topic")
def sketches_merged(spark, sf_dir):
    """Daily HLL and KLL states merged to one for each topic, held against exact figures of all its records."""
    rows = good(spark, sf_dir).select("topic", F.date_trunc("day", "ingest_ts").alias("d"), F.col("fields").getItem("user_id").alias("u"), (F.unix_millis("ingest_ts") - F.col("event_ms")).cast("double").alias("late"))
    daily = rows.groupBy("topic", "d").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("u", 12).alias("h"), F.expr("kll_sketch_agg_double(late, 200)").alias("k"))
    merged = daily.groupBy("topic").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("h")).alias("e"), F.expr("kll_sketch_get_quantile_double(kll_merge_agg_double(k), 0.95D)").alias("q"))
    exact = rows.groupBy("topic").agg(F.countDistinct("u").alias("u"), F.expr("percentile_disc(0.93) WITHIN GROUP (ORDER BY late)").alias("lo"), F.expr("percentile_disc(0.97) WITHIN GROUP (ORDER BY late)").alias("hi"))
    return merged.join(exact, "topic").select("topic", "days", "n", (F.abs(F.col("e") - F.col("u")) <= 0.06 * F.col("u")).alias("hll_within"), F.col("q").between(F.col("lo"), F.col("hi")).alias("kll_within"))


@query("cardinality_hll_error_bound", "SELECT 'ev.' || event_type AS topic, true AS within FROM events GROUP BY event_type")
def cardinality_hll_error_bound(spark, sf_dir):
    rows = good(spark, sf_dir).select("topic", F.col("fields").getItem("id").alias("id"))
    exact = rows.groupBy("topic").agg(F.countDistinct("id").alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg("id", 12)).alias("e"))
    return exact.select("topic", (F.abs(F.col("e") - F.col("n")) <= 0.06 * F.col("n")).alias("within"))


@query("freshness_percentiles", DUCK_PARSED + "SELECT topic, window_start, count(late) AS measured, CAST(quantile_disc(late, 0.5) AS DOUBLE) AS p50_ms, CAST(quantile_disc(late, 0.95) AS DOUBLE) AS p95_ms, CAST(quantile_disc(late, 0.99) AS DOUBLE) AS p99_ms, CAST(max(late) AS DOUBLE) AS max_ms, count(*) FILTER (WHERE event_ms > epoch_ms(ingest_ts)) AS future FROM good GROUP BY topic, window_start")
def freshness_percentiles(spark, sf_dir):
    return stats(spark, sf_dir).select("topic", "window_start", "measured", "p50_ms", "p95_ms", "p99_ms", "max_ms", "future")


@query("freshness_check", _check_sql("CAST(quantile_disc(late, 0.95) AS DOUBLE)", "30000", "120000", "freshness", "", "count(late) > 0"))
def freshness_check(spark, sf_dir):
    return _rounded(checks.freshness(stats(spark, sf_dir), THRESHOLDS))


@query("structural_rates", _check_sql("count(error) / count(*)::DOUBLE", "0", "0.01", "structural", "", "count(*) > 0"))
def structural_rates(spark, sf_dir):
    return _rounded(checks.structural(stats(spark, sf_dir), THRESHOLDS))


@query("structural_top_errors", DUCK_PARSED + "SELECT topic, window_start, error, count(*) AS c FROM good WHERE error IS NOT NULL GROUP BY ALL")
def structural_top_errors(spark, sf_dir):
    return windows.top_errors(good(spark, sf_dir), SIZE_S)


@query("type_mix", DUCK_PARSED + "SELECT topic, window_start, count(*) FILTER (WHERE amount_type = 'string') AS strings, count(*) FILTER (WHERE amount_type = 'number') AS numbers FROM good GROUP BY ALL")
def type_mix(spark, sf_dir):
    return stats(spark, sf_dir).select("topic", "window_start", F.col("string_amount").alias("strings"), F.col("number_amount").alias("numbers"))


@query("type_drift_cold", _check_sql("1 - greatest(count(*) FILTER (WHERE amount_type = 'string'), count(*) FILTER (WHERE amount_type = 'number')) / count(amount_type)::DOUBLE", "0.01", "0.10", "type_drift", "amount", "count(amount_type) > 0"))
def type_drift_cold(spark, sf_dir):
    return _rounded(checks.type_drift_cold(stats(spark, sf_dir), THRESHOLDS, "amount"))


@query("schema_key_presence", DUCK_PARSED + ", k AS (SELECT topic, window_start, unnest(json_keys(o)) AS key FROM good) SELECT topic, window_start, key, count(*) AS c FROM k GROUP BY ALL")
def schema_key_presence(spark, sf_dir):
    return windows.key_counts(good(spark, sf_dir), SIZE_S).select("topic", "window_start", F.explode("keys").alias("key", "c"))


# ---- checks with a baseline ----

DUCK_VOLUME_FOLD = f"""{DUCK_PARSED.replace('WITH records', 'WITH RECURSIVE records')}{DUCK_SPINE}, seq AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY window_start) AS rn, n / {SIZE_S}.0::DOUBLE AS rate FROM vol),
f(topic, rn, window_start, rate, threshold, status, streak, hist, base) AS (
  SELECT topic, 0::BIGINT, NULL::TIMESTAMP, 0::DOUBLE, 0::DOUBLE, 'ok', 0, []::DOUBLE[], NULL::DOUBLE FROM span
  UNION ALL
  SELECT topic, rn, window_start, rate, CASE WHEN status <> 'ok' AND warm THEN base * (1 - (CASE status WHEN 'fail' THEN 60 ELSE 30 END) / 100.0::DOUBLE) ELSE 0 END, status, streak,
    CASE WHEN status = 'ok' OR streak > 4 THEN list_append(hist, rate)[-30:] ELSE hist END, base
  FROM (SELECT *, CASE WHEN status = 'ok' THEN 0 ELSE before + 1 END AS streak FROM (
    SELECT *, CASE WHEN rate = 0 OR fall > 60 THEN 'fail' WHEN fall > 30 THEN 'warn' ELSE 'ok' END AS status FROM (
      SELECT *, CASE WHEN warm THEN round(greatest(0, (1 - rate / base) * 100), 9) ELSE 0 END AS fall FROM (
        SELECT s.topic, s.rn, s.window_start, s.rate, f.streak AS before, f.hist, list_sum(f.hist) / len(f.hist) AS base, len(f.hist) >= 5 AND list_sum(f.hist) > 0 AS warm
        FROM f JOIN seq s ON s.topic = f.topic AND s.rn = f.rn + 1) a) b) c) d)
"""


def _history(spark, sf_dir, check: str, thresholds: Thresholds = THRESHOLDS) -> DataFrame:
    w = with_silence(spark, sf_dir) if check == "volume" else stats(spark, sf_dir)
    if check == "schema_drift":
        w = w.join(windows.key_counts(good(spark, sf_dir), SIZE_S), ["topic", "window_start"], "left")
    return baseline.judged(baseline.samples(w, FIELDS, DISTINCT, [check]), thresholds, SIZE_S)


def _judged(df: DataFrame) -> DataFrame:
    return df.select("topic", "field", "check_type", "window_start", F.round("value", 9).alias("value"), F.round("threshold", 9).alias("threshold"), "status")


@query("volume_baseline", DUCK_VOLUME_FOLD + "SELECT topic, '' AS field, 'volume' AS check_type, window_start, round(rate, 9) AS value, round(threshold, 9) AS threshold, status FROM f WHERE rn > 0")
def volume_baseline(spark, sf_dir):
    return _judged(_history(spark, sf_dir, "volume"))


@query("volume_rebaseline", DUCK_VOLUME_FOLD + "SELECT topic, status, count(*) AS windows, max(streak) AS longest FROM f WHERE rn > 0 GROUP BY ALL")
def volume_rebaseline(spark, sf_dir):
    from pyspark.sql import Window

    rows = _history(spark, sf_dir, "volume")
    w = Window.partitionBy("topic").orderBy("window_start")
    run = F.sum((F.col("status") == "ok").cast("int")).over(w)
    streaks = rows.withColumn("_run", run).withColumn("streak", F.sum((F.col("status") != "ok").cast("int")).over(Window.partitionBy("topic", "_run").orderBy("window_start")))
    return streaks.groupBy("topic", "status").agg(F.count(F.lit(1)).alias("windows"), F.max("streak").alias("longest"))


#: As the volume's fold, with a list of learned rates for each of the four windows of a day.
DUCK_SEASONAL = f"""{DUCK_PARSED.replace('WITH records', 'WITH RECURSIVE records')}{DUCK_SPINE}, seq AS (SELECT *, 1 + (extract(hour FROM window_start) // 6)::INT AS slot, row_number() OVER (PARTITION BY topic ORDER BY window_start) AS rn, n / {SIZE_S}.0::DOUBLE AS rate FROM vol),
f(topic, rn, window_start, rate, threshold, status, streak, hist, seasons) AS (
  SELECT topic, 0::BIGINT, NULL::TIMESTAMP, 0::DOUBLE, 0::DOUBLE, 'ok', 0, []::DOUBLE[], [[], [], [], []]::DOUBLE[][] FROM span
  UNION ALL
  SELECT topic, rn, window_start, rate, CASE WHEN status <> 'ok' AND warm THEN base * (1 - (CASE status WHEN 'fail' THEN 60 ELSE 30 END) / 100.0::DOUBLE) ELSE 0 END, status, streak,
    CASE WHEN status = 'ok' OR streak > 4 THEN list_append(hist, rate)[-30:] ELSE hist END,
    list_transform([1, 2, 3, 4], lambda i: CASE WHEN i = slot AND (status = 'ok' OR streak > 4) THEN list_append(seasons[i], rate)[-7:] ELSE seasons[i] END)
  FROM (SELECT *, CASE WHEN status = 'ok' THEN 0 ELSE before + 1 END AS streak FROM (
    SELECT *, CASE WHEN rate = 0 OR fall > 60 THEN 'fail' WHEN fall > 30 THEN 'warn' ELSE 'ok' END AS status FROM (
      SELECT *, CASE WHEN warm THEN round(greatest(0, (1 - rate / base) * 100), 9) ELSE 0 END AS fall FROM (
        SELECT *, (len(own) > 0 OR len(hist) >= 5) AND base > 0 AS warm FROM (
          SELECT *, CASE WHEN len(own) > 0 THEN list_sum(own) / len(own) ELSE list_sum(hist) / len(hist) END AS base FROM (
            SELECT s.topic, s.rn, s.window_start, s.rate, s.slot, f.streak AS before, f.hist, f.seasons, f.seasons[s.slot] AS own FROM f JOIN seq s ON s.topic = f.topic AND s.rn = f.rn + 1) a) b) c) d) e) g)
"""


@query("volume_seasonal", DUCK_SEASONAL + "SELECT topic, '' AS field, 'volume' AS check_type, window_start, round(rate, 9) AS value, round(threshold, 9) AS threshold, status FROM f WHERE rn > 0")
def volume_seasonal(spark, sf_dir):
    return _judged(_history(spark, sf_dir, "volume", SEASONAL))


#: Folds of a series in order, as for the volume; the history learns from ok windows and after four bad ones in a row.
DUCK_RECURSIVE = DUCK_PARSED.replace("WITH records", "WITH RECURSIVE records")
DUCK_CARDINALITY = DUCK_RECURSIVE + """, seq AS (SELECT topic, window_start, count(DISTINCT user_id)::DOUBLE AS est, row_number() OVER (PARTITION BY topic ORDER BY window_start) AS rn FROM good GROUP BY topic, window_start HAVING count(user_id) > 0),
f(topic, rn, window_start, est, base, status, streak, hist) AS (
  SELECT DISTINCT topic, 0::BIGINT, NULL::TIMESTAMP, 0::DOUBLE, NULL::DOUBLE, 'ok', 0, []::DOUBLE[] FROM seq
  UNION ALL
  SELECT topic, rn, window_start, est, base, status, streak, CASE WHEN status = 'ok' OR streak > 4 THEN list_append(hist, est)[-30:] ELSE hist END
  FROM (SELECT *, CASE WHEN status = 'ok' THEN 0 ELSE before + 1 END AS streak FROM (
    SELECT *, CASE WHEN factor > 5 THEN 'fail' WHEN factor > 2 THEN 'warn' ELSE 'ok' END AS status FROM (
      SELECT *, CASE WHEN len(hist) >= 5 AND base >= 10 THEN greatest(est / base, base / greatest(est, 1)) ELSE 1 END AS factor FROM (
        SELECT s.topic, s.rn, s.window_start, s.est, f.streak AS before, f.hist, list_sum(f.hist) / len(f.hist) AS base FROM f JOIN seq s ON s.topic = f.topic AND s.rn = f.rn + 1) a) b) c) d)
"""


@query("cardinality_drift", DUCK_CARDINALITY + "SELECT topic, 'user_id' AS field, 'cardinality' AS check_type, window_start, est AS value, CASE status WHEN 'fail' THEN 5.0 WHEN 'warn' THEN 2.0 ELSE 0.0 END::DOUBLE AS threshold, status FROM f WHERE rn > 0")
def cardinality_drift(spark, sf_dir):
    return _judged(_history(spark, sf_dir, "cardinality"))


@query("cardinality_series", DUCK_CARDINALITY + "SELECT window_start AS time, topic, 'user_id distinct' AS metric, est AS value FROM f WHERE rn > 0 UNION ALL SELECT window_start, topic, 'user_id baseline', round(base, 1) FROM f WHERE rn > 0 AND base IS NOT NULL")
def cardinality_series(spark, sf_dir):
    rows = results.result_rows(_history(spark, sf_dir, "cardinality"), SIZE_S, "batch")
    return analytics.series(rows, "cardinality", {"distinct": "value", "baseline": "baseline"})


DUCK_TYPES = DUCK_RECURSIVE + """, typed AS (SELECT topic, window_start, unnest(['id', 'user_id', 'amount']) AS field, unnest([CASE WHEN id IS NOT NULL THEN 'string' END, CASE WHEN user_id IS NOT NULL THEN 'number' END, amount_type]) AS tag FROM good),
seq AS (SELECT topic, field, window_start, count(*) FILTER (WHERE tag = 'string') AS s, count(*) FILTER (WHERE tag = 'number') AS m, row_number() OVER (PARTITION BY topic, field ORDER BY window_start) AS rn FROM typed GROUP BY topic, field, window_start HAVING count(tag) > 0),
f(topic, field, rn, window_start, off, status, streak, hist) AS (
  SELECT DISTINCT topic, field, 0::BIGINT, NULL::TIMESTAMP, 0::DOUBLE, 'ok', 0, []::INT[] FROM seq
  UNION ALL
  SELECT topic, field, rn, window_start, off, status, streak, CASE WHEN status = 'ok' OR streak > 4 THEN list_append(hist, own)[-30:] ELSE hist END
  FROM (SELECT *, CASE WHEN status = 'ok' THEN 0 ELSE before + 1 END AS streak FROM (
    SELECT *, CASE WHEN off > 0.10 THEN 'fail' WHEN off > 0.01 THEN 'warn' ELSE 'ok' END AS status FROM (
      SELECT *, 1 - (CASE usual WHEN 0 THEN s ELSE m END) / (s + m)::DOUBLE AS off FROM (
        SELECT *, CASE WHEN len(hist) < 5 THEN own WHEN 2 * list_sum(hist) > len(hist) THEN 1 ELSE 0 END AS usual FROM (
          SELECT q.topic, q.field, q.rn, q.window_start, q.s, q.m, CASE WHEN q.s >= q.m THEN 0 ELSE 1 END AS own, f.streak AS before, f.hist FROM f JOIN seq q ON q.topic = f.topic AND q.field = f.field AND q.rn = f.rn + 1) a) b) c) d) e)
"""


@query("type_drift", DUCK_TYPES + "SELECT topic, field, 'type_drift' AS check_type, window_start, round(off, 9) AS value, CASE status WHEN 'fail' THEN 0.10 ELSE 0.01 END::DOUBLE AS threshold, status FROM f WHERE rn > 0")
def type_drift(spark, sf_dir):
    return _judged(_history(spark, sf_dir, "type_drift"))


#: The names of all keys that the records have; the lists learn each one's share of the records.
DUCK_KEYS = ["id", "user_id", "amount", "event_time", "note", "channel"]
DUCK_SCHEMAS = DUCK_RECURSIVE + f""", seq AS (SELECT topic, window_start, [{', '.join(f"count(*) FILTER (WHERE json_exists(o, '$.{k}')) / count(*)::DOUBLE" for k in DUCK_KEYS)}] AS r, row_number() OVER (PARTITION BY topic ORDER BY window_start) AS rn FROM good GROUP BY topic, window_start),
f(topic, rn, window_start, value, status, streak, seen, known) AS (
  SELECT DISTINCT topic, 0::BIGINT, NULL::TIMESTAMP, 0::DOUBLE, 'ok', 0, 0, [[], [], [], [], [], []]::DOUBLE[][] FROM seq
  UNION ALL
  SELECT topic, rn, window_start, value, status, streak, CASE WHEN status = 'ok' OR streak > 4 THEN least(seen + 1, 30) ELSE seen END,
    CASE WHEN status = 'ok' OR streak > 4 THEN list_transform([1, 2, 3, 4, 5, 6], lambda i: CASE WHEN r[i] > 0 OR len(known[i]) > 0 THEN list_append(known[i], r[i])[-30:] ELSE known[i] END) ELSE known END
  FROM (SELECT *, CASE WHEN status = 'ok' THEN 0 ELSE before + 1 END AS streak FROM (
    SELECT *, CASE WHEN value > 3 THEN 'fail' WHEN value > 0 THEN 'warn' ELSE 'ok' END AS status FROM (
      SELECT s.topic, s.rn, s.window_start, s.r, f.streak AS before, f.seen, f.known, CASE WHEN f.seen < 5 THEN 0 ELSE len(list_filter([1, 2, 3, 4, 5, 6], lambda i: CASE WHEN len(f.known[i]) = 0 THEN s.r[i] >= 0.05 ELSE list_sum(f.known[i]) / len(f.known[i]) >= 0.5 AND s.r[i] < 0.01 END)) END::DOUBLE AS value
      FROM f JOIN seq s ON s.topic = f.topic AND s.rn = f.rn + 1) a) b) c)
"""


@query("schema_drift", DUCK_SCHEMAS + "SELECT topic, '' AS field, 'schema_drift' AS check_type, window_start, value, CASE status WHEN 'fail' THEN 3 ELSE 0 END::DOUBLE AS threshold, status FROM f WHERE rn > 0")
def schema_drift(spark, sf_dir):
    return _judged(_history(spark, sf_dir, "schema_drift"))


def all_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check's rows of every window, as rows of the results table. Records are read twice, for the statistics
    and for the tallies of keys and errors; the small table of windows is kept for the session, as the spine, the
    checks with and those without a history all start from it."""
    w = stats(spark, sf_dir).join(windows.tallies(good(spark, sf_dir), SIZE_S), ["topic", "window_start"], "left").persist()
    w = windows.with_silence(w, record_sources.window_spine(w.select("topic", "window_start"), SIZE_S))
    out = baseline.judged(baseline.samples(w, FIELDS, DISTINCT), THRESHOLDS, SIZE_S).unionByName(checks.plain_rows(w, THRESHOLDS, FIELDS))
    return results.result_rows(out, SIZE_S, "batch")


def _check_parts() -> str:
    """All rows of all checks in SQL: the statement of each check as a subquery."""
    rows = "topic, check_type, field, window_start, value, threshold, status"
    plain = [SQL[n] for n in ("null_rate_windows", "freshness_check", "structural_rates")] + [SQL["null_rate_precedence"], SQL["null_rate_windows"].replace("count(amount)", "count(id)").replace("'amount' AS field", "'id' AS field")]
    parts = [f"SELECT {rows}, NULL::DOUBLE AS baseline FROM ({x})" for x in (*plain, SQL["type_drift"], SQL["schema_drift"])]
    parts.append(f"SELECT {rows}, baseline FROM ({DUCK_VOLUME_FOLD} SELECT topic, '' AS field, 'volume' AS check_type, window_start, rate AS value, threshold, status, round(base, 4) AS baseline FROM f WHERE rn > 0)")
    parts.append(f"SELECT {rows}, baseline FROM ({DUCK_CARDINALITY} SELECT topic, 'user_id' AS field, 'cardinality' AS check_type, window_start, est AS value, CASE status WHEN 'fail' THEN 5.0 WHEN 'warn' THEN 2.0 ELSE 0.0 END::DOUBLE AS threshold, status, round(base, 1) AS baseline FROM f WHERE rn > 0)")
    return " UNION ALL ".join(parts)


@query("check_results_all", f"SELECT topic, check_type, field, window_start, window_start + INTERVAL '6 hours' AS window_end, round(value, 6) AS value, round(threshold, 6) AS threshold, status, baseline FROM ({_check_parts()}) x")
def check_results_all(spark, sf_dir):
    return all_checks(spark, sf_dir).select("topic", "check_type", "field", "window_start", "window_end", F.round("value", 6).alias("value"), F.round("threshold", 6).alias("threshold"), "status", F.round("baseline", 4).alias("baseline"))


@query("freshness_series", DUCK_PARSED + "SELECT window_start AS time, topic, unnest(['p50', 'p95', 'p99']) AS metric, unnest([round(quantile_disc(late, 0.5)), quantile_disc(late, 0.95), round(quantile_disc(late, 0.99))])::DOUBLE AS value FROM good GROUP BY topic, window_start HAVING count(late) > 0")
def freshness_series(spark, sf_dir):
    rows = results.result_rows(checks.freshness(stats(spark, sf_dir), THRESHOLDS), SIZE_S, "batch")
    return analytics.series(rows, "freshness", {"p50": "p50_ms", "p95": "value", "p99": "p99_ms"})


@query("violation_details", DUCK_PARSED + """, w AS (SELECT topic, window_start, count(*) AS n, count(*) - count(amount) AS nulls, count(error) AS invalid FROM good GROUP BY topic, window_start)
SELECT topic, window_start, 'null_rate' AS check_type, '{"nulls":' || nulls || ',"total":' || n || ',"required":false}' AS details FROM w WHERE nulls / n::DOUBLE > CASE WHEN topic = 'ev.view' THEN 0.10 ELSE 0.05 END
UNION ALL SELECT topic, window_start, 'structural', '{"checked":' || n || ',"invalid":' || invalid || ',"skipped":0}' FROM w WHERE invalid > 0""")
def violation_details(spark, sf_dir):
    rows = results.result_rows(checks.null_rate(stats(spark, sf_dir), THRESHOLDS, "amount").unionByName(checks.structural(stats(spark, sf_dir), THRESHOLDS)), SIZE_S, "batch")
    return rows.where("details IS NOT NULL").select("topic", "window_start", "check_type", "details")


# ---- framed payloads ----

SENSOR = '{"type":"record","name":"Reading","fields":[{"name":"id","type":["null","string"]},{"name":"amount","type":"long"}]}'
PING = 'syntax = "proto3"; message Ping { string id = 1; uint32 amount = 2; }'
WRITERS = {7: SCHEMA}
SCHEMAS = [(7, "JSON", '{"type":"object"}', None), (8, "AVRO", SENSOR, None), (9, "PROTOBUF", PING, None)]
#: Bytes as hex: plain JSON, JSON with its writer's id, Avro (every tenth without an id), Protobuf, an id that no one
#: knows (half of them with JSON behind it), a torn Avro body, a tombstone.
FRAMES = """SELECT 'fr.' || event_type AS topic, event_id, CAST(event_id % 3 AS INT) AS source_partition, event_id AS source_offset, CAST(ts AS TIMESTAMP) AS ingest_ts, CASE event_id % 7
  WHEN 0 THEN CAST('{{"id":"p","amount":' || (event_id % 60) || '}}' AS BINARY)
  WHEN 1 THEN concat(unhex('0000000007'), CAST(CASE WHEN event_id % 2 = 0 THEN '{{"id":"j","amount":' || (event_id % 60) || '}}' ELSE '{{"id":"j","amount":-1}}' END AS BINARY))
  WHEN 2 THEN unhex('0000000008' || CASE WHEN event_id % 10 = 0 THEN '00' ELSE '020261' END || lpad(hex(2 * (event_id % 60)), 2, '0'))
  WHEN 3 THEN unhex('0000000009' || '00' || '0A0162' || '10' || lpad(hex(event_id % 60), 2, '0'))
  WHEN 4 THEN concat(unhex('0000000063'), CASE WHEN event_id % 2 = 0 THEN CAST('{{"id":"u","amount":1}}' AS BINARY) ELSE unhex('0204') END)
  WHEN 5 THEN unhex('000000000802') END AS value FROM {events}"""
#: What those records are, worked out from their numbers.
DUCK_FRAMES = """WITH r AS (SELECT 'fr.' || event_type AS topic, event_id, ts, event_id % 7 AS k, event_id % 60 AS a, event_id % 2 = 0 AS even, event_id % 10 = 0 AS tenth FROM events) """


def framed(spark: SparkSession, sf_dir: str, registry_up: bool) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type")
    frames = decode.decode(spark.sql(FRAMES, events=events), schema_table(spark, SCHEMAS), registry_up=registry_up)
    return parse.parse(frames, THRESHOLDS, ["id", "amount"], ["id"], SCHEMA, writers=WRITERS)


@query("parse_framed", DUCK_FRAMES + """SELECT topic, event_id AS source_offset, CASE k WHEN 0 THEN 'p' WHEN 1 THEN 'j' WHEN 2 THEN CASE WHEN NOT tenth THEN 'a' END WHEN 3 THEN 'b' END AS id, CASE WHEN k = 1 AND NOT even THEN '-1' ELSE a::VARCHAR END AS amount, CASE k WHEN 3 THEN 0 WHEN 1 THEN CASE WHEN even THEN 1 ELSE 2 END ELSE 1 END::BIGINT AS structural FROM r WHERE k < 4""")
def parse_framed(spark, sf_dir):
    item = lambda f: F.col("fields").getItem(f).alias(f)
    return parse.analysed(framed(spark, sf_dir, True)).select("topic", "source_offset", item("id"), item("amount"), "structural")


@query("dead_letter_framed", DUCK_FRAMES + """SELECT CASE k WHEN 4 THEN 'unknown_schema_id' WHEN 5 THEN 'avro_decode_failed' ELSE 'null_payload' END AS reason, topic, event_id AS source_offset FROM r WHERE k > 3
UNION ALL SELECT 'required_field_missing', topic, event_id FROM r WHERE k = 2 AND tenth UNION ALL SELECT 'schema_violation', topic, event_id FROM r WHERE k = 1 AND NOT even""")
def dead_letter_framed(spark, sf_dir):
    return parse.dead_letters(framed(spark, sf_dir, True)).select("reason", "topic", "source_offset")


@query("volume_undecoded", DUCK_FRAMES + """SELECT topic, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n, count(*) FILTER (WHERE NOT (k = 4 AND NOT even)) AS decoded, count(*) FILTER (WHERE k IN (0, 1, 3) OR (k = 2 AND NOT tenth) OR (k = 4 AND even)) AS present_id FROM r WHERE k < 5 GROUP BY ALL""")
def volume_undecoded(spark, sf_dir):
    """While the registry is away: what can't be read counts for the volume only."""
    return windows.topic_windows(parse.analysed(framed(spark, sf_dir, False)), ["id"], SIZE_S).select("topic", "window_start", "n", "decoded", "present_id")


# ---- the results table ----


@query("upsert_last_wins", DUCK_SEED + ", log AS (SELECT *, 1 AS batch FROM results UNION ALL SELECT topic, check_type, field, window_start, window_end, value + 1, threshold, 'warn', seq, 2 FROM results WHERE seq % 3 = 0) SELECT topic, check_type, field, window_start, round(value, 6) AS value, status FROM log QUALIFY row_number() OVER (PARTITION BY topic, check_type, field, window_start, window_end ORDER BY batch DESC) = 1")
def upsert_last_wins(spark, sf_dir):
    r = seed(spark, sf_dir)
    log = r.withColumn("batch", F.lit(1)).unionByName(r.where("seq % 3 = 0").withColumns({"value": F.col("value") + 1, "status": F.lit("warn"), "batch": F.lit(2)}))
    return results.upsert(log, "batch").select("topic", "check_type", "field", "window_start", F.round("value", 6).alias("value"), "status")


@query("latest_status", DUCK_SEED + "SELECT topic, check_type, field, window_end, status, round(value, 6) AS value, threshold FROM results QUALIFY row_number() OVER (PARTITION BY topic, check_type, field ORDER BY window_end DESC) = 1")
def latest_status(spark, sf_dir):
    return results.latest_status(seed(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query("violations", DUCK_SEED + "SELECT topic, check_type, field, window_start, status FROM results WHERE status <> 'ok'")
def violations(spark, sf_dir):
    return results.violations(seed(spark, sf_dir)).select("topic", "check_type", "field", "window_start", "status")


DUCK_LATEST = DUCK_SEED + ", latest AS (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY topic, check_type, field ORDER BY window_end DESC) = 1) "


@query("topic_health", DUCK_LATEST + f"SELECT topic, check_type, CASE max({DUCK_STATUS}) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'ok' END AS worst_status, max(window_end) AS last_window, max(window_end) < {DUCK_NOW} - INTERVAL '5 minutes' AS is_stale FROM latest GROUP BY ALL")
def topic_health(spark, sf_dir):
    return results.topic_health(results.latest_status(seed(spark, sf_dir)), F.expr(NOW))


@query("purge_retention", DUCK_SEED + f"SELECT topic, check_type, field, count(*) AS kept FROM results WHERE window_start >= {DUCK_NOW} - INTERVAL '10 days' GROUP BY ALL")
def purge_retention(spark, sf_dir):
    return results.purge(seed(spark, sf_dir), "window_start", F.expr(NOW), 10).groupBy("topic", "check_type", "field").agg(F.count(F.lit(1)).alias("kept"))


@query("status_gauge", DUCK_SEED + f", l AS (SELECT topic, max(window_end) AS last FROM results GROUP BY topic) SELECT topic, check_type, field, coalesce(max({DUCK_STATUS}) FILTER (WHERE window_end = last), 0)::BIGINT AS gauge FROM results JOIN l USING (topic) GROUP BY ALL")
def status_gauge(spark, sf_dir):
    return results.status_gauge(seed(spark, sf_dir))


# ---- analytics ----

DUCK_INCIDENTS = DUCK_SEED + """, ordered AS (SELECT *, lag(window_end) OVER s AS before FROM results WINDOW s AS (PARTITION BY topic, check_type, field ORDER BY window_start)),
marked AS (SELECT *, sum(CASE WHEN status = 'ok' OR before IS NULL OR epoch(window_start - before) > 3 * epoch(window_end - window_start) THEN 1 ELSE 0 END) OVER (PARTITION BY topic, check_type, field ORDER BY window_start) AS run FROM ordered),
incidents AS (SELECT topic, check_type, field, min(window_start) AS started, max(window_end) AS ended, count(*) AS windows, count(*) FILTER (WHERE status = 'fail') AS fail_windows,
  CASE WHEN bool_or(status = 'fail') THEN 'fail' ELSE 'warn' END AS worst_status, CAST(epoch(max(window_end) - min(window_start)) AS BIGINT) AS duration_s FROM marked WHERE status <> 'ok' GROUP BY topic, check_type, field, run) """
SCORE = "CASE status WHEN 'ok' THEN 1.0::DOUBLE WHEN 'warn' THEN 0.5 ELSE 0 END"


def _add(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql)(lambda spark, sf_dir: f(seed(spark, sf_dir)))


_add("incidents", DUCK_INCIDENTS + "SELECT * FROM incidents", analytics.incidents)
_add("incident_stats", DUCK_INCIDENTS + "SELECT count(*) AS incidents, max(duration_s) AS longest_s, CAST(round(avg(duration_s)) AS BIGINT) AS average_s FROM incidents", lambda r: analytics.incident_stats(analytics.incidents(r)))
_add("incidents_per_hour", DUCK_INCIDENTS + "SELECT date_trunc('hour', started) AS time, check_type, count(*) AS incidents FROM incidents GROUP BY ALL", lambda r: analytics.incidents_per_hour(analytics.incidents(r)))
_add("incident_log", DUCK_INCIDENTS + "SELECT * FROM incidents ORDER BY started DESC, topic, check_type, field LIMIT 200", lambda r: analytics.incident_log(analytics.incidents(r)))
_add("quality_score", DUCK_SEED + f"SELECT round(100 * avg({SCORE}), 2) AS score FROM results", analytics.quality_score)
_add("availability", DUCK_SEED + "SELECT round(100 * (count(*) FILTER (WHERE status = 'ok') / count(*)::DOUBLE), 2) AS pct_ok FROM results", analytics.availability)
_add("availability_by_check", DUCK_SEED + "SELECT topic, check_type, round(100 * (count(*) FILTER (WHERE status = 'ok') / count(*)::DOUBLE), 2) AS pct_ok, count(*) FILTER (WHERE status = 'warn') AS warns, count(*) FILTER (WHERE status = 'fail') AS fails, count(*) AS windows FROM results GROUP BY ALL", analytics.availability_by_check)
_add("score_over_time", DUCK_SEED + f"SELECT time_bucket(INTERVAL '1 day', window_start, TIMESTAMP '1970-01-01') AS time, topic AS metric, round(100 * avg({SCORE}), 2) AS score FROM results GROUP BY ALL", lambda r: analytics.score_over_time(r, "1 day"))
_add("open_now", DUCK_LATEST + f"SELECT count(*) AS open_now FROM latest WHERE status <> 'ok' AND window_end >= {DUCK_NOW} - INTERVAL '300 seconds'", lambda r: analytics.open_now(results.latest_status(r), F.expr(NOW)))
_add("flappiest_checks", DUCK_SEED + ", l AS (SELECT *, (status = 'ok') <> (lag(status) OVER (PARTITION BY topic, check_type, field ORDER BY window_start) = 'ok') AS flip FROM results) SELECT topic, check_type, field, count(*) FILTER (WHERE flip) AS flips, count(*) AS windows FROM l GROUP BY ALL HAVING count(*) FILTER (WHERE flip) >= 2 ORDER BY flips DESC, topic, check_type, field LIMIT 15", analytics.flappiest)
_add("worst_null_fields", DUCK_SEED + "SELECT topic, field, round(100 * avg(value), 2) AS avg_null_pct, round(100 * max(value), 2) AS max_null_pct, count(*) FILTER (WHERE status <> 'ok') AS bad_windows FROM results WHERE check_type = 'null_rate' GROUP BY ALL HAVING max(value) > 0 ORDER BY avg_null_pct DESC, topic, field LIMIT 15", analytics.worst_null_fields)
_add("correlated_failures", DUCK_SEED + "SELECT topic, window_start, count(DISTINCT check_type) AS n_checks, string_agg(DISTINCT check_type, ', ' ORDER BY check_type) AS failing_checks FROM results WHERE status = 'fail' GROUP BY ALL HAVING count(DISTINCT check_type) >= 2 ORDER BY window_start DESC, topic LIMIT 100", analytics.correlated_failures)
_add("top_offenders", DUCK_SEED + "SELECT topic, check_type, field, count(*) AS violations, count(*) FILTER (WHERE status = 'fail') AS fails, max(window_end) AS last_seen FROM results WHERE status <> 'ok' GROUP BY ALL ORDER BY violations DESC, topic, check_type, field LIMIT 20", analytics.top_offenders)
_add("violation_log", DUCK_SEED + "SELECT window_start AS time, topic, check_type, field, status, round(value, 4) AS value, round(threshold, 4) AS threshold FROM results WHERE status <> 'ok' ORDER BY window_start DESC, topic, check_type, field LIMIT 1000", analytics.violation_log)
_add("violations_per_minute", DUCK_SEED + "SELECT time_bucket(INTERVAL '1 minute', window_start, TIMESTAMP '1970-01-01') AS time, check_type AS metric, count(*) AS violations FROM results WHERE status <> 'ok' GROUP BY ALL", analytics.violations_per_minute)
_add("violations_by_status", DUCK_SEED + "SELECT time_bucket(INTERVAL '1 day', window_start, TIMESTAMP '1970-01-01') AS time, status AS metric, count(*) AS violations FROM results WHERE status <> 'ok' GROUP BY ALL", lambda r: analytics.violations_by_status(r, "1 day"))
_add("topics_failing", DUCK_LATEST + "SELECT count(DISTINCT topic) AS topics FROM latest WHERE status = 'fail'", lambda r: analytics.topics_with(results.latest_status(r), "fail"))
_add("topics_warning", DUCK_LATEST + "SELECT count(DISTINCT topic) AS topics FROM latest WHERE status = 'warn'", lambda r: analytics.topics_with(results.latest_status(r), "warn"))
_add("rag_matrix", DUCK_LATEST + "SELECT topic, " + ", ".join(f"max({DUCK_STATUS}) FILTER (WHERE check_type = '{c}')::BIGINT AS {c}" for c in ("volume", "null_rate", "freshness")) + " FROM latest GROUP BY topic", lambda r: analytics.rag_matrix(results.latest_status(r), ["volume", "null_rate", "freshness"]))
_add("status_timeline", DUCK_SEED + f"SELECT window_start AS time, topic, CASE WHEN field = '' THEN check_type ELSE check_type || '.' || field END AS metric, ({DUCK_STATUS})::BIGINT AS state FROM results", analytics.status_timeline)
_add("null_rate_series", DUCK_SEED + "SELECT window_start AS time, topic, field || ' null_rate' AS metric, value FROM results WHERE check_type = 'null_rate'", lambda r: analytics.series(r, "null_rate", {"null_rate": "value"}))
_add("volume_series", DUCK_SEED + "SELECT window_start AS time, topic, unnest(['volume', 'baseline']) AS metric, unnest([value, threshold]) AS value FROM results WHERE check_type = 'volume'", lambda r: analytics.series(r, "volume", {"volume": "value", "baseline": "threshold"}))
_add("threshold_series", DUCK_SEED + "SELECT window_start AS time, topic, field, round(threshold, 6) AS threshold FROM results WHERE check_type = 'null_rate' AND status <> 'ok'", lambda r: analytics.crossed_thresholds(r, "null_rate"))
_add("week_over_week", DUCK_SEED + """, v AS (SELECT * FROM results WHERE check_type = 'volume')
SELECT date_trunc('hour', window_start) AS time, topic AS metric, round(avg(value), 6) AS msgs_per_s FROM v WHERE window_start BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-21 23:59:59' GROUP BY ALL
UNION ALL SELECT date_trunc('hour', window_start) + INTERVAL '7 days' AS time, topic || ' (7d ago)' AS metric, round(avg(value), 6) AS msgs_per_s FROM v WHERE window_start BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-14 23:59:59' GROUP BY ALL""", lambda r: analytics.week_over_week(r.withColumn("window_start", F.col("window_start").cast("timestamp")), "2024-01-15 00:00:00", "2024-01-21 23:59:59"))
for _column in ("topic", "field", "check_type", "status"):
    _add(f"choices_{_column}", DUCK_SEED + f"SELECT DISTINCT {_column} AS choice FROM results WHERE {_column} <> ''", lambda r, c=_column: analytics.choices(r, c))

# ---- alerts ----

DUCK_ALERTS = DUCK_SEED + """, l AS (SELECT *, status IS DISTINCT FROM lag(status) OVER (PARTITION BY topic, check_type, field ORDER BY window_start) AS cut FROM results),
g AS (SELECT *, sum(cut::INT) OVER (PARTITION BY topic, check_type, field ORDER BY window_start) AS run FROM l),
runs AS (SELECT topic, check_type, field, run, any_value(status) AS status, min(window_start) AS since, max(window_end) AS until FROM g GROUP BY topic, check_type, field, run),
firing AS (SELECT CASE status WHEN 'fail' THEN 'DataQualityFail' ELSE 'DataQualityWarn' END AS alertname, CASE status WHEN 'fail' THEN 'critical' ELSE 'warning' END AS severity, topic, check_type, field, since AS starts_at
  FROM (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY topic, check_type, field ORDER BY run DESC) = 1) x WHERE status = 'fail' OR (status = 'warn' AND epoch(until - since) >= 120)) """
_add("alert_rules_firing", DUCK_ALERTS + "SELECT * FROM firing", alerts.status_alerts)
_add("alert_inhibition", DUCK_SEED + ", a AS (SELECT DISTINCT topic, check_type, field, CASE status WHEN 'fail' THEN 'critical' ELSE 'warning' END AS severity FROM results WHERE status <> 'ok') SELECT * FROM a WHERE severity = 'critical' OR NOT EXISTS (SELECT 1 FROM a b WHERE b.severity = 'critical' AND (b.topic, b.check_type, b.field) = (a.topic, a.check_type, a.field))", lambda r: alerts.inhibited(r.where("status <> 'ok'").select("topic", "check_type", "field", F.when(F.col("status") == "fail", "critical").otherwise("warning").alias("severity")).distinct()))


def _events(r: DataFrame) -> DataFrame:
    """Alert events of incidents: each fires when it starts (twice, as senders repeat) and resolves unless still open."""
    i = analytics.incidents(r)
    severity = F.when(F.col("worst_status") == "fail", "critical").otherwise("warning")
    row = lambda status, ends, seq: i.select(F.lit(status).alias("status"), F.concat_ws("|", "topic", "check_type", "field").alias("fingerprint"), severity.alias("severity"), "topic", F.col("started").alias("starts_at"), ends.alias("ends_at"), F.lit(seq).alias("seq"))
    resolved = row("resolved", F.col("ended"), 3).where(F.col("ends_at") < F.expr(NOW))
    never = F.lit(None).cast("timestamp_ntz")
    return row("firing", never, 1).unionByName(row("firing", never, 2)).unionByName(resolved)


DUCK_EVENTS = DUCK_INCIDENTS + f", once AS (SELECT topic || '|' || check_type || '|' || field AS fingerprint, CASE worst_status WHEN 'fail' THEN 'critical' ELSE 'warning' END AS severity, topic, started AS starts_at, CASE WHEN ended < {DUCK_NOW} THEN ended END AS ends_at FROM incidents) "
_add("alert_dedupe", DUCK_EVENTS + "SELECT fingerprint, 'firing' AS status, starts_at, 1::BIGINT AS seq FROM once UNION ALL SELECT fingerprint, 'resolved', starts_at, 3 FROM once WHERE ends_at IS NOT NULL", lambda r: alerts.first_of_each(_events(r), "seq").select("fingerprint", "status", "starts_at", "seq"))
_add("alert_history", DUCK_EVENTS + f"SELECT fingerprint, severity, topic, starts_at, ends_at AS resolved_at, epoch(coalesce(ends_at, {DUCK_NOW}) - starts_at)::DOUBLE AS duration_s, CASE WHEN ends_at IS NULL THEN 'FIRING' ELSE 'resolved' END AS state FROM once", lambda r: alerts.history(alerts.first_of_each(_events(r), "seq"), F.expr(NOW)).select("fingerprint", "severity", "topic", "starts_at", "resolved_at", "duration_s", "state"))
_add("alerts_per_hour", DUCK_EVENTS + "SELECT date_trunc('hour', starts_at) AS time, severity AS metric, count(*) AS alerts FROM once GROUP BY ALL", lambda r: alerts.alerts_per_hour(alerts.first_of_each(_events(r), "seq")))

_add("alert_notifications", DUCK_EVENTS + f""", f AS (SELECT severity AS alertname, topic, epoch(starts_at)::BIGINT AS s FROM once), g AS (SELECT *, min(s) OVER (PARTITION BY alertname, topic) + 10 AS first FROM f),
n AS (SELECT alertname, topic, first + greatest(ceil((s - first) / 60.0), 0)::BIGINT * 60 AS sent, count(*) AS alerts FROM g GROUP BY ALL),
e AS (SELECT *, coalesce(lead(sent) OVER (PARTITION BY alertname, topic ORDER BY sent) - 1, epoch({DUCK_NOW})::BIGINT) AS until FROM n),
r AS (SELECT *, unnest(range(sent, greatest(until, sent) + 1, 14400)) AS t FROM e) SELECT alertname, topic, make_timestamp(t * 1000000) AS sent_at, CASE WHEN t = sent THEN alerts ELSE 0 END AS alerts FROM r""", lambda r: alerts.notifications(alerts.first_of_each(_events(r), "seq").where("status = 'firing'").select(F.col("severity").alias("alertname"), "topic", "starts_at"), F.expr(NOW)))

# ---- sources and the monitor itself ----


@query("monitor_firing", """WITH x AS (SELECT ts, event_id, CASE WHEN event_id % 13 > 9 THEN NULL ELSE epoch(date_trunc('second', ts)) - (event_id % 17) * 40 END AS seen, event_id % 29 * 1000 AS lag, event_id % 11 * 10000 AS delay FROM events),
r AS (SELECT ts, event_id, unnest(['QualityMonitorStalled', 'QualityMonitorMissing', 'QualityMonitorLagging', 'QualityMonitorBehind']) AS alertname, unnest([coalesce(epoch(date_trunc('second', ts)) - seen > 300, false), seen IS NULL, lag > 10000, delay > 60000]) AS holds, unnest([60, 300, 120, 120]) AS hold FROM x),
t AS (SELECT *, epoch(date_trunc('second', ts)) AS s, sum((NOT holds)::INT) OVER (PARTITION BY alertname ORDER BY ts) AS run, lead(ts) OVER (PARTITION BY alertname ORDER BY ts) AS nxt FROM r),
h AS (SELECT *, min(s) OVER (PARTITION BY alertname, run) AS since FROM t WHERE holds)
SELECT alertname, min(ts) AS pending_since, min(ts) FILTER (WHERE s - since >= hold) AS starts_at, arg_max(coalesce(nxt, TIMESTAMP '1970-01-01'), ts) AS ends_at, 'critical' AS severity FROM h GROUP BY alertname, run HAVING bool_or(s - since >= hold)""")
def monitor_firing(spark, sf_dir):
    samples = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("ts", "CASE WHEN event_id % 13 > 9 THEN NULL ELSE timestamp_seconds(unix_timestamp(CAST(ts AS TIMESTAMP)) - (event_id % 17) * 40) END AS last_window_end", "event_id % 29 * 1000 AS lag_rows", "event_id % 11 * 10000 AS delay_ms")
    return alerts.monitor_firing(samples).withColumn("ends_at", F.coalesce("ends_at", F.expr("TIMESTAMP_NTZ'1970-01-01'")))


@query("registry_status_latest", "SELECT CASE event_id % 5 WHEN 0 THEN 'down' ELSE 'up' END AS state FROM events ORDER BY ts DESC, event_type LIMIT 1")
def registry_status_latest(spark, sf_dir):
    beats = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("job_id"), "ts", F.lit("1").alias("version"), F.lit("up").alias("kafka_status"), F.when(F.col("event_id") % 5 == 0, "down").otherwise("up").alias("registry_status"), F.col("event_id").alias("seq"))
    return analytics.newest_heartbeat(record_sources.heartbeats(beats), "registry_status")


@query("timestamps_parsed", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1700000000 + event_id WHEN 1 THEN 1700000000000 + event_id WHEN 2 THEN 1700000000 + event_id WHEN 3 THEN 1700000 + event_id END * CASE WHEN event_id % 6 IN (0, 2, 3) THEN 1000 ELSE 1 END AS event_ms,
CASE WHEN event_id % 6 = 4 THEN 'bad_timestamp' END AS reason FROM events WHERE event_id % 6 <> 5""")
def timestamps_parsed(spark, sf_dir):
    """Event times in seconds, milliseconds, ISO texts, texts of digits, and none that can be read, at a nested path."""
    body = "concat('{\"meta\":{\"at\":', CASE event_id % 6 WHEN 0 THEN string(1700000000 + event_id) WHEN 1 THEN string(1700000000000 + event_id) WHEN 2 THEN concat('\"', date_format(timestamp_seconds(1700000000 + event_id), \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), '\"') WHEN 3 THEN concat('\"', 1700000 + event_id, '\"') ELSE '\"soon\"' END, '}}')"
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 6 <> 5").selectExpr("'t' AS topic", "event_id", "ts AS ingest_ts", f"{body} AS value")
    return parse.parse(rows, Thresholds({"event_time_field": "meta.at"}), []).select("event_id", "event_ms", F.col("reject.reason").alias("reason"))


@query("topic_select", "SELECT DISTINCT 'ev.' || event_type AS topic FROM events WHERE regexp_full_match('ev.' || event_type, 'ev[.].*') AND NOT regexp_full_match('ev.' || event_type, 'ev[.]s.*') AND event_type <> 'error' ORDER BY topic LIMIT 3")
def topic_select(spark, sf_dir):
    return topics.discover_topics(event_records(spark, sf_dir), "ev[.].*", "ev[.]s.*", "ev.error", limit=3)


@query("heartbeat_latest", "SELECT CASE event_id % 3 WHEN 0 THEN 'down' ELSE 'up' END AS state FROM events ORDER BY ts DESC, event_type LIMIT 1")
def heartbeat_latest(spark, sf_dir):
    beats = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("job_id"), "ts", F.lit("1").alias("version"), F.when(F.col("event_id") % 3 == 0, "down").otherwise("up").alias("kafka_status"), F.lit("up").alias("registry_status"), F.col("event_id").alias("seq"))
    return analytics.newest_heartbeat(record_sources.heartbeats(beats), "kafka_status")


@query("heartbeat_age", f"SELECT CAST(epoch({DUCK_NOW}) - floor(epoch(max(ts))) AS BIGINT) AS age_s FROM events")
def heartbeat_age(spark, sf_dir):
    beats = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts")
    return analytics.heartbeat_age(beats, F.expr(NOW))


@query("consumer_delay", "SELECT 'ev.' || event_type AS topic, CAST(greatest(max((event_id % 90) * 1000 - 5000), 0) AS BIGINT) AS delay_ms FROM events GROUP BY event_type")
def delay(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("'ev.' || event_type AS topic", "CAST(ts AS TIMESTAMP) AS timestamp", "timestamp_millis(unix_millis(CAST(ts AS TIMESTAMP)) + (event_id % 90) * 1000 - 5000) AS ingest_ts")
    return consumer_delay(rows)


# ---- checks over plain tables ----


def _table(name: str, table: str, ts: str | None, keys: str, column: str, null_when: str, size: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"{keys} AS topic", f"{ts or FIXED_TS} AS ts", f"CASE WHEN {null_when} THEN NULL ELSE {column} END AS v")
        w = df.groupBy("topic", F.window("ts", size)["start"].alias("window_start")).agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("present_v"), F.countDistinct("v").alias("distinct_v"))
        r = checks.null_rate(w.withColumn("decoded", F.col("n")), Thresholds(), "v").select("topic", "window_start", F.round("value", 6).alias("null_rate"), "status")
        return w.select("topic", "window_start", "n", "distinct_v").join(r, ["topic", "window_start"])

    query(name, f"WITH d AS ({sql}), v AS (SELECT topic, window_start, count(*) AS n, count(DISTINCT v) AS distinct_v, (count(*) - count(v)) / count(*)::DOUBLE AS r FROM d GROUP BY ALL) SELECT topic, window_start, n, distinct_v, round(r, 6) AS null_rate, CASE WHEN r > 0.2 THEN 'fail' WHEN r > 0.05 THEN 'warn' ELSE 'ok' END AS status FROM v")(run)


BUCKET = "time_bucket(INTERVAL '30 days', {}, TIMESTAMP '1970-01-01')"
_table("dq_orders", "orders", "o_orderdate", "o_orderpriority", "o_custkey", "o_custkey % 11 = 0", "30 days", f"SELECT o_orderpriority AS topic, {BUCKET.format('o_orderdate')} AS window_start, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_custkey END AS v FROM orders")
_table("dq_lineitem", "lineitem", "l_shipdate", "l_returnflag", "l_partkey", "l_partkey % 17 = 0", "30 days", f"SELECT l_returnflag AS topic, {BUCKET.format('l_shipdate')} AS window_start, CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_partkey END AS v FROM lineitem")
_table("dq_documents", "documents", None, "lang", "source", "n_chars < 200", "1 day", "SELECT lang AS topic, TIMESTAMP '2024-01-01' AS window_start, CASE WHEN n_chars < 200 THEN NULL ELSE source END AS v FROM documents")

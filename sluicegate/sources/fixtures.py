"""Deterministic faulty record streams from the ``events`` table, in SQL that several engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAYLOAD = """CASE WHEN event_id % 307 = 0 THEN NULL
  WHEN event_id % 211 = 0 THEN '{{not json'
  WHEN event_id % 401 = 0 THEN '[1,2]'
  ELSE '{{' || CASE WHEN event_id % 97 = 0 THEN '' ELSE '"id":"e' || CAST(event_id AS STRING) || '",' END
    || '"user_id":' || CASE WHEN d BETWEEN 10 AND 12 AND event_id % 3 = 0 THEN 'null' WHEN d BETWEEN 18 AND 19 THEN '1' ELSE CAST(user_id AS STRING) END
    || ',"amount":' || CASE WHEN d BETWEEN 15 AND 16 AND event_id % 4 = 0 THEN '"N/A"' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS STRING) END
    || ',"event_time":' || CASE WHEN event_id % 503 = 0 THEN '"yesterday"' ELSE CAST(ms - CASE WHEN d = 13 THEN 150000 WHEN event_id % 509 = 0 THEN -60000 ELSE (event_id % 20) * 1000 END AS STRING) END
    || CASE WHEN d >= 25 THEN '' ELSE ',"note":"x"' END || CASE WHEN d >= 20 THEN ',"channel":"web"' ELSE '' END || '}}' END"""

RECORDS = """SELECT 'ev.' || event_type AS topic, CAST(event_id % 3 AS INT) AS source_partition, event_id AS source_offset, ts AS ingest_ts, {payload} AS value
FROM (SELECT event_id, date_trunc('second', ts) AS ts, user_id, event_type, value, CAST({ms} AS BIGINT) AS ms, CAST(extract(day FROM ts) AS INT) AS d FROM {events}) e
WHERE NOT (event_type = 'click' AND d = 21) AND NOT (event_type = 'view' AND d IN (23, 24) AND event_id % 3 <> 0) AND NOT (event_type = 'signup' AND d >= 8 AND event_id % 2 <> 0)"""

#: The same text for DuckDB, as a subquery named records.
DUCK_RECORDS = RECORDS.format(payload=PAYLOAD.format(), ms="epoch_ms(date_trunc('second', ts))", events="events")


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, source_partition, source_offset, ingest_ts, value) with nulls, drift, silence and broken payloads."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    sql = RECORDS.format(payload=PAYLOAD, ms="unix_millis(CAST(date_trunc('second', ts) AS TIMESTAMP))", events="{events}")  # doubled braces stay for Spark's own formatter
    return spark.sql(sql, events=events.selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", "user_id", "event_type", "value"))

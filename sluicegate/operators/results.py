"""The results table: idempotent upserts, latest status, health, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.operators.checks import named, ordinal

KEY = ["topic", "check_type", "field", "window_start", "window_end"]
SERIES = ["topic", "check_type", "field"]
#: SQL states worth a retry: connection, transaction, resource, operator and system errors.
TRANSIENT = ("08", "40", "53", "57", "58")


def is_transient(sqlstate: str | None) -> bool:
    return sqlstate is None or sqlstate[:2] in TRANSIENT


def finite(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def result_rows(judged: DataFrame, size_s: int, job_id: str) -> DataFrame:
    """Rows of the results table; details of ok rows are dropped, baseline and percentiles come from all details."""
    detail = lambda k: F.try_variant_get(F.try_parse_json("details"), f"$.{k}", "double")
    return judged.select(
        *SERIES, "window_start", (F.col("window_start") + F.expr(f"INTERVAL {size_s} SECONDS")).alias("window_end"), finite(F.col("value")).alias("value"), finite(F.col("threshold")).alias("threshold"), "status", F.when(F.col("status") != "ok", F.col("details")).alias("details"),
        F.coalesce(detail("baseline_rate"), detail("baseline")).alias("baseline"), detail("p50_ms").alias("p50_ms"), detail("p99_ms").alias("p99_ms"), F.lit(job_id).alias("job_id"),
    )


def upsert(log: DataFrame, order: str = "seq") -> DataFrame:
    """The newest row of each key of an append-only log: max_by reduces before the shuffle."""
    rest = [c for c in log.columns if c not in KEY]
    return log.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_newest")).select(*KEY, "_newest.*")


def latest_status(results: DataFrame, order: str = "window_start") -> DataFrame:
    """The newest row of each series: the latest window end, of rows with one end the last by ``order`` (the sequence
    in which they were written, where there is one)."""
    newest = F.max_by(F.struct("window_end", "status", "value", "threshold"), F.struct("window_end", order, ordinal(F.col("status"))))
    return results.groupBy(*SERIES).agg(newest.alias("_newest")).select(*SERIES, "_newest.*")


def violations(results: DataFrame) -> DataFrame:
    return results.where("status <> 'ok'")


def topic_health(latest: DataFrame, now: Column, stale_s: int = 300) -> DataFrame:
    found = latest.groupBy("topic", "check_type").agg(named(F.max(ordinal(F.col("status")))).alias("worst_status"), F.max("window_end").alias("last_window"))
    return found.withColumn("is_stale", F.col("last_window") < now - F.expr(f"INTERVAL {stale_s} SECONDS"))


def status_gauge(results: DataFrame) -> DataFrame:
    """Ordinal of each series in its topic's newest window; 0 for a series without a row there. Both sides are
    aggregates, so no task holds a topic's rows."""
    series = results.groupBy(*SERIES).agg(F.max(F.struct("window_end", ordinal(F.col("status")).alias("state"))).alias("_newest"))
    last = series.groupBy(F.col("topic").alias("_topic")).agg(F.max("_newest.window_end").alias("_last"))
    return series.join(last, F.col("topic").eqNullSafe(F.col("_topic"))).select(*SERIES, F.when(F.col("_newest.window_end") == F.col("_last"), F.col("_newest.state")).otherwise(0).alias("gauge"))


def purge(table: DataFrame, column: str, now: Column, days: int) -> DataFrame:
    """What stays: rows not older than ``days``. A filter on the partition column prunes files."""
    return table.where(F.col(column) >= now - F.expr(f"INTERVAL {days} DAYS"))


# ---- the table itself: files by day of the window and by batch ----


def write_results(rows: DataFrame, path: str, batch: int) -> None:
    """Adds a batch of result rows. A batch that is written again replaces its own files only; rows of the same key
    from later batches win when the table is read."""
    dated = rows.withColumns({"window_date": F.to_date("window_start"), "batch_id": F.lit(batch).cast("long"), "ingested_at": F.current_timestamp()})
    # one file for each day: a batch holds a few windows
    dated.repartition("window_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window_date", "batch_id").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each key. Filters on window_start read the days in question only if window_date is filtered
    too (see ``between_days``)."""
    return upsert(spark.read.parquet(path).withColumn("batch_id", F.col("batch_id").cast("long")), "batch_id").drop("window_date")


def between_days(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """The newest rows of windows that start on the given days; other days' files aren't read."""
    rows = spark.read.parquet(path).where(F.col("window_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return upsert(rows.withColumn("batch_id", F.col("batch_id").cast("long")), "batch_id").drop("window_date")


def purge_results(spark: SparkSession, path: str, before: str) -> int:
    """Deletes the days before a date; gives the number of rows that went."""
    n = spark.read.parquet(path).where(F.col("window_date") < F.lit(before).cast("date")).count()
    jvm = spark._jvm.org.apache.hadoop.fs
    files = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in files.listStatus(jvm.Path(path)):
        name = f.getPath().getName()
        if name.startswith("window_date=") and name.partition("=")[2] < before:
            files.delete(f.getPath(), True)
    return n

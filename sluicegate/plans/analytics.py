"""Analytics over the results table. Every function is one DataFrame plan; time ranges are parameters, so filters
reach the scan before any window function. Limits carry tie-breakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicegate.operators.checks import named, ordinal
from sluicegate.operators.results import SERIES

#: A gap of more than so many window lengths ends an incident.
GAP_WINDOWS = 3


def between(results: DataFrame, start, end) -> DataFrame:
    """Rows whose window starts in [start, end]; a bound of None is open."""
    for bound, keep in ((start, lambda c, b: c >= b), (end, lambda c, b: c <= b)):
        if bound is not None:
            results = results.where(keep(F.col("window_start"), F.lit(bound)))
    return results


def _score() -> Column:
    return F.when(F.col("status") == "ok", 1.0).when(F.col("status") == "warn", 0.5).otherwise(0.0)


def _pct(x: Column, digits: int = 2) -> Column:
    return F.round(100 * x, digits)


def _seconds(end: Column, start: Column) -> Column:
    return F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))


def incidents(results: DataFrame, start=None, end=None) -> DataFrame:
    """Runs of violating windows of a series; an ok window or a long gap ends a run."""
    w = Window.partitionBy(*SERIES).orderBy("window_start")
    gap = _seconds(F.col("window_start"), F.lag("window_end").over(w))
    length = _seconds(F.col("window_end"), F.col("window_start"))
    marked = between(results, start, end).withColumn("_cut", F.coalesce((gap > GAP_WINDOWS * length).cast("int"), F.lit(1)) + (F.col("status") == "ok").cast("int"))
    runs = marked.withColumn("_run", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("status <> 'ok'")
    return (
        runs.groupBy(*SERIES, "_run")
        .agg(F.min("window_start").alias("started"), F.max("window_end").alias("ended"), F.count(F.lit(1)).alias("windows"), F.count_if(F.col("status") == "fail").alias("fail_windows"), named(F.max(ordinal(F.col("status")))).alias("worst_status"))
        .drop("_run")
        .withColumn("duration_s", _seconds(F.col("ended"), F.col("started")))
    )


def incident_stats(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("incidents"), F.max("duration_s").alias("longest_s"), F.round(F.avg("duration_s")).cast("long").alias("average_s"))


def incidents_per_hour(found: DataFrame) -> DataFrame:
    return found.groupBy(F.date_trunc("hour", "started").alias("time"), "check_type").agg(F.count(F.lit(1)).alias("incidents"))


def incident_log(found: DataFrame, limit: int = 200) -> DataFrame:
    return found.orderBy(F.desc("started"), *SERIES).limit(limit)


def quality_score(results: DataFrame) -> DataFrame:
    return results.agg(_pct(F.avg(_score())).alias("score"))


def availability(results: DataFrame) -> DataFrame:
    return results.agg(_pct(F.count_if(F.col("status") == "ok") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("pct_ok"))


def availability_by_check(results: DataFrame) -> DataFrame:
    s = F.col("status")
    return results.groupBy("topic", "check_type").agg(_pct(F.count_if(s == "ok") / F.count(F.lit(1))).alias("pct_ok"), F.count_if(s == "warn").alias("warns"), F.count_if(s == "fail").alias("fails"), F.count(F.lit(1)).alias("windows"))


def score_over_time(results: DataFrame, bucket: str) -> DataFrame:
    return results.groupBy(F.window("window_start", bucket)["start"].alias("time"), F.col("topic").alias("metric")).agg(_pct(F.avg(_score())).alias("score"))


def open_now(latest: DataFrame, now: Column, fresh_s: int = 300) -> DataFrame:
    return latest.where((F.col("status") != "ok") & (F.col("window_end") >= now - F.expr(f"INTERVAL {fresh_s} SECONDS"))).agg(F.count(F.lit(1)).alias("open_now"))


def flappiest(results: DataFrame, limit: int = 15, least: int = 2) -> DataFrame:
    """Series that change most often between ok and not ok."""
    w = Window.partitionBy(*SERIES).orderBy("window_start")
    flip = (F.col("status") == "ok") != (F.lag("status").over(w) == "ok")
    return results.withColumn("_flip", flip).groupBy(*SERIES).agg(F.count_if("_flip").alias("flips"), F.count(F.lit(1)).alias("windows")).where(F.col("flips") >= least).orderBy(F.desc("flips"), *SERIES).limit(limit)


def worst_null_fields(results: DataFrame, limit: int = 15) -> DataFrame:
    rows = results.where("check_type = 'null_rate'").groupBy("topic", "field").agg(_pct(F.avg("value")).alias("avg_null_pct"), _pct(F.max("value")).alias("max_null_pct"), F.count_if(F.col("status") != "ok").alias("bad_windows"))
    return rows.where("max_null_pct > 0").orderBy(F.desc("avg_null_pct"), "topic", "field").limit(limit)


def correlated_failures(results: DataFrame, limit: int = 100) -> DataFrame:
    """Windows in which two or more checks of a topic fail together."""
    found = results.where("status = 'fail'").groupBy("topic", "window_start").agg(F.countDistinct("check_type").alias("n_checks"), F.array_join(F.array_sort(F.collect_set("check_type")), ", ").alias("failing_checks"))
    return found.where("n_checks >= 2").orderBy(F.desc("window_start"), "topic").limit(limit)


def week_over_week(results: DataFrame, start, end) -> DataFrame:
    """Hourly average volume of a range, and that of the week before moved onto it."""
    volume = results.where("check_type = 'volume'")
    hourly = lambda df, shift, name: df.groupBy((F.date_trunc("hour", "window_start") + F.expr(f"INTERVAL {shift} DAYS")).alias("time"), "topic").agg(F.round(F.avg("value"), 6).alias("msgs_per_s")).select("time", F.concat("topic", F.lit(name)).alias("metric"), "msgs_per_s")
    before = between(volume, F.lit(start).cast("timestamp") - F.expr("INTERVAL 7 DAYS"), F.lit(end).cast("timestamp") - F.expr("INTERVAL 7 DAYS"))
    return hourly(between(volume, start, end), 0, "").unionByName(hourly(before, 7, " (7d ago)"))


def top_offenders(results: DataFrame, limit: int = 20) -> DataFrame:
    s = F.col("status")
    return results.where("status <> 'ok'").groupBy(*SERIES).agg(F.count(F.lit(1)).alias("violations"), F.count_if(s == "fail").alias("fails"), F.max("window_end").alias("last_seen")).orderBy(F.desc("violations"), *SERIES).limit(limit)


def violation_log(results: DataFrame, limit: int = 1000) -> DataFrame:
    return results.where("status <> 'ok'").select(F.col("window_start").alias("time"), *SERIES, "status", F.round("value", 4).alias("value"), F.round("threshold", 4).alias("threshold")).orderBy(F.desc("time"), *SERIES).limit(limit)


def violations_per_minute(results: DataFrame) -> DataFrame:
    return results.where("status <> 'ok'").groupBy(F.window("window_start", "1 minute")["start"].alias("time"), F.col("check_type").alias("metric")).agg(F.count(F.lit(1)).alias("violations"))


def violations_by_status(results: DataFrame, bucket: str) -> DataFrame:
    return results.where("status <> 'ok'").groupBy(F.window("window_start", bucket)["start"].alias("time"), F.col("status").alias("metric")).agg(F.count(F.lit(1)).alias("violations"))


def topics_with(latest: DataFrame, status: str) -> DataFrame:
    return latest.where(F.col("status") == status).agg(F.countDistinct("topic").alias("topics"))


def rag_matrix(latest: DataFrame, kinds: list[str], since: Column | None = None) -> DataFrame:
    """Worst ordinal of each topic (rows) and check (columns)."""
    rows = latest if since is None else latest.where(F.col("window_end") > since)
    return rows.groupBy("topic").pivot("check_type", kinds).agg(F.max(ordinal(F.col("status"))))


def status_timeline(results: DataFrame) -> DataFrame:
    label = F.when(F.col("field") == "", F.col("check_type")).otherwise(F.concat_ws(".", "check_type", "field"))
    return results.select(F.col("window_start").alias("time"), "topic", label.alias("metric"), ordinal(F.col("status")).alias("state"))


def series(results: DataFrame, check: str, columns: dict[str, str]) -> DataFrame:
    """Columns of a check as named series (time, topic, metric, value), nulls left out."""
    rows = results.where(F.col("check_type") == check)
    stacked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("value")) for name, c in columns.items()]))
    metric = F.when(F.col("field") == "", F.col("x.name")).otherwise(F.concat_ws(" ", F.col("field"), F.col("x.name")))
    return rows.select("window_start", "topic", "field", stacked.alias("x")).where("x.value IS NOT NULL").select(F.col("window_start").alias("time"), "topic", metric.alias("metric"), "x.value")


def crossed_thresholds(results: DataFrame, check: str) -> DataFrame:
    return results.where((F.col("check_type") == check) & (F.col("status") != "ok")).select(F.col("window_start").alias("time"), "topic", "field", F.round("threshold", 6).alias("threshold"))


def choices(results: DataFrame, column: str) -> DataFrame:
    return results.select(F.col(column).alias("choice")).where("choice <> ''").distinct()


def heartbeat_age(beats: DataFrame, now: Column) -> DataFrame:
    return beats.agg(_seconds(now, F.max("ts")).alias("age_s"))


def newest_heartbeat(beats: DataFrame, column: str) -> DataFrame:
    return beats.orderBy(F.desc("ts"), "job_id").limit(1).select(F.col(column).alias("state"))

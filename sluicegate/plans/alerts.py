"""Alert rules over status histories, inhibition, and webhook payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicegate.operators.checks import ordinal
from sluicegate.operators.results import SERIES

#: Seconds a series must warn before its alert, and limits of the monitor's own health.
WARN_FOR_S, STALLED_S, LAG_ROWS, BEHIND_MS = 120, 300, 10_000, 60_000
ALERT = "alertname string, severity string, topic string, check_type string, field string"
WEBHOOK = "status string, alerts array<struct<status:string,labels:map<string,string>,annotations:map<string,string>,startsAt:string,endsAt:string,fingerprint:string>>"


def status_alerts(results: DataFrame, warn_for_s: int = WARN_FOR_S) -> DataFrame:
    """Alerts that fire in a series' newest window: fail at once, warn after it has lasted."""
    w = Window.partitionBy(*SERIES).orderBy("window_start")
    state = ordinal(F.col("status"))
    runs = results.withColumn("_run", F.sum(F.when(state == F.lag(state).over(w), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    grouped = runs.groupBy(*SERIES, "_run").agg(F.min("window_start").alias("since"), F.max("window_end").alias("until"), F.first("status").alias("status"))
    last = grouped.groupBy(*SERIES).agg(F.max_by(F.struct("since", "until", "status"), F.col("_run")).alias("_newest")).select(*SERIES, "_newest.*")
    lasted = F.unix_timestamp(F.col("until").cast("timestamp")) - F.unix_timestamp(F.col("since").cast("timestamp"))
    firing = last.where((F.col("status") == "fail") | ((F.col("status") == "warn") & (lasted >= warn_for_s)))
    fail = F.col("status") == "fail"
    return firing.select(F.when(fail, "DataQualityFail").otherwise("DataQualityWarn").alias("alertname"), F.when(fail, "critical").otherwise("warning").alias("severity"), *SERIES, F.col("since").alias("starts_at"))


def monitor_alerts(last_window_end: Column, now: Column, lag_rows: Column, delay_ms: Column, source: DataFrame) -> DataFrame:
    """Alerts about the monitor: no windows at all, none for long, a backlog, a delay. ``source`` has one row."""
    rule = lambda when, name: F.when(when, F.lit(name))
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(last_window_end.cast("timestamp"))
    rules = F.array(rule(last_window_end.isNull(), "QualityMonitorMissing"), rule(age > STALLED_S, "QualityMonitorStalled"), rule(lag_rows > LAG_ROWS, "QualityMonitorLagging"), rule(delay_ms > BEHIND_MS, "QualityMonitorBehind"))
    return source.select(F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("alertname")).withColumn("severity", F.lit("critical"))


#: How long each rule of the monitor must hold before it fires, in seconds.
HOLD_S = {"QualityMonitorStalled": 60, "QualityMonitorMissing": 300, "QualityMonitorLagging": 120, "QualityMonitorBehind": 120}
#: Seconds that a new group of notifications waits, between its changes, and until an unchanged one is sent again.
GROUP_WAIT_S, GROUP_INTERVAL_S, REPEAT_S = 10, 60, 4 * 3600


def monitor_firing(samples: DataFrame) -> DataFrame:
    """Firings of the monitor's rules over samples (ts, last_window_end, lag_rows, delay_ms): a rule that holds in all
    samples for its time fires at the first sample after that, until the first one in which it doesn't hold."""
    age = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("last_window_end").cast("timestamp"))
    holds = {"QualityMonitorStalled": age > STALLED_S, "QualityMonitorMissing": F.col("last_window_end").isNull(), "QualityMonitorLagging": F.col("lag_rows") > LAG_ROWS, "QualityMonitorBehind": F.col("delay_ms") > BEHIND_MS}
    rules = F.array(*[F.struct(F.lit(n).alias("alertname"), F.coalesce(c, F.lit(False)).alias("holds"), F.lit(HOLD_S[n]).alias("hold_s")) for n, c in holds.items()])
    w = Window.partitionBy("alertname").orderBy("ts")
    rows = samples.select("ts", F.inline(rules)).withColumn("_cut", (~F.col("holds")).cast("int")).withColumn("_run", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_next", F.lead("ts").over(w))
    held = rows.where("holds").withColumn("_since", F.min("ts").over(Window.partitionBy("alertname", "_run")))
    lasted = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("_since").cast("timestamp"))
    fired = held.groupBy("alertname", "_run").agg(F.min("_since").alias("pending_since"), F.min(F.when(lasted >= F.col("hold_s"), F.col("ts"))).alias("starts_at"), F.max_by("_next", "ts").alias("ends_at"))
    return fired.where("starts_at IS NOT NULL").drop("_run").withColumn("severity", F.lit("critical"))


def notifications(firings: DataFrame, until: Column) -> DataFrame:
    """(alertname, topic, sent_at, alerts): firings (alertname, topic, starts_at) are sent together by alert and topic.
    A group's first message waits, later ones go at its intervals when something is new, and a group without news is
    sent again after a while, up to ``until``."""
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    group = Window.partitionBy("alertname", "topic")
    first = seconds(F.min("starts_at").over(group)) + GROUP_WAIT_S
    step = F.greatest(F.ceil((seconds(F.col("starts_at")) - first) / GROUP_INTERVAL_S), F.lit(0))
    news = firings.withColumn("_sent", first + step * GROUP_INTERVAL_S).groupBy("alertname", "topic", "_sent").agg(F.count(F.lit(1)).alias("alerts"))
    end = F.coalesce(F.lead("_sent").over(group.orderBy("_sent")) - 1, seconds(until))
    again = news.withColumn("_end", end).withColumn("_at", F.explode(F.sequence("_sent", F.greatest("_end", "_sent"), F.lit(REPEAT_S).cast("long"))))
    return again.select("alertname", "topic", F.timestamp_seconds("_at").alias("sent_at"), F.when(F.col("_at") == F.col("_sent"), F.col("alerts")).otherwise(0).alias("alerts"))


def inhibited(alerts: DataFrame) -> DataFrame:
    """Warnings go where a critical alert has the same topic, check and field."""
    critical = alerts.where("severity = 'critical'").select(*SERIES).distinct()
    return alerts.where("severity = 'critical'").unionByName(alerts.where("severity <> 'critical'").join(critical, SERIES, "left_anti"))


def instant(text: Column) -> Column:
    """A timestamp of an RFC 3339 text, cut to microseconds; the zero time is null."""
    return F.when(~text.startswith("0001-01-01"), F.regexp_replace(text, r"(\.\d{6})\d+", "$1").try_cast("timestamp"))


def webhook_events(payloads: DataFrame, column: str = "body") -> DataFrame:
    """A row for each alert of each webhook payload; a missing fingerprint is the sorted labels as JSON."""
    alert = F.explode(F.from_json(column, WEBHOOK)["alerts"])
    label = lambda k: F.coalesce(F.col("a.labels").getItem(k), F.lit(""))
    ordered = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("a.labels"))))
    return payloads.select(alert.alias("a")).select(
        F.col("a.status").alias("status"), F.coalesce("a.fingerprint", ordered).alias("fingerprint"), *[label(k).alias(k) for k in ("alertname", "severity", "topic", "check_type", "field")],
        instant(F.col("a.startsAt")).alias("starts_at"), F.when(F.col("a.status") == "resolved", instant(F.col("a.endsAt"))).alias("ends_at"), F.coalesce(F.col("a.annotations").getItem("summary"), F.lit("")).alias("summary"),
    )


def first_of_each(events: DataFrame, order: str | None = None) -> DataFrame:
    """One event for each (fingerprint, status, starts_at): repeats change nothing."""
    key = ["fingerprint", "status", "starts_at"]
    if order is None:
        return events.dropDuplicates(key)
    rest = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_newest")).select(*key, "_newest.*")


def history(events: DataFrame, now: Column) -> DataFrame:
    """Each firing with its resolution; what still fires lasts until now."""
    key = ["fingerprint", "starts_at"]
    resolved = events.where("status = 'resolved'").select(*key, F.col("ends_at").alias("resolved_at"))
    fired = events.where("status = 'firing'").drop("status", "ends_at").join(resolved, key, "left")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return fired.withColumn("duration_s", (micros(F.coalesce("resolved_at", now)) - micros(F.col("starts_at"))) / 1e6).withColumn("state", F.when(F.col("resolved_at").isNull(), "FIRING").otherwise("resolved"))


def alerts_per_hour(events: DataFrame) -> DataFrame:
    return events.where("status = 'firing'").groupBy(F.date_trunc("hour", "starts_at").alias("time"), F.col("severity").alias("metric")).agg(F.count(F.lit(1)).alias("alerts"))

"""Tumbling-window statistics of analysed records, one shuffle for all of a topic's checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicegate.functions.json_schema import TAGS

KEYS_KEPT, ERRORS_KEPT = 200, 5


def window_start(ts: Column, size_s: int) -> Column:
    return F.window(ts, f"{size_s} seconds")["start"]


def topic_windows(parsed: DataFrame, fields: list[str], size_s: int, exact: bool = True, distinct_fields: list[str] | None = None) -> DataFrame:
    """For each topic and window: n, decoded, measured, lag percentiles, future, checked, invalid, skipped, and for each field
    its present values, distinct values (of ``distinct_fields`` only, where given) and type counts. ``exact`` distincts and percentiles suit batch; else
    mergeable sketches are used (HLL of 2^12, KLL of 200)."""
    lag = F.when(F.col("from_payload"), F.unix_millis(F.col("ingest_ts").cast("timestamp")) - F.col("event_ms"))
    late = F.greatest(lag, F.lit(0)).cast("double")
    value = lambda f: F.col("fields").getItem(f)
    tag = lambda f: F.col("types").getItem(f)
    percentile = (lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY _late)")) if exact else (lambda q: F.expr(f"kll_sketch_get_quantile_double(kll_sketch_agg_double(_late, 200), {q}D)"))
    distinct = F.countDistinct if exact else (lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c, 12)))
    aggregates = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("undecoded")).alias("decoded"),
        F.count("_late").alias("measured"),
        *[percentile(q).alias(f"p{round(q * 100)}_ms") for q in (0.5, 0.95, 0.99)],
        F.max("_late").alias("max_ms"),
        F.count_if(F.col("_lag") < 0).alias("future"),
        F.count_if(F.col("structural") > 0).alias("checked"),
        F.count_if(F.col("structural") == 2).alias("invalid"),
        F.count_if(F.col("structural") == 0).alias("skipped"),
    ]
    for f in fields:
        aggregates += [F.count(value(f)).alias(f"present_{f}"), *([distinct(value(f)).alias(f"distinct_{f}")] if distinct_fields is None or f in distinct_fields else []), *[F.count_if(tag(f) == t).alias(f"{t}_{f}") for t in TAGS]]
    parsed = parsed if "undecoded" in parsed.columns else parsed.withColumn("undecoded", F.lit(False))
    staged = parsed.withColumn("_lag", lag).withColumn("_late", late)
    return staged.groupBy("topic", window_start(F.col("ingest_ts"), size_s).alias("window_start")).agg(*aggregates)


def most_frequent(counted: DataFrame, by: list[str], name: str, keep: int) -> DataFrame:
    """Of counts ``c`` the ``keep`` largest of each group, ties by name. Ranking sorts and may spill, so no group's
    names have to fit in one row; only what is kept is collected."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("c"), name))
    return counted.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")


def key_counts(parsed: DataFrame, size_s: int) -> DataFrame:
    """(topic, window_start, keys): how many records have each top-level key; the most frequent ``KEYS_KEPT`` keys."""
    per_key = parsed.select("topic", window_start(F.col("ingest_ts"), size_s).alias("window_start"), F.explode("keys").alias("key")).groupBy("topic", "window_start", "key").agg(F.count(F.lit(1)).alias("c"))
    kept = most_frequent(per_key, ["topic", "window_start"], "key", KEYS_KEPT)
    return kept.groupBy("topic", "window_start").agg(F.map_from_entries(F.collect_list(F.struct("key", "c"))).alias("keys"))


def top_errors(parsed: DataFrame, size_s: int) -> DataFrame:
    """(topic, window_start, error, c) of the ``ERRORS_KEPT`` most frequent structural errors, ties by text."""
    found = parsed.where("structural_error IS NOT NULL").groupBy("topic", window_start(F.col("ingest_ts"), size_s).alias("window_start"), F.col("structural_error").alias("error")).agg(F.count(F.lit(1)).alias("c"))
    return most_frequent(found, ["topic", "window_start"], "error", ERRORS_KEPT).select("topic", "window_start", "error", "c")


def tallies(parsed: DataFrame, size_s: int) -> DataFrame:
    """(topic, window_start, keys, errors): what ``key_counts`` and ``top_errors`` give, as maps, from one pass."""
    error = F.when(F.col("structural_error").isNotNull(), F.array(F.struct(F.lit(True).alias("is_error"), F.col("structural_error").alias("name"))))
    none = F.array().cast("array<struct<is_error:boolean,name:string>>")
    both = F.concat(F.coalesce(F.transform("keys", lambda k: F.struct(F.lit(False).alias("is_error"), k.alias("name"))), none), F.coalesce(error, none))
    per = parsed.select("topic", window_start(F.col("ingest_ts"), size_s).alias("window_start"), F.inline(both)).groupBy("topic", "window_start", "is_error", "name").agg(F.count(F.lit(1)).alias("c"))
    rank = F.row_number().over(Window.partitionBy("topic", "window_start", "is_error").orderBy(F.desc("c"), "name"))
    kept = per.withColumn("_rank", rank).where(F.col("_rank") <= F.when(F.col("is_error"), ERRORS_KEPT).otherwise(KEYS_KEPT))
    listed = lambda errors: F.array_sort(F.collect_list(F.when(F.col("is_error") == errors, F.struct((-F.col("c")).alias("c"), "name"))))
    as_map = lambda x: F.map_from_entries(F.transform(x, lambda e: F.struct(e["name"], -e["c"])))
    lists = kept.groupBy("topic", "window_start").agg(listed(False).alias("k"), listed(True).alias("e"))
    return lists.select("topic", "window_start", as_map("k").alias("keys"), as_map("e").alias("errors"))


def with_silence(windows: DataFrame, spine: DataFrame) -> DataFrame:
    """Windows of the spine; those without records count 0."""
    return spine.join(windows, ["topic", "window_start"], "left").withColumn("n", F.coalesce("n", F.lit(0)))

"""The seven checks. Those without memory are expressions; the others judge a window against a history.

Values are compared strictly: above fail is fail, else above warn is warn, else ok.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.config import Thresholds
from sluicegate.functions.json_schema import TAGS

STATUSES = ("ok", "warn", "fail")


def status_of(value: Column, warn, fail) -> Column:
    return F.when(value > fail, "fail").when(value > warn, "warn").otherwise("ok")


def ordinal(status: Column) -> Column:
    return F.when(status == "fail", 2).when(status == "warn", 1).otherwise(0)


def named(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATUSES)), (rank + 1).cast("int"))


@dataclass(frozen=True)
class PlainCheck:
    """A check without memory over a window's statistics: a value that is judged by two thresholds. One for each field
    (``name`` is its name) or one for the topic (``name`` is empty). Adding one to ``PLAIN`` is all that it takes."""

    per_field: bool
    warn: tuple[str, float]
    fail: tuple[str, float]
    when: Callable[[str], Column]
    value: Callable[[str], Column]
    details: Callable[[str], dict[str, Column]]


def _details_of_lags(name: str) -> dict[str, Column]:
    return {f"{k}_ms": F.round(F.col(f"{k}_ms")).cast("long") for k in ("p50", "p95", "p99", "max")} | {"n": F.col("measured"), "future_timestamps": F.col("future")}


def _type_counts(name: str) -> list[Column]:
    return [F.coalesce(F.col(f"{tag}_{name}"), F.lit(0)) for tag in TAGS]


#: Names of checks, thresholds and details are fixed values.
PLAIN = {
    "null_rate": PlainCheck(True, ("warn", 0.05), ("fail", 0.20), lambda f: F.col("decoded") > 0, lambda f: (F.col("decoded") - F.col(f"present_{f}")) / F.col("decoded"), lambda f: {"nulls": F.col("decoded") - F.col(f"present_{f}"), "total": F.col("decoded")}),
    "freshness": PlainCheck(False, ("warn_p95_ms", 30000), ("fail_p95_ms", 120000), lambda f: F.col("measured") > 0, lambda f: F.col("p95_ms"), _details_of_lags),
    "structural": PlainCheck(False, ("warn", 0.0), ("fail", 0.01), lambda f: F.col("checked") > 0, lambda f: F.col("invalid") / F.col("checked"), lambda f: {k: F.col(k) for k in ("checked", "invalid", "skipped")} | {"top_errors": F.col("errors")}),
    "type_drift": PlainCheck(True, ("warn", 0.01), ("fail", 0.10), lambda f: sum(_type_counts(f)) > 0, lambda f: 1 - F.greatest(*_type_counts(f)) / sum(_type_counts(f)), lambda f: {}),
}


def threshold_table(spark: SparkSession, t: Thresholds, names: dict[str, list[str]]) -> DataFrame:
    """(topic, check_type, field, warn, fail, required) of the topics that the thresholds name; small."""
    rows = [(topic, check, f, float(t.get(topic, check, *PLAIN[check].warn, f or None)), float(t.get(topic, check, *PLAIN[check].fail, f or None)), bool(f) and t.required(topic, f)) for topic in t.topics for check, own in names.items() for f in own]
    return spark.createDataFrame(rows, "_topic string, _check string, _field string, _warn double, _fail double, _required boolean")


def plain_rows(windows: DataFrame, t: Thresholds, fields: list[str], names: tuple[str, ...] = ("null_rate", "freshness", "structural")) -> DataFrame:
    """Rows of all named checks without memory: the windows are read once, thresholds come by a broadcast join."""
    if "errors" not in windows.columns:
        windows = windows.withColumn("errors", F.lit(None).cast("map<string,bigint>"))
    wanted = {n: fields if PLAIN[n].per_field else [""] for n in names}
    entries = []
    for n, own in wanted.items():
        for f in own:
            check = PLAIN[n]
            details = check.details(f)
            entries.append(F.when(check.when(f), F.struct(F.lit(f).alias("field"), F.lit(n).alias("check_type"), check.value(f).cast("double").alias("value"), (F.to_json(F.struct(*[c.alias(k) for k, c in details.items()])) if details else F.lit("{}")).alias("details"))))
    rows = windows.select("topic", "window_start", F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("r")).select("topic", "r.field", "r.check_type", "window_start", "r.value", "r.details")
    table = F.broadcast(threshold_table(windows.sparkSession, t, wanted))
    joined = rows.join(table, (F.col("topic") == F.col("_topic")) & (F.col("check_type") == F.col("_check")) & (F.col("field") == F.col("_field")), "left")
    common = lambda part: F.element_at(F.create_map(*[x for n in names for x in (F.lit(n), F.lit(float(t.get("", n, *getattr(PLAIN[n], part)))))]), F.col("check_type"))
    warn, fail = F.coalesce("_warn", common("warn")), F.coalesce("_fail", common("fail"))
    status = status_of(F.col("value"), warn, fail)
    required = F.concat(F.expr("substring(details, 1, length(details) - 1)"), F.lit(',"required":'), F.coalesce("_required", F.lit(False)).cast("string"), F.lit("}"))
    return joined.select("topic", "field", "check_type", "window_start", "value", F.when(status == "fail", fail).otherwise(warn).alias("threshold"), status.alias("status"), F.when(F.col("check_type") == "null_rate", required).otherwise(F.col("details")).alias("details"))


def null_rate(windows: DataFrame, t: Thresholds, name: str) -> DataFrame:
    return plain_rows(windows, t, [name], ("null_rate",))


def freshness(windows: DataFrame, t: Thresholds) -> DataFrame:
    return plain_rows(windows, t, [], ("freshness",))


def structural(windows: DataFrame, t: Thresholds) -> DataFrame:
    return plain_rows(windows, t, [], ("structural",))


def type_drift_cold(windows: DataFrame, t: Thresholds, name: str) -> DataFrame:
    """Type drift of a window against its own most frequent type, as before any history."""
    return plain_rows(windows, t, [name], ("type_drift",))


# ---- checks with a history: plain functions over one series, run by operators.baseline ----


@dataclass
class Verdict:
    value: float
    threshold: float
    status: str
    sample: float  # what the history learns
    details: dict = field(default_factory=dict)
    extra: dict[str, float] = field(default_factory=dict)  # further samples by key

    def details_json(self) -> str:
        return json.dumps(self.details, separators=(",", ":"))


def classify(value: float, warn: float, fail: float) -> str:
    return "fail" if value > fail else "warn" if value > warn else "ok"


def half_up(x: float, digits: int) -> float:
    """As details print numbers: halves of the shortest decimal form go away from zero."""
    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def _mean(x: list[float]) -> float:
    return sum(x) / len(x) if x else math.nan


def volume(count: int, window_s: float, history: list[float], prior: list[float] | None, p: dict) -> Verdict:
    """Drop below the mean rate of the history, or of the same slot's earlier cycles when these are given."""
    rate, base = count / window_s, _mean(prior if prior is not None else history)
    warm = prior is not None or len(history) >= p["min_history"]
    drop = round(max(0.0, (1 - rate / base) * 100), 9) if warm and base > 0 else 0.0  # the last digits depend on the order of sums
    if count == 0 and p["fail_on_zero"]:
        status = "fail"
    else:
        status = classify(drop, p["warn_drop_pct"], p["fail_drop_pct"])
    pct = {"fail": p["fail_drop_pct"], "warn": p["warn_drop_pct"]}.get(status)
    threshold = base * (1 - pct / 100) if pct is not None and warm and base > 0 else 0.0
    details = {"count": count, "window_sec": window_s, "baseline_rate": None if math.isnan(base) else half_up(base, 4), "drop_pct": half_up(drop, 1), "history_windows": len(history), "warming_up": not warm, "baseline_source": "seasonal" if prior is not None else "recent"}
    return Verdict(rate, threshold, status, rate, details)


def cardinality(estimate: float, history: list[float], p: dict) -> Verdict:
    base = _mean(history)
    warm = len(history) >= p["min_history"] and base >= p["min_baseline"]
    factor = max(estimate / base, base / max(estimate, 1.0)) if warm else 1.0
    status = classify(factor, p["warn_ratio"], p["fail_ratio"])
    threshold = {"ok": 0.0, "warn": p["warn_ratio"], "fail": p["fail_ratio"]}[status]
    details = {"estimate": round(estimate), "baseline": None if math.isnan(base) else half_up(base, 1), "factor": half_up(factor, 2), "direction": "up" if warm and estimate >= base else "down", "history_windows": len(history), "warming_up": not warm}
    return Verdict(estimate, threshold, status, estimate, details)


def type_drift(counts: list[int], history: list[float], p: dict) -> Verdict | None:
    """Share of values that aren't of the usual type: the history's most frequent code, else the window's own."""
    n = sum(counts)
    if not n:
        return None
    own = counts.index(max(counts))
    learned = len(history) >= p["min_history"]
    codes = [int(h) for h in history]
    usual = max(sorted(set(codes)), key=codes.count) if learned else own
    value = 1 - counts[usual] / n
    status = classify(value, p["warn"], p["fail"])
    details = {"baseline": TAGS[usual], "dominant": TAGS[own], "counts": {t: c for t, c in zip(TAGS, counts, strict=True) if c}, "total": n, "learned": learned}
    return Verdict(value, p["fail"] if status == "fail" else p["warn"], status, float(own), details)


def schema_drift(keys: dict[str, int], n: int, history: list[float], known: dict[str, list[float]], p: dict) -> Verdict | None:
    """Number of keys that came or went against the learned set; every key's share is a further sample."""
    if not n:
        return None
    warm = len(history) >= p["min_history"]
    rate = {k: c / n for k, c in keys.items()}
    came = sorted(k for k, r in rate.items() if k not in known and r >= p["appear_min_rate"]) if warm else []
    went = sorted(k for k, h in known.items() if _mean(h) >= p["min_presence"] and rate.get(k, 0.0) < p["disappear_below"]) if warm else []
    value = float(len(came) + len(went))
    status = classify(value, p["warn"], p["fail"])
    details = {"appeared": came[:10], "disappeared": went[:10], "fields_seen": len(keys), "records": n, "warming_up": not warm}
    return Verdict(value, p["fail"] if status == "fail" else p["warn"], status, value, details, rate | {k: 0.0 for k in known if k not in rate})


#: Defaults of the checks with a history.
DEFAULTS = {
    "volume": {"warn_drop_pct": 30, "fail_drop_pct": 60, "min_history": 5, "fail_on_zero": True, "seasonality": "none", "seasonal_min_cycles": 1},
    "cardinality": {"warn_ratio": 2.0, "fail_ratio": 5.0, "min_history": 5, "min_baseline": 10},
    "type_drift": {"warn": 0.01, "fail": 0.10, "min_history": 5},
    "schema_drift": {"warn": 0, "fail": 3, "min_history": 5, "min_presence": 0.5, "appear_min_rate": 0.05, "disappear_below": 0.01, "enabled": True},
}


def settings(t: Thresholds, topic: str, check: str, name: str = "") -> dict:
    return {k: t.get(topic, check, k, v, name or None) for k, v in DEFAULTS[check].items()}

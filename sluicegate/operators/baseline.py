"""Baselines that learn only from healthy windows.

Whether a window enters a baseline depends on its own verdict, which depends on the baseline: a fold over the windows
of one series (topic, check, field) in order. ``fold`` is that fold, linear in the windows; batch runs it per series
in ``applyInPandas``, streams run the same function per micro-batch with the state kept in a table.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.config import Thresholds
from sluicegate.operators import checks
from sluicegate.operators.checks import TAGS, Verdict

HOUR_MS = 3_600_000
#: Period in hours and cycles kept.
SEASONS = {"daily": (24, 7), "weekly": (168, 4)}
#: Names learned by schema drift at most; further ones are not remembered.
KNOWN_NAMES = 5_000
SAMPLE = "topic string, check_type string, field string, window_start timestamp, n long, estimate double, tags array<long>, keys map<string,long>"
RESULT = "topic string, check_type string, field string, window_start timestamp, value double, threshold double, status string, details string"


def streak(previous: int, status: str) -> int:
    return 0 if status == "ok" else previous + 1


def learns(status: str, streak_after: int, rebaseline_after: int) -> bool:
    return status == "ok" or streak_after > rebaseline_after


def push(ring: list[float], x: float, size: int) -> list[float]:
    return [*ring, x][-size:]


def slot_and_cycle(start_ms: int, season: str) -> tuple[int, int]:
    period = SEASONS[season][0] * HOUR_MS
    return start_ms % period // HOUR_MS, start_ms // period


def season_push(cycles: list[list[float]], cycle: int, x: float, keep: int) -> list[list[float]]:
    """[cycle, sum, count] triples with x added, the newest ``keep`` of them."""
    out = [list(c) for c in cycles]
    if out and out[-1][0] == cycle:
        out[-1] = [cycle, out[-1][1] + x, out[-1][2] + 1]
    else:
        out.append([cycle, x, 1])
    return out[-keep:]


def season_prior(cycles: list[list[float]], cycle: int) -> list[float]:
    return [s / n for c, s, n in cycles if c < cycle and n]


def empty_state() -> dict:
    return {"history": [], "streak": 0, "seasonal": {}, "known": {}}


def _judge_volume(row: dict, state: dict, p: dict, window_s: float) -> Verdict:
    prior = None
    if p["seasonality"] in SEASONS:
        slot, cycle = slot_and_cycle(row["start_ms"], p["seasonality"])
        prior = season_prior(state["seasonal"].get(str(slot), []), cycle)
        prior = prior if prior and len(prior) >= p["seasonal_min_cycles"] else None
    return checks.volume(int(row["n"]), window_s, state["history"], prior, p)


#: How each check with a history judges a row of its series; a new one is added here, to ``SAMPLES`` and to
#: ``checks.DEFAULTS``.
JUDGES = {
    "volume": _judge_volume,
    "cardinality": lambda row, state, p, window_s: checks.cardinality(row["estimate"], state["history"], p),
    "type_drift": lambda row, state, p, window_s: checks.type_drift([int(c) for c in row["tags"]], state["history"], p),
    "schema_drift": lambda row, state, p, window_s: checks.schema_drift({k: int(c) for k, c in dict(row["keys"] or {}).items()}, int(row["n"]), state["history"], state["known"], p),
}


def judge(row: dict, state: dict, p: dict, window_s: float) -> Verdict | None:
    return JUDGES[row["check_type"]](row, state, p, window_s)


def fold(rows: Iterable[dict], p: dict, window_s: float, history_windows: int, rebaseline_after: int, state: dict | None = None) -> tuple[list[tuple[dict, Verdict]], dict]:
    """Judges the rows of a series in order and gives the verdicts and the state after them."""
    state, out = state or empty_state(), []
    for row in rows:
        v = judge(row, state, p, window_s)
        if v is None:
            continue
        out.append((row, v))
        state["streak"] = streak(state["streak"], v.status)
        if learns(v.status, state["streak"], rebaseline_after):
            state["history"] = push(state["history"], v.sample, history_windows)
            for k, x in v.extra.items():
                if k in state["known"] or len(state["known"]) < KNOWN_NAMES:
                    state["known"][k] = push(state["known"].get(k, []), x, history_windows)
            if row["check_type"] == "volume" and p["seasonality"] in SEASONS:
                slot, cycle = slot_and_cycle(row["start_ms"], p["seasonality"])
                state["seasonal"][str(slot)] = season_push(state["seasonal"].get(str(slot), []), cycle, v.sample, SEASONS[p["seasonality"]][1])
    return out, state


#: Of each check with a history: the kind of name its series have, when a window is a row of it, and what the row holds.
SAMPLES = {
    "volume": ("", lambda f: F.lit(True), lambda f: {}),
    "cardinality": ("distinct", lambda f: F.col(f"present_{f}") > 0, lambda f: {"estimate": F.col(f"distinct_{f}").cast("double")}),
    "type_drift": ("field", lambda f: F.col(f"present_{f}") > 0, lambda f: {"tags": F.array(*[F.coalesce(F.col(f"{t}_{f}"), F.lit(0)).cast("long") for t in TAGS])}),
    "schema_drift": ("keys", lambda f: (F.col("decoded") > 0) & F.col("keys").isNotNull(), lambda f: {"n": F.col("decoded"), "keys": F.col("keys").cast("map<string,bigint>")}),
}


def samples(windows: DataFrame, fields: list[str], distinct_fields: list[str], only: list[str] | None = None) -> DataFrame:
    """The rows that series are made of, for all checks with a history (or ``only`` some); the windows are read once.
    Schema drift needs a column ``keys`` (a map of counts)."""
    names = {"": [""], "distinct": distinct_fields, "field": fields, "keys": [""] if "keys" in windows.columns else []}
    rows = []
    for check, (kind, when, own) in SAMPLES.items():
        for f in names[kind] if only is None or check in only else []:
            values = {"n": F.col("n"), "estimate": F.lit(None), "tags": F.lit(None), "keys": F.lit(None)} | own(f)
            typed = [values[k].cast(t).alias(k) for k, t in (("n", "long"), ("estimate", "double"), ("tags", "array<bigint>"), ("keys", "map<string,bigint>"))]
            rows.append(F.when(when(f), F.struct(F.lit(check).alias("check_type"), F.lit(f).alias("field"), *typed)))
    kept = F.filter(F.array(*rows), lambda x: x.isNotNull())
    return windows.select("topic", F.col("window_start").cast("timestamp").alias("window_start"), F.explode(kept).alias("r")).select("topic", "r.check_type", "r.field", "window_start", "r.n", "r.estimate", "r.tags", "r.keys")


def judged(series: DataFrame, thresholds: Thresholds, window_s: float) -> DataFrame:
    """Verdicts of all windows of all series: one shuffle by series, linear time, no state beyond one series."""
    history, rebaseline = thresholds.history_windows, thresholds.rebaseline_after

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        topic, check, name = key
        rows = frame.sort_values("window_start").to_dict("records")
        for r in rows:
            r["start_ms"] = int(r["window_start"].timestamp() * 1000)
        out, _ = fold(rows, checks.settings(thresholds, topic, check, name), window_s, history, rebaseline)
        return pd.DataFrame([(topic, check, name, r["window_start"], float(v.value), float(v.threshold), v.status, v.details_json()) for r, v in out], columns=["topic", "check_type", "field", "window_start", "value", "threshold", "status", "details"])

    return series.groupBy("topic", "check_type", "field").applyInPandas(run, RESULT)


def state_json(state: dict) -> str:
    return json.dumps(state, separators=(",", ":"))

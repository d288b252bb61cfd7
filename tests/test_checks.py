"""The checks, baselines and configuration against formulas worked out here."""

import random

import pytest

from sluicegate.config import Thresholds, duration_ms, expand_env, load_properties
from sluicegate.operators import baseline, checks
from sluicegate.operators.results import is_transient
from sluicegate.sources.topics import TopicLister, listed_topics, preflight, topic_pattern

V, C, T, S = (checks.DEFAULTS[k] for k in ("volume", "cardinality", "type_drift", "schema_drift"))


def level(x, warn, fail):
    return ["ok", "warn", "fail"][(x > warn) + (x > fail)]


@pytest.mark.parametrize("rate", [0.0, 1.2, 2.6, 2.9, 4.8, 5.1, 7.0, 55.0])
def test_volume_against_history(rate):
    history = [6.0, 7.0, 8.0, 7.0, 7.0, 7.0]
    v = checks.volume(round(rate * 20), 20, history, None, V)
    drop = max(0.0, 100 * (1 - rate / 7))
    status = "fail" if rate == 0 else level(drop, 30, 60)
    assert v.status == status and v.value == pytest.approx(rate) and v.sample == v.value
    assert v.threshold == pytest.approx({"ok": 0.0, "warn": 7 * 0.7, "fail": 7 * 0.4}[status])
    assert v.details["drop_pct"] == pytest.approx(drop, abs=0.051) and v.details["baseline_source"] == "recent" and not v.details["warming_up"]


def test_volume_without_history_and_with_a_season():
    few = checks.volume(3, 20, [9.0] * 4, None, V)
    assert (few.status, few.threshold, few.details["warming_up"]) == ("ok", 0.0, True)
    assert checks.volume(0, 20, [], None, V).status == "fail" and checks.volume(0, 20, [], None, V | {"fail_on_zero": False}).status == "ok"
    busy, quiet = [30.0] * 9, [12.0, 14.0]
    assert checks.volume(200, 20, busy, None, V).status == "fail" and checks.volume(200, 20, busy, quiet, V).status == "ok"
    seasonal = checks.volume(80, 20, quiet, busy, V)
    assert seasonal.status == "fail" and seasonal.threshold == pytest.approx(12.0) and seasonal.details["baseline_source"] == "seasonal"


@pytest.mark.parametrize(("estimate", "mean"), [(37, 40), (19, 40), (81, 40), (7, 40), (201, 40), (300, 9), (25, 40), (0, 40)])
def test_cardinality(estimate, mean):
    v = checks.cardinality(float(estimate), [mean - 4.0, mean + 4.0, float(mean), float(mean), float(mean)], C)
    factor = max(estimate / mean, mean / max(estimate, 1)) if mean >= 10 else 1.0
    assert v.status == level(factor, 2, 5) and v.details["factor"] == pytest.approx(factor, abs=0.0051) and v.threshold == {"ok": 0, "warn": 2, "fail": 5}[v.status]
    assert mean < 10 or v.details["direction"] == ("up" if estimate >= mean else "down")
    assert checks.cardinality(float(estimate), [float(mean)] * 4, C).status == "ok"


def test_type_drift():
    tag = {t: k for k, t in enumerate(checks.TAGS)}

    def counts(**n):
        return [n.get(t, 0) for t in checks.TAGS]

    for strings, numbers in ((0, 50), (1, 249), (4, 196), (30, 120), (120, 30)):
        v = checks.type_drift(counts(string=strings, number=numbers), [], T)
        off = min(strings, numbers) / (strings + numbers)
        assert v.value == pytest.approx(off) and v.status == level(off, 0.01, 0.10) and v.sample == tag["number" if numbers > strings else "string"]
    learned = [float(tag["boolean"])] * 6 + [float(tag["string"])] * 3
    v = checks.type_drift(counts(string=18, boolean=2), learned, T)
    assert v.value == pytest.approx(0.9) and v.status == "fail" and v.details["baseline"] == "boolean" and v.sample == tag["string"]
    assert checks.type_drift(counts(), learned, T) is None


def test_schema_drift():
    known = {"sku": [1.0] * 6, "price": [0.9, 1.0, 0.8, 0.9, 1.0], "memo": [0.2] * 6}
    judge = lambda keys, p=S: checks.schema_drift(keys, 400, [0.0] * 6, known, p)
    usual = {"sku": 400, "price": 380}
    assert judge(usual).status == "ok" and judge(usual).extra["memo"] == 0.0 and judge(usual).extra["price"] == 0.95
    more = judge(usual | {"coupon": 20, "blip": 19})
    assert more.details["appeared"] == ["coupon"] and more.status == "warn" and more.value == 1
    less = judge({"sku": 400, "price": 3})
    assert less.details["disappeared"] == ["price"] and less.status == "warn"
    assert judge({"price": 400, "x1": 400, "x2": 300, "x3": 200}).status == "fail"
    assert checks.schema_drift(usual, 400, [0.0] * 4, {}, S).status == "ok" and checks.schema_drift({}, 0, [0.0] * 6, known, S) is None


def test_seasons_by_plain_grouping():
    rng, cycles, seen, keep = random.Random(7), [], {}, 4
    for cycle in range(3, 12):
        assert baseline.season_prior(cycles, cycle) == pytest.approx([sum(seen[c]) / len(seen[c]) for c in sorted(seen)[-keep:]])
        for _ in range(rng.randint(0, 3)):
            x = rng.random()
            seen.setdefault(cycle, []).append(x)
            cycles = baseline.season_push(cycles, cycle, x, keep)
    hour = 3_600_000
    assert baseline.slot_and_cycle(50 * hour + 17, "daily") == (2, 2) and baseline.slot_and_cycle(170 * hour, "weekly") == (2, 1)


def test_fold_learns_from_healthy_windows_only():
    """A plain simulation of a volume series with drops of all lengths; and the fold goes on from its own state."""
    rng = random.Random(9)
    counts = [rng.choice([60, 66, 72, 20, 20, 0, 40]) if rng.random() < 0.4 else 66 for _ in range(150)] + [25] * 30
    for size, after in ((6, 3), (30, 8)):
        kept, bad, want = [], 0, []
        for n in counts:
            base = sum(kept) / len(kept) if kept else 0
            drop = 100 * max(0, 1 - n / 12 / base) if len(kept) >= 5 and base > 0 else 0
            status = "fail" if n == 0 else level(drop, 30, 60)
            bad = 0 if status == "ok" else bad + 1
            if status == "ok" or bad > after:
                kept = [*kept, n / 12][-size:]
            want.append(status)
        rows = [{"check_type": "volume", "n": n, "start_ms": i} for i, n in enumerate(counts)]
        whole, _ = baseline.fold(rows, V, 12, size, after)
        assert [v.status for _, v in whole] == want and {"ok", "warn", "fail"} == set(want)
        state, parts = None, []
        for k in range(0, len(rows), 17):
            out, state = baseline.fold(rows[k : k + 17], V, 12, size, after, state)
            parts += [v.status for _, v in out]
        assert parts == want


def test_configuration():
    t = Thresholds.parse("{history_windows: 12, defaults: {freshness: {warn_p95_ms: 900}, null_rate: {fail: 0.4}}, topics: {web: {null_rate: {fail: 0.6, warn: 0.15}, fields: {url: {required: true, cardinality: true, null_rate: {warn: 0.02}}, ref: {}}}}}")
    asked = [("web", "url", "warn"), ("web", "ref", "warn"), ("web", "url", "fail"), ("app", "url", "fail"), ("app", "url", "warn")]
    assert [t.get(topic, "null_rate", key, 0.07, name) for topic, name, key in asked] == [0.02, 0.15, 0.6, 0.4, 0.07]
    assert t.get("web", "freshness", "warn_p95_ms", 1) == 900 and t.history_windows == 12
    assert t.required("web", "url") and not t.required("web", "ref") and t.cardinality("web", "url") and not t.cardinality("app", "url")
    plain = Thresholds.parse("{}")
    assert (plain.window_ms, plain.disorder_ms, plain.event_time_field, plain.rebaseline_after) == (60_000, 10_000, "ts", 30)
    assert [duration_ms(x) for x in ("250ms", "45s", "7m", "3h")] == [250, 45_000, 420_000, 10_800_000]
    for wrong in ("2w", "fast", "-1s"):
        with pytest.raises(ValueError):
            duration_ms(wrong)
    assert expand_env("${env:HOST:-local}:${env:PORT}", {"PORT": "80"}) == "local:80"
    with pytest.raises(KeyError):
        expand_env("${env:PORT}", {})
    assert load_properties("# comment\nsq.window=5\n\nclient.id=${env:ID:-me}", {"ID": "you"}) == ({"sq.window": "5"}, {"client.id": "you"})
    assert [is_transient(x) for x in ("57P01", "40001", None, "22003", "42P01")] == [True, True, True, False, False]


def test_topics():
    import re

    p = re.compile(topic_pattern("(web|app)_.*", ".*_tmp", "web_dead"))
    assert [t for t in ("web_hits", "app_hits_tmp", "web_dead", "web_dead2", "my_web_hits", "app_x") if p.fullmatch(t)] == ["web_hits", "web_dead2", "app_x"]
    assert listed_topics("web_hits,,  app_x ", ["z"]) == ["web_hits", "app_x"] and listed_topics(" , ", ["z"]) == ["z"]
    answers = [["q9", "q3", "other"], OSError(), ["q4"]]

    def listing():
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    lister = TopicLister(listing, "q[0-9]", 2)
    assert lister.refresh(0) == lister.refresh(1_000) == ["q3", "q9"] and len(answers) == 2
    assert lister.refresh(120_000) == ["q3", "q9"] and not answers[1:]  # a failed listing changes nothing
    with pytest.raises(ValueError):
        preflight(["web_hits"], ["web_hits", "app_x"])


def test_details_round_halves_up():
    assert [checks.half_up(x, 1) for x in (16.25, 16.35, 0.05, 2.0, 16.249)] == [16.3, 16.4, 0.1, 2.0, 16.2]

"""Scenario runs, the anomaly run, resampling and rank tests, by hand and by brute force."""

import datetime
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamwatch.operators import anomaly, climate, scenario, scores

DAY = datetime.date(2020, 1, 1)


def spread(df):
    """Quantiles about the feature x: from x - 0.3 to x + 0.3."""
    return df.withColumns({n: F.col("x") + (l - 0.5) * 0.6 for n, l in zip(climate.NAMES, climate.LEVELS, strict=True)})


def scenario_rows(spark, days=40):
    rows = [(e, DAY + datetime.timedelta(d), None if e == 3 and d == 5 else 1.0, None if e == 4 and d == 6 else (5.0 if e == 6 else 0.9)) for e in range(1, 9) for d in range(days - (e == 2))]
    return spark.createDataFrame(rows, "entity_id long, target_date date, threshold double, x double")


def test_scenario_statuses_and_values(spark):
    levers = [
        scenario.Lever("scaled", "MODEL_PERTURBATION", (1, 2, 3, 4, 6, 8), "x", "scale", 0.2, 0.1, 0.3),
        scenario.Lever("known", "LITERATURE_DIRECT", (5,), magnitude=0.2, low=0.1, high=0.3, covered=0.5),
        scenario.Lever("unknown", "NOT_ESTIMABLE", (7, 8)),
    ]
    settings = scenario.ScenarioSettings(period_days=40)
    got = {r.entity_id: r for r in scenario.run_scenario(scenario_rows(spark), levers, ["x"], spread, climate.NAMES, climate.LEVELS, settings).collect()}
    assert {e: (r.status, r.reason) for e, r in got.items()} == {
        1: ("OK", None), 2: ("INSUFFICIENT_EVIDENCE", "MISSING_DAYS"), 3: ("INSUFFICIENT_EVIDENCE", "NO_THRESHOLD"), 4: ("INSUFFICIENT_EVIDENCE", "NO_FORECAST"),
        5: ("OK", None), 6: ("NOT_ESTIMABLE", "BASELINE_INTERVAL_DEGENERATE"), 7: ("NOT_ESTIMABLE", "NO_ESTIMABLE_LEVER"), 8: ("OK", None),
    }
    cdf = lambda shift, scale=1.0: min(1.0, max(0.0, 0.5 + (1.0 / scale - shift) / 0.6))
    p0, p1 = 1 - cdf(0.9), 1 - cdf(0.72)
    r = got[1]
    assert (r.days, r.complete, r.no_change) == (40, True, False)
    assert r.baseline_days == pytest.approx(40 * p0) and r.scenario_days == pytest.approx(40 * p1) and r.delta_days == pytest.approx(40 * (p1 - p0)) and r.delta_pct == pytest.approx(100 * (p1 / p0 - 1))
    sizes = [scenario.triangular((k + 0.5) / 9, 0.1, 0.2, 0.3) for k in range(9)]
    samples = [40 * (1 - cdf(0.9 * (1 - m))) for m in sizes]
    assert r.delta_least == pytest.approx(min(*samples, 40 * p1) - 40 * p0) and r.delta_most == pytest.approx(max(*samples, 40 * p1) - 40 * p0)

    def counts(p):
        return np.array([math.comb(40, k) * p**k * (1 - p) ** (40 - k) for k in range(41)])

    def bounds(pmf):
        c = np.cumsum(pmf)
        return int(np.argmax(c >= 0.1 - 1e-12)), int(np.argmax(c >= 0.9 - 1e-12))

    low, high = bounds(counts(p0))
    assert (r.baseline_low, r.baseline_high) == (low, high)
    a, b = bounds(np.mean([counts(x / 40) for x in samples], axis=0))
    width = 1.5 * max(b - a, high - low)
    start = max(0.0, min(40 - width, 40 * p1 - width / 2))
    assert (r.scenario_low, r.scenario_high) == (pytest.approx(start), pytest.approx(start + width)) and width > high - low
    assert got[5].scenario_days == pytest.approx(40 * (1 - cdf(0.9, 0.9))) and got[8].complete is False and got[7].baseline_days == pytest.approx(40 * p0) and got[7].scenario_days is None and got[2].baseline_days is None


def test_scenario_levers_without_effect_and_bad_requests(spark):
    rows = scenario_rows(spark).filter("entity_id in (1, 5)")
    none = [scenario.Lever("floor", "MODEL_PERTURBATION", (1,), "x", "floor", 0.5, 0.4, 0.6), scenario.Lever("too_much", "MODEL_PERTURBATION", (5,), "x", "treated", 0.5, 0.4, 0.6, extent=2.0)]
    got = {r.entity_id: r for r in scenario.run_scenario(rows, none, ["x"], spread, climate.NAMES, climate.LEVELS).collect()}
    assert got[1].status == "OK" and got[1].no_change and got[1].delta_days == 0 and got[5].reason == "NO_ESTIMABLE_LEVER"
    run = lambda r, lv: scenario.run_scenario(r, lv, ["x"], spread, climate.NAMES, climate.LEVELS)
    for bad in ([], [none[0], none[0]]):
        with pytest.raises(ValueError):
            run(rows, bad)
    with pytest.raises(ValueError, match="twice"):
        run(rows.unionByName(rows.limit(1)), none)


def test_triangular_quantiles():
    assert scenario.triangular(0.5, 0, 1, 2) == 1 and scenario.triangular(0.125, 0, 1, 2) == 0.5 and scenario.triangular(0.875, 0, 1, 2) == 1.5 and scenario.triangular(0.3, 2, 2, 2) == 2
    for bad in ((0.0, 0, 1, 2), (0.5, 2, 1, 3)):
        with pytest.raises(ValueError):
            scenario.triangular(*bad)


def test_resampling_is_the_multinomial_draw(spark):
    """One bucket: the same draws as numpy makes with the same seeds. Several: as many draws as units, and the same law."""
    rows = [(f"e{i:03d}", float(i % 7), float(1 + i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "entity_id string, num double, den double")
    got = np.array([[r.num, r.den] for r in scores.resampled(df, ["entity_id"], ["num", "den"], 600, 5).orderBy("r").collect()])
    first = np.random.default_rng(5).multinomial(300, [1.0], size=600)[:, 0]
    rng = np.random.default_rng([5, 0])
    values = np.array([r[1:] for r in rows])
    expected = np.concatenate([rng.multinomial(first[i : i + scores.BLOCK], np.full(300, 1 / 300)) @ values for i in range(0, 600, scores.BLOCK)])
    assert np.allclose(got, expected)
    many = df.withColumn("one", F.lit(1.0))
    split = np.array([[r.num, r.den, r.one] for r in scores.resampled(many, ["entity_id"], ["num", "den", "one"], 2000, 9, per_bucket=16).collect()])
    assert (split[:, 2] == 300).all()
    brute = np.random.default_rng(1).integers(0, 300, (4000, 300))
    for k in (0, 1):
        other = values[brute, k].sum(axis=1)
        assert abs(split[:, k].mean() - other.mean()) < 4 * other.std() / 40 and abs(split[:, k].std() / other.std() - 1) < 0.08
    heavy = spark.createDataFrame([(1.0, 3), (2.0, 1)], "v double, n long").withColumn("s", F.col("v"))
    told = [r.s for r in scores.resampled(heavy, ["v"], ["s"], 3000, 2, "n").collect()]
    assert set(told) == {4.0, 5.0, 6.0, 7.0, 8.0} and abs(np.mean(told) - 5.0) < 0.07
    assert scores.resampled(df.limit(0), ["entity_id"], ["num"], 10, 1).count() == 0


def test_bootstrap_of_precision_recall_and_f1(spark):
    rng = random.Random(2)
    det = [(f"e{rng.randrange(40)}", rng.random() < 0.6) for _ in range(300)]
    ev = [(f"e{rng.randrange(40)}", rng.random() < 0.3) for _ in range(200)]
    got = scores.bootstrap_prf(spark.createDataFrame(det, "entity_id string, matched boolean"), spark.createDataFrame(ev, "entity_id string, matched boolean")).first()
    names = sorted({e for e, _ in det + ev})
    table = np.array([[sum(e == n for e, _ in det), sum(e == n and m for e, m in det), sum(e == n for e, _ in ev), sum(e == n and m for e, m in ev)] for n in names])
    draws = table[np.random.default_rng(3).integers(0, len(names), (20000, len(names)))].sum(axis=1)
    p, r = draws[:, 1] / draws[:, 0], draws[:, 3] / draws[:, 2]
    for name, x in (("precision", p), ("recall", r), ("f1", 2 * p * r / (p + r))):
        low, high = np.percentile(x, [2.5, 97.5])
        assert abs(got[f"{name}_low"] - low) < 0.012 and abs(got[f"{name}_high"] - high) < 0.012
    none = scores.bootstrap_prf(spark.createDataFrame([], "entity_id string, matched boolean"), spark.createDataFrame([], "entity_id string, matched boolean")).first()
    assert none.precision_low is None and none.f1_high is None


def test_rank_test_with_ties_equals_the_pairwise_count(spark):
    rng = random.Random(4)
    a, b = [rng.randrange(12) / 4 for _ in range(90)], [rng.randrange(14) / 4 for _ in range(70)]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b] + [("a", None), ("c", 3.0)], "g string, y double")
    got = scores.two_groups(df, "g", "y").first()
    u = sum(1.0 if x > y else 0.5 if x == y else 0.0 for x, y in itertools.product(a, b))
    n = len(a) + len(b)
    ties = sum(t**3 - t for t in (sum(z == v for z in a + b) for v in set(a + b)))
    z = (abs(u - len(a) * len(b) / 2) - 0.5) / math.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
    assert got.mann_whitney_u == u and got.mann_whitney_p == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert got.mean_difference == pytest.approx(np.mean(a) - np.mean(b)) and got.median_difference == np.median(a) - np.median(b)
    assert got.effect == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt((np.var(a, ddof=1) + np.var(b, ddof=1)) / 2))
    draws = np.random.default_rng(0)
    brute = np.array(a)[draws.integers(0, len(a), (20000, len(a)))].mean(axis=1) - np.array(b)[draws.integers(0, len(b), (20000, len(b)))].mean(axis=1)
    low, high = np.percentile(brute, [2.5, 97.5])
    assert abs(got.low - low) < 0.02 and abs(got.high - high) < 0.02 and got.status == ("SHIFT" if low > 0 or high < 0 else "NO_DETECTABLE_SHIFT")
    few = scores.two_groups(df.filter("g = 'a'").unionByName(df.filter("g = 'b'").limit(4)), "g", "y").first()
    assert few.status == "TOO_FEW" and few.n_b == 4 and few.mean_difference is None
    same = scores.two_groups(spark.createDataFrame([(g, 1.0) for g in "ab" * 6], "g string, y double"), "g", "y").first()
    assert same.mann_whitney_p is None and same.effect is None and same.mann_whitney_u == 18 and same.status == "NO_DETECTABLE_SHIFT"


def test_anomaly_run(spark):
    d = lambda k: DAY + datetime.timedelta(k)
    rows = [
        ("a", "v", d(0), "NORMAL", 0.5, False), ("b", "v", d(0), "UNEXPLAINED", 0.99, False), ("c", "v", d(0), "UNEXPLAINED", 0.99, True), ("c", "v", d(9), "UNEXPLAINED", 0.99, False),
        ("a", "v", d(20), "WEATHER_EXPLAINED", 0.9, True), ("b", "v", d(20), None, None, False),
    ]
    labels = spark.createDataFrame(rows, "entity_id string, variable string, target_date date, label string, pit double, event boolean")
    topology = spark.createDataFrame([("a", "b"), ("b", "c")], "upstream_id string, downstream_id string")
    near = {(r.entity_id, r.target_date): r.localised for r in anomaly.localised(labels, topology).collect()}
    assert near == {("b", d(0)): True, ("c", d(0)): False, ("c", d(9)): None}
    r = anomaly.run(labels, topology, replicates=200).first()
    assert (r.normal, r.weather_explained, r.detections, r.events, r.localised) == (1, 1, 3, 2, 1)
    assert r.precision == pytest.approx(1 / 3) and r.recall == 0.5 and r.f1 == pytest.approx(0.4) and 0 <= r.precision_low <= r.precision_high <= 1


def test_anomaly_run_matches_all_variables_at_once(spark, monkeypatch):
    """detections were matched anew for each variable, and for each number that is told of them."""
    d = lambda k: DAY + datetime.timedelta(k)
    rows = [
        ("a", "v", d(0), "NORMAL", 0.5, True), ("b", "v", d(3), "UNEXPLAINED", 0.99, False), ("b", "v", d(7), "UNEXPLAINED", 0.99, True), ("a", "w", d(3), "UNEXPLAINED", 0.99, None),
        ("a", "x", d(3), "NORMAL", 0.5, True), ("a", "y", d(3), "NORMAL", 0.5, False),
    ]
    labels = spark.createDataFrame(rows, "entity_id string, variable string, target_date date, label string, pit double, event boolean")
    topology = spark.createDataFrame([("a", "b")], "upstream_id string, downstream_id string")
    calls, matched = [], anomaly.asof.matched
    monkeypatch.setattr(anomaly.asof, "matched", lambda *a, **k: calls.append(a) or matched(*a, **k))
    for replicates in (0, 100):
        got = {r.variable: r for r in anomaly.run(labels, topology, replicates).collect()}
        assert {v: (r.normal, r.detections, r.events, r.precision, r.recall, r.f1) for v, r in got.items()} == {"v": (1, 2, 2, 1.0, 1.0, 1.0), "w": (0, 1, 0, 0.0, None, None), "x": (1, 0, 1, None, 0.0, None), "y": (1, 0, 0, None, None, None)}
        assert len(calls) == 1 and not calls.clear()
    assert (got["v"].precision_low, got["v"].recall_high, got["w"].precision_high, got["w"].recall_low, got["x"].recall_high, got["y"].f1_low) == (1.0, 1.0, 0.0, None, 0.0, None)
    assert "f1_low" in anomaly.run(labels.limit(0), topology).columns


def test_the_anomaly_run_keeps_no_quantiles_in_its_files(spark, sf, monkeypatch):
    from streamwatch.plans import more_queries

    seen = []
    monkeypatch.setattr(more_queries.anomaly, "run", lambda labels, *_, **__: seen.append(labels.columns) or labels)
    more_queries.fr17_anomaly_run(spark, sf)
    assert seen == [["entity_id", "variable", "target_date", "label", "pit", "event"]]

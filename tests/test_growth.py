"""Ties between equal values, and that work follows the input and not the pairs of its rows."""

import datetime as dt
import math

import duckdb
import numpy as np
from oracle import rows_of
from pyspark.sql import functions as F

from streamwatch.fixtures import FIT_END, view
from streamwatch.functions import scalar
from streamwatch.operators import asof, climate, forest, scenario, spatial
from streamwatch.plans import extra_queries, forecast_queries, library_queries, more_queries, registry, run_queries, series_queries, serving_queries  # noqa: F401
from streamwatch.plans.registry import ORACLES, QUERIES

DAY = dt.datetime(1998, 3, 1)
LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"


def stored(df, folder, name):
    df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def line(order, number=1, price=1000.0, discount=0.01, tax=0.02, day=DAY, supplier=1):
    return (order, 1, supplier, number, 20.0, price, discount, tax, day)


def test_a_share_of_exactly_half_is_not_more_than_half(spark, tmp_path):
    pairs = [(0.01, 0.02), (0.02, 0.01), (0.04, 0.05), (0.05, 0.04), (0.07, 0.07), (0.08, 0.02), (0.02, 0.08)]
    rows = [line(1, i, tax=t, discount=d) for i, (t, d) in enumerate(pairs)]
    for k in range(2, 30):  # other orders of adding the same
        rows += [line(k, i, tax=pairs[(i * 3 + k) % 7][0], discount=pairs[(i * 3 + k) % 7][1], supplier=k) for i in range(7)]
    stored(spark.createDataFrame(rows, LINES), tmp_path, "lineitem")
    got = QUERIES["ag36_wettest_day"](spark, str(tmp_path)).collect()
    assert len(got) == 29 and {(r.share, r.plausible) for r in got} == {(0.5, False)}
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert {r[1:] for r in con.execute(ORACLES["ag36_wettest_day"]).fetchall()} == {(0.5, False)}


def test_equal_sums_are_equal_observations(spark, tmp_path):
    prices = ([100.1, 200.2, 300.3], [300.3, 200.2, 100.1], [600.6])
    rows = [line(d, i, price=p, day=DAY + dt.timedelta(d)) for d, day in enumerate(prices) for i, p in enumerate(day)]
    taxes = ([0.01, 0.02, 0.06], [0.06, 0.02, 0.01], [0.03] * 3)
    rows += [line(d, i, tax=t, discount=t / 2, day=DAY + dt.timedelta(d), supplier=2) for d, day in enumerate(taxes) for i, t in enumerate(day)]
    stored(spark.createDataFrame(rows, LINES), tmp_path, "lineitem")
    obs = view(spark, str(tmp_path), "v_obs")
    assert [r[0] for r in obs.filter("entity_id = 1").select("turbidity_proxy").distinct().collect()] == [0.6006]
    assert obs.filter("entity_id = 2").select("ndci").distinct().count() == 1


def test_customers_are_counted_before_they_meet_suppliers(spark, sf):
    plan = view(spark, sf, "v_exposure")._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner")
    assert "Aggregate" in plan[join:]


def test_one_pass_tells_what_climatology_and_thresholds_tell(spark, sf):
    obs = series_queries.long_obs(spark, sf)
    names = list(climate.NAMES)
    wide = climate.climatology(obs, FIT_END).withColumnRenamed("n_clim", "n").select("entity_id", "variable", "doy", "n", "clim_mean", *names)
    limits = climate.seasonal_thresholds(obs, FIT_END).select("entity_id", "variable", "season", "threshold", "clim_exceed_freq")
    late = obs.filter(F.col("obs_date") > F.lit(FIT_END).cast("date")).withColumns({"doy": F.least(F.dayofyear("obs_date"), F.lit(365)), "season": scalar.season(F.col("obs_date"))})
    expected = late.join(wide, ["entity_id", "variable", "doy"]).filter("n >= 5").join(limits, ["entity_id", "variable", "season"], "left")
    got = climate.with_climatology(obs, FIT_END).filter("n_clim >= 5").withColumnRenamed("n_clim", "n")
    columns = ["entity_id", "variable", "obs_date", "value", "n", "clim_mean", *names, "threshold", "clim_exceed_freq"]
    one, other = (rows_of([tuple(r) for r in registry.rounded(d.select(*columns)).collect()], columns) for d in (got, expected))
    assert len(one) > 100 and one == other


def test_exceedances_read_the_observations_once(spark, sf):
    plan = forecast_queries.exceedances(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_shipdate#") and plan.count("Relation [l_orderkey") == 1


def test_points_are_counted_by_place_and_shape(spark):
    rng = np.random.default_rng(3)
    segments = [(e, float(a), float(b), float(a + 90), float(b + 40)) for e in range(6) for a, b in [((e % 3) * 50, 0), (20, (e % 3) * 30)]]
    points = [(i, float(x), float(y), i % 3) for i, (x, y) in enumerate(np.tile(rng.uniform(-40, 200, (60, 2)), (3, 1)))]

    def distance(s, p):
        _, x1, y1, x2, y2 = s
        t = min(1.0, max(0.0, ((p[1] - x1) * (x2 - x1) + (p[2] - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        return math.hypot(p[1] - x1 - t * (x2 - x1), p[2] - y1 - t * (y2 - y1))

    expected = {}
    for e in range(6):
        for p in points:
            if (d := min(distance(s, p) for s in segments if s[0] == e)) <= 12:
                n, least = expected.get((e, p[3]), (0, math.inf))
                expected[e, p[3]] = (n + 1, min(least, d))
    at = spark.createDataFrame(points, "point_id long, x double, y double, label int")
    got = spatial.near_counts(spark.createDataFrame(segments, "entity_id long, x1 double, y1 double, x2 double, y2 double"), at, 12.0, "label")
    told = {(r.entity_id, r.label): (r.n, round(r.distance, 9)) for r in got.collect()}
    assert told == {k: (n, round(d, 9)) for k, (n, d) in expected.items()} and len(told) > 6


def test_seasonal_naive_is_the_nearest_known_of_the_first_year(spark):
    rng = np.random.default_rng(5)
    d = lambda n: dt.date(1970, 1, 1) + dt.timedelta(int(n))
    obs = [(k, d(n), float(i)) for k in range(3) for i, n in enumerate(rng.choice(3000, 90 + k, replace=False))]
    asked = [(k, d(t - rng.integers(1, 400)), d(t)) for k in range(4) for t in [*rng.integers(0, 3200, 60), 789, 790, 2250]]
    back = lambda x, k: x.replace(year=x.year - k, day=28) if (x.month, x.day) == (2, 29) and (x.year - k) % 4 else x.replace(year=x.year - k)

    def nearest(key, issued, target):
        for k in range(1, 16):
            anchor = back(target, k)
            if near := [(abs((o - anchor).days), o, v) for e, o, v in obs if e == key and abs((o - anchor).days) <= 7 and o <= issued]:
                return min(near)[2]
        return None

    targets = spark.createDataFrame(asked, "e int, issued_date date, target_date date")
    out = asof.seasonal_naive(spark.createDataFrame(obs, "e int, obs_date date, value double"), targets, ["e"])
    assert "_bin" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.e, r.issued_date, r.target_date): r.naive for r in out.collect()}
    assert got == {a: nearest(*a) for a in asked} and any(v is None for v in got.values()) and sum(v is not None for v in got.values()) > 50


def test_leaf_quantiles_are_exact_without_holding_a_leaf(spark):
    rng = np.random.default_rng(8)
    y = np.concatenate([rng.normal(0, 1, 900), np.full(400, 0.25), rng.pareto(1.0, 300)])
    rows = [(int(i % 2), int(i % 7), float(v)) for i, v in enumerate(y)] + [(5, 5, 3.0), (6, 6, 1.0), (6, 6, 2.0)]
    at = spark.createDataFrame(rows, "tree int, node int, y double")
    told = forest.leaf_quantiles(at, float(min(r[2] for r in rows)), float(max(r[2] for r in rows)))
    got = {(r.tree, r.node): r.q for r in told.collect()}
    for key in {r[:2] for r in rows}:
        assert np.allclose(got[key], np.quantile([r[2] for r in rows if r[:2] == key], climate.LEVELS), atol=1e-12)
    assert len(got) == 16
    one = spark.createDataFrame([(0, 0, 4.0)] * 3, "tree int, node int, y double")
    assert forest.leaf_quantiles(one, 4.0, 4.0).first().q == [4.0] * 7


def test_matching_reads_the_labelled_rows_from_files(spark, sf):
    """the forecasts behind detections and events were made again for each place that reads them."""
    for name in ("jn12_event_match", "ag17_precision_recall"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation [l_orderkey" not in plan and "MapInArrow" not in plan


def test_matches_in_bins_of_days_equal_all_pairs(spark):
    rng = np.random.default_rng(11)
    day = lambda k: dt.date(1969, 12, 20) + dt.timedelta(int(k))
    topology = [(2, 1), (3, 1), (4, 2), (5, 4), (6, 5), (1, 1)]
    det, ev = ([(str(rng.integers(2)), int(rng.integers(1, 7)), day(rng.integers(60))) for _ in range(n)] for n in (70, 60))
    kind = "variable string, entity_id long, date date"
    for window, hops in ((0, 0), (3, 3), (4, 1)):
        reach = {e: {e} for e in range(1, 7)}
        for _ in range(hops):
            reach = {e: r | {b for a, b in topology if a in r} for e, r in reach.items()}
        near = lambda e, d: e[0] == d[0] and d[1] in reach[e[1]] and abs((e[2] - d[2]).days) <= window  # noqa: B023, E731
        a, b = asof.matched(spark.createDataFrame(det, kind), spark.createDataFrame(ev, kind), spark.createDataFrame(topology, "upstream_id long, downstream_id long"), window, hops, ["variable"])
        got = [sorted((r.variable, r.entity_id, r.date, r.matched) for r in x.collect()) for x in (a, b)]
        assert got[0] == sorted((*d, any(near(e, d) for e in ev)) for d in det) and got[1] == sorted((*e, any(near(e, d) for d in det)) for e in ev)
        assert len({x[3] for x in got[0]}) == 2


def test_responses_are_forecast_once_a_kind_of_row(spark, sf):
    """rows were read, forecast and joined by their key once as they are and once more for each feature."""
    plan = QUERIES["sc6_response_check"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 9 == 0 else float(rng.integers(4)), float(rng.integers(3)), float(rng.normal())) for i in range(900)]
    df = spark.createDataFrame([(i, a, b, (a or 0.0) - b + y / 9) for i, a, b, y in rows], "i long, a double, b double, y double").cache()
    train, judged = df.filter("i % 3 < 2"), df.filter("i % 3 = 2")
    model = forest.fit(train, ["a", "b"], "y")
    sd = train.agg(*[F.stddev_samp(c).alias(c) for c in "aby"]).first()
    median = lambda d: {r.i: r.p50 for r in forest.predict(model, d, "i").collect()}
    base = median(judged)
    got = {r.feature: r for r in scenario.response_check(train, judged, ["a", "b"], "y").collect()}
    for c, verdict in (("a", "TRUSTED"), ("b", "WRONG_SIGN")):
        moved = median(judged.withColumn(c, F.col(c) + sd[c]))
        d = [(moved[i] - base[i]) / sd["y"] for i in base]
        assert math.isclose(got[c].change, np.mean(d), rel_tol=1e-9) and math.isclose(got[c].share_up, np.mean([x > 0 for x in d])) and got[c].verdict == verdict
    none = scenario.response_check(train, judged.limit(0), ["a", "b"], "y").collect()
    assert sorted(r.feature for r in none) == ["a", "b"] and {(r.change, r.share_up) for r in none} == {(None, None)}

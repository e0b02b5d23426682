"""Cases worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from streamwatch.functions import scalar
from streamwatch.operators import asof, climate, forest, frame, graph, guardrails, probability, ranking, scenario, scores, series, spatial
from streamwatch.sources import payloads, sinks


def days(spark, values, name="precip_mm"):
    return spark.createDataFrame([(1, dt.date(2023, 3, 1) + dt.timedelta(i), None if v is None else float(v)) for i, v in enumerate(values)], f"key int, date date, {name} double")


def column(df, name):
    return [r[0] for r in df.orderBy("date").select(name).collect()]




def w():
    return Window.partitionBy("key").orderBy("date")


def close(a, b):
    return all((x is None and y is None) or (x is not None and y is not None and math.isclose(x, y, abs_tol=1e-9)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("k, rain, expected", [
    (3, [0, 2, 0, 0, 5, 0.5, 0, 10], [None, None, None, 1.62, 1.458, 4.5, 4.5, 4.05]),
    (3, [1, 1, None, 1, 1, 1, 1, 1], [None, None, None, None, None, None, 2.439, 2.439]),
    (7, [10, 0, 0, 0, 0, 0, 0, 0, 0], [None] * 7 + [10 * 0.9**7, 0.0]),
])
def test_antecedent_index(spark, k, rain, expected):
    assert close(column(days(spark, rain).withColumn("a", series.antecedent("precip_mm", w(), k)), "a"), expected)


@pytest.mark.parametrize("rain, expected", [
    ([0, 2, 0, 0, 5, 0.5, 0, 10], [None, None, 0, 1, 2, 0, 1, 2]),
    ([5, 1.0, 0, 0, 0, 0, 0, 0], [None, 0, 0, 1, 2, 3, 4, 5]),
    ([5, 0, None, 0, 0, 5, 0, 0], [None, 0, 1, None, None, None, 0, 1]),
])
def test_dry_days(spark, rain, expected):
    assert column(days(spark, rain).withColumn("d", series.dry_days("precip_mm", "date", w())), "d") == expected


def test_incomplete_day_is_null(spark):
    rows = [("a", dt.datetime(2023, 3, 1, h), 1.0, 10.0) for h in range(24)] + [("a", dt.datetime(2023, 3, 2, h), 1.0, 10.0) for h in range(23)]
    out = series.daily(spark.createDataFrame(rows, "e string, ts timestamp, p double, t double"), "e", "ts", "p", "t").orderBy("date").collect()
    assert (out[0].precip_mm, out[0].precip_duration_h, out[1].precip_mm, out[1].n_hours) == (24.0, 24, None, 23)


def test_upstream_state(spark):
    d = lambda m: dt.date(2023, 6, m)
    obs = spark.createDataFrame([("A", d(2), "OK", 40.0), ("B", d(2), "OK", 20.0), ("B", d(5), "OK", 20.0), ("A", d(4), "CLOUD", 99.0)], "entity_id string, obs_date date, quality_flag string, v double")
    top = spark.createDataFrame([("A", "C"), ("B", "C")], "upstream_id string, downstream_id string")
    area = spark.createDataFrame([("A", 1.0), ("B", 3.0), ("C", 9.0), ("D", 9.0)], "entity_id string, catchment_area_km2 double")
    grid = spark.createDataFrame([(e, d(m)) for e in "CD" for m in range(2, 11)], "entity_id string, date date")
    out = {(r.entity_id, r.date.day): (r.upstream_v, r.upstream_state_flag) for r in asof.upstream_state(obs, top, area, grid, ["v"]).collect()}
    assert [out["C", m][0] for m in (2, 3, 4, 5, 6, 8, 9)] == [None, 25.0, 25.0, 25.0, 20.0, 20.0, None]
    assert out["C", 9][1] == "NO_RECENT_UPSTREAM_OBS" and out["D", 5][1] == "NO_UPSTREAM_REACH"


def test_priorities(spark):
    e = spark.createDataFrame([(x,) for x in "ABXDN"], "entity_id string")
    f = spark.createDataFrame([("A", "t", 0.8, 0.0, 4.0), ("B", "t", 0.8, 0.0, 2.0), ("D", "t", None, 0.0, 4.0), ("X", "t", 0.5, 0.0, 1.0)], "entity_id string, variable string, exceedance_prob double, p10 double, p90 double")
    x = spark.createDataFrame([("A", "s", 3), ("B", "s", 6), ("D", "s", 1), ("N", "s", 1)], "entity_id string, feature_type string, n_features int")
    out = {r.entity_id: r for r in ranking.priorities(e, f, x, {"s": 1.0}).collect()}
    assert math.isclose(out["A"].information_value, 0.8 * math.log(4) / math.log(7)) and math.isclose(out["B"].information_value, 0.4)
    assert (out["A"].rank, out["B"].rank) == (1, 2)
    assert [out[k].reason for k in "XDN"] == ["NO_EXPOSURE", "NO_THRESHOLD", "NO_FORECAST"]


def test_cdf_point_mass_and_tails(spark):
    q = [F.lit(float(x)) for x in (0, 1, 1, 2, 3, 4, 5)]
    at = lambda x: probability.cdf(q, climate.LEVELS, F.lit(float(x)))
    r = spark.range(1).select(*[at(x).alias(f"c{i}") for i, x in enumerate((-10, 0, 1, 1.5, 5, 99))]).first()
    assert close(list(r), [0.0, 0.05, 0.25, 0.375, 0.95, 1.0])
    with pytest.raises(Exception, match="cross"):
        spark.range(1).select(probability.cdf([F.col("id") + 2.0, F.col("id") + 1.0], (0.1, 0.9), F.lit(1.0))).collect()


@pytest.mark.parametrize("age, p, observable, expected", [(0, 0.6, True, "ALERT"), (21, 0.9, True, "ALERT"), (22, 0.9, True, "INSUFFICIENT_EVIDENCE"), (0, 0.59, True, None), (0, 0.9, None, "WATCH"), (0, 0.9, False, "WATCH")])
def test_guardrails(spark, age, p, observable, expected):
    day = dt.date(2024, 5, 1)
    c = spark.createDataFrame([(1, "t", day, p, None, observable, day - dt.timedelta(age), 0, None, None, False)], "entity_id int, variable string, issued date, exceedance_prob double, reason string, observable boolean, last_usable date, n_residuals int, mean_abs_z double, outside_fraction double, cooling boolean")
    r = guardrails.guarded(c).first()
    assert r.severity == expected and (r.withheld_exceedance_prob == p if expected == "INSUFFICIENT_EVIDENCE" else r.exceedance_prob == p)


def test_drift_and_cooldown_end_a_candidate(spark):
    day = dt.date(2024, 5, 1)
    rows = [(1, "t", day, 0.9, None, True, day, 3, 2.6, 0.0, False), (2, "t", day, 0.9, None, True, day, 2, 9.0, 1.0, True)]
    c = spark.createDataFrame(rows, "entity_id int, variable string, issued date, exceedance_prob double, reason string, observable boolean, last_usable date, n_residuals int, mean_abs_z double, outside_fraction double, cooling boolean")
    assert [r.guardrail for r in guardrails.guarded(c).orderBy("entity_id").collect()] == ["drift", "cooldown"]


def test_surprise_is_infinite_at_one(spark):
    r = spark.range(1).select(probability.surprise(F.lit(0.5)), probability.surprise(F.lit(1.0))).first()
    assert math.isclose(r[0], math.log(2)) and math.isinf(r[1])


def test_embargo_hides_what_lies_past_a_fold(spark):
    ends = {"train": "2023-03-05", "val": "2023-03-10"}
    f = frame.with_folds(frame.build(days(spark, range(10)), "key", "precip_mm", "precip_mm", (1, 2)), ends)
    got = {r.date.day: (r.target_h1, r.target_h2) for r in frame.embargoed(f, ends, (1, 2)).collect()}
    assert got[3] == (3.0, 4.0) and got[4] == (4.0, None) and got[5] == (None, None) and got[6] == (6.0, 7.0)
    assert f.filter("date = date'2023-03-05'").first().target_h1 == 5.0  # without the embargo the next fold leaks


def test_thresholds_ignore_what_comes_after_the_fit(spark):
    base = [(1, dt.date(1998, 1, 1) + dt.timedelta(i), "v", float(i)) for i in range(20)]
    late = [(1, dt.date(2001, 1, 1) + dt.timedelta(i), "v", 1e9) for i in range(20)]
    schema = "entity_id int, obs_date date, variable string, value double"
    a = climate.seasonal_thresholds(spark.createDataFrame(base, schema), "1998-12-31").collect()
    assert a == climate.seasonal_thresholds(spark.createDataFrame(base + late, schema), "1998-12-31").collect() and math.isclose(a[0].threshold, 17.1)


def test_poisson_binomial_is_binomial_for_equal_chances(spark):
    p = spark.createDataFrame([(1, 0.3)] * 4 + [(1, None)], "k int, p double")
    out = {r.n_days: r.probability for r in probability.poisson_binomial(p, ["k"], "p").collect()}
    assert close([out[i] for i in range(5)], [math.comb(4, i) * 0.3**i * 0.7 ** (4 - i) for i in range(5)])


def test_mixture_quantiles_invert_the_cdf(spark):
    m = spark.createDataFrame([(1, [0.0, 3.0], [1.0, 0.5], [0.5, 0.2], [0.6, 0.4])], "k int, mu array<double>, b array<double>, tau array<double>, pi array<double>")
    q = probability.mixture_quantiles(m).withColumn("x", F.explode("q")).select(probability.laplace_mixture_cdf(F.col("mu"), F.col("b"), F.col("tau"), F.col("pi"), F.col("x")).alias("c")).collect()
    assert close([round(r.c, 9) for r in q], climate.LEVELS)


def test_matching_within_days_and_hops(spark):
    d = lambda k: dt.date(2024, 1, k)
    top = spark.createDataFrame([(f"R{i}", f"R{i + 1}") for i in range(1, 5)], "upstream_id string, downstream_id string")
    det = spark.createDataFrame([("R1", d(10)), ("R4", d(12)), ("R5", d(10)), ("R1", d(20))], "entity_id string, date date")
    ev = spark.createDataFrame([("R1", d(10))], "entity_id string, date date")
    a, b = asof.matched(det, ev, top)
    assert {(r.entity_id, r.date.day): r.matched for r in a.collect()} == {("R1", 10): True, ("R4", 12): True, ("R5", 10): False, ("R1", 20): False}
    r = scores.prf(a, b).first()
    assert (r.precision, r.recall) == (0.5, 1.0)


def test_strahler_and_cycles(spark):
    top = spark.createDataFrame([(1, 3), (2, 3), (3, 5), (4, 5), (6, 7), (7, 6)], "upstream_id long, downstream_id long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "entity_id long")
    out = {r.entity_id: (r.strahler_order, r.cycle_broken) for r in graph.strahler(top, nodes).collect()}
    assert [out[i][0] for i in range(1, 6)] == [1, 1, 2, 1, 2] and out[6] == (1, True)


def test_nearest_point_on_a_line(spark):
    seg = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 0.0)], "entity_id int, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(1, 10.0, 180.0), (2, 500.0, -240.0), (3, 500.0, 260.0)], "point_id int, x double, y double")
    assert {r.point_id: r.distance for r in spatial.near_lines(seg, pts, 250.0).collect()} == {1: 180.0, 2: 240.0}


def test_assimilation_uses_no_later_observation(spark):
    d = lambda k: dt.date(2024, 1, k)
    left = spark.createDataFrame([(1, d(10)), (1, d(4))], "k int, issued date")
    right = spark.createDataFrame([(1, d(5), 1.0), (1, d(10), 2.0), (1, d(11), 3.0)], "k int, obs date, r double")
    assert {r.issued.day: r.r for r in asof.backward(left, right, ["k"], "issued", "obs", ["r"]).collect()} == {10: 2.0, 4: None}


def test_upsert_changes_listed_columns_only(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    new = spark.createDataFrame([(2, "z", 9), (3, "n", 3)], "k int, x string, y int")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"], ["x"]).collect()), key=str) == [(1, "a", 1), (2, "z", 2), (3, "n", None)]


def test_repeated_key_raises(spark):
    with pytest.raises(Exception, match="repeated key"):
        payloads.assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"]).collect()


def test_forest_quantiles_are_ordered_and_fit(spark):
    rows = spark.range(2000).select(F.col("id").alias("row_id"), (F.rand(1) * 10).alias("a"), F.when(F.rand(2) > 0.2, F.rand(3)).alias("b")).withColumn("y", F.col("a") + F.rand(4))
    m = forest.fit(rows, ["a", "b"], "y")
    out = forest.predict(m, rows, "row_id").join(rows, "row_id")
    r = out.select(F.min(F.least(F.col("p10") - F.col("p05"), F.col("p90") - F.col("p50"))).alias("d"), F.avg((F.abs(F.col("y") - F.col("p50")) < 1.5).cast("double")).alias("near")).first()
    assert r.d >= 0 and r.near > 0.9


def test_widened_interval_is_moved_into_range(spark):
    low, high = scenario.widened(F.lit(1.0), F.lit(10.0), 1.5, 0.0, 365.0)
    assert tuple(spark.range(1).select(low, high).first()) == (0.0, 15.0)


def test_low_flow_keeps_nulls(spark):
    r = spark.range(1).select(scalar.low_flow(F.lit(20.0), F.lit(None).cast("double"), F.lit(10.0)), scalar.low_flow(F.lit(20.0), F.lit(30.0), F.lit(10.0))).first()
    assert tuple(r) == (None, 0.0)


@pytest.mark.parametrize("parts", [1, 7])
def test_result_does_not_depend_on_partitions(spark, sf, parts):
    from streamwatch.fixtures import view

    obs = view(spark, sf, "v_obs").repartition(parts)
    c = climate.seasonal_thresholds(climate.long_observations(obs), "1998-12-31").agg(F.count("*"), F.round(F.sum("threshold"), 6)).first()
    assert tuple(c) == tuple(climate.seasonal_thresholds(climate.long_observations(view(spark, sf, "v_obs")), "1998-12-31").agg(F.count("*"), F.round(F.sum("threshold"), 6)).first())


def test_cooldown_suppresses_within_72_hours(spark, tmp_path):
    from streamwatch.streaming import daily

    at = lambda d, h=0: dt.datetime(2024, 1, d, h)
    rows = [(1, at(1), "ALERT"), (1, at(3, 23), "WATCH"), (1, at(4), "ALERT"), (2, at(2), "INSUFFICIENT_EVIDENCE"), (2, at(3), "ALERT")]
    a = spark.createDataFrame(rows, "entity_id long, issued_at timestamp, severity string")
    a.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = daily.cooled(spark.readStream.schema(a.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("cooled").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.suppressed for r in spark.table("cooled").orderBy("entity_id", "issued_at").collect()] == [False, True, False, False, False]


def test_chains_of_pass_through_entities(spark):
    from streamwatch.operators import network

    top = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 4), (4, 5), (20, 21), (21, 22), (22, 20)], "upstream_id long, downstream_id long")
    got = {r.entity_id: (r.chain_id, r.place) for r in network.chains(top).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5, 9)] == [(1, 0), (1, 1), (1, 2), (4, 0), (4, 1), (9, 0)] and got[21] == (20, None)


def test_isotonic_needs_events(spark):
    from streamwatch.operators import calibration

    rows = spark.range(400).select(F.lit("v").alias("variable"), (F.col("id") / 400).alias("exceedance_prob"), (F.rand(1) < F.col("id") / 800).alias("event"))
    out = calibration.isotonic(rows, rows, ["variable"]).agg(F.avg("calibrated_prob"), F.avg(F.col("event").cast("double")), F.max("calibration_note")).first()
    assert abs(out[0] - out[1]) < 0.02 and out[2] is None
    few = calibration.isotonic(rows.limit(5), rows, ["variable"]).agg(F.max("calibration_note"), F.max(F.abs(F.col("calibrated_prob") - F.col("exceedance_prob")))).first()
    assert tuple(few) == ("INSUFFICIENT_EVENTS", 0.0)


def test_as_issued_features_use_the_run_from_the_issue_day_on(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
    archive = spark.createDataFrame([(0, day(i), 1.0 if i < 7 else 99.0) for i in range(12)], "cell_id int, date date, precip_mm double")
    run = spark.createDataFrame([(0, day(i), 2.0) for i in range(7, 10)], "cell_id int, date date, precip_mm double")
    got = {r.horizon: r for r in series.as_issued(archive, run, spark.createDataFrame([(0, day(7))], "cell_id int, issued date"), 4).collect()}
    assert math.isclose(got[1].api_7, 2 * 0.9 + sum(0.9**i for i in range(2, 8))) and got[2].precip_fut_cum == 4.0 and got[3].precip_fut_cum is None


def test_chains_deeper_than_64_levels_and_cycles(spark):
    n = 70
    edges = [(i, i + 1) for i in range(1, n)] + [(1001, 1002), (1002, 1001), (1002, 1003), (1004, 1003)]
    top = spark.createDataFrame(edges, "upstream_id long, downstream_id long").coalesce(1).cache()
    nodes = spark.createDataFrame([(i, float(i)) for i in [*range(1, n + 1), *range(1001, 1005)]], "entity_id long, a double").coalesce(1).cache()
    total = {r.entity_id: r.contributing for r in graph.contributing(top, nodes, "a").collect()}
    assert total == {i: i * (i + 1) / 2 for i in range(1, n + 1)} | {1001: None, 1002: None, 1003: None, 1004: 1004.0}
    order = {r.entity_id: (r.strahler_order, r.cycle_broken) for r in graph.strahler(top, nodes).collect()}
    assert order == {i: (1, False) for i in [*range(1, n + 1), 1004]} | {i: (1, True) for i in (1001, 1002, 1003)}


def test_segments_of_an_order(spark):
    top = spark.createDataFrame([(4, 2), (5, 2), (6, 3), (7, 3), (2, 1), (3, 1), (8, 9), (9, 8)], "upstream_id long, downstream_id long")
    nodes = spark.createDataFrame([(k,) for k in range(1, 11)], "entity_id long")
    orders = graph.strahler(top, nodes)
    assert sorted((r.entity_id, r.strahler_order) for r in graph.of_order(nodes, orders, 2).collect()) == [(1, 3), (2, 2), (3, 2)]
    assert graph.of_order(nodes, orders, 1).count() == 10 and graph.of_order(nodes.limit(0), orders, 4).count() == 0
    with pytest.raises(ValueError):
        graph.of_order(nodes, orders, 4)


def test_order_query_against_a_walk(spark, sf):
    from streamwatch.fixtures import view
    from streamwatch.plans.registry import QUERIES

    ids = [r.entity_id for r in view(spark, sf, "v_reaches").collect()]
    children = {k: [c for c in ids if c // 2 == k and c != k] for k in ids}

    def order(k):
        below = [order(c) for c in children[k]]
        return 1 if not below else max(below) + (below.count(max(below)) > 1)

    got = {r.entity_id: r.strahler_order for r in QUERIES["gr4_of_order"](spark, sf).collect()}
    assert got == {k: order(k) for k in ids if order(k) >= 2}


def mixture(spark, rows):
    return spark.createDataFrame(rows, "k int, mu array<double>, b array<double>, tau array<double>, pi array<double>")


def test_mixture_mean_rescaled_and_ensemble(spark):
    a = mixture(spark, [(1, [3.0, 5.0], [1.0, 1.0], [0.5, 0.5], [1.0, 3.0]), (2, [0.0], [2.0], [0.25], [1.0])])
    columns = [F.col(c) for c in ("mu", "b", "tau", "pi")]
    mean = lambda df: {r[0]: r[1] for r in df.select("k", probability.mixture_mean(*columns)).collect()}
    assert close(mean(a).values(), [4.5, 2 * 0.5 / 0.1875])  # weights are normalised
    assert close(mean(probability.rescaled(a, 10.0, 2.0)).values(), [19.0, 10 + 2 * 2 * 0.5 / 0.1875])
    both = probability.ensemble([a, mixture(spark, [(1, [0.5], [1.0], [0.5], [2.0])])], "k")
    assert mean(both) == {1: 2.5}  # key 2 has one member only
    assert both.select(F.size("mu"), "pi").first() == (3, [0.125, 0.375, 0.5])
    with pytest.raises(ValueError):
        probability.rescaled(a, 0.0, 0.0)
    with pytest.raises(ValueError):
        probability.ensemble([], "k")


def test_bank_intervals(spark):
    px = '{"sampleCount": 11, "noDataCount": 1, "cloud": "0.2", "usable": "0.8", "land": "%s"}'
    item = lambda day, land: '{"from": "2023-03-0%d", "outputs": {"px": %s, "rx": {"mean": "0.1"}}}' % (day, px % land)  # noqa: E731, UP031
    text = '{"data": [%s, %s, {"from": "2023-03-03"}, {"from": "2023-03-04", "error": "x"}], "failed": [{"from": "2023-03-05"}]}' % (item(1, "0.5"), item(2, "0"))  # noqa: UP031
    good, bad = payloads.bank_intervals(spark.createDataFrame([(1, text), (2, '{"data": []}')], "e int, p string"), "p")
    assert [tuple(r)[2:] for r in good.orderBy("obs_date").collect()] == [(10, 2, 8, 5, 0.2), (10, 2, 8, 0, None), (0, None, None, None, None)]
    assert [r.obs_date.day for r in bad.orderBy("obs_date").collect()] == [4, 5]


def test_two_forecasters_and_a_baseline(spark):
    names = probability.NAMES
    row = lambda g, y, a, b, c: (g, y, *[a] * 7, *[b] * 7, c)
    schema = "g string, target double, " + ", ".join(f"a_{n} double" for n in names) + ", " + ", ".join(f"b_{n} double" for n in names) + ", clim double"
    df = spark.createDataFrame([row("x", 1.0, 3.0, 2.0, 5.0), row("x", 1.0, 3.0, 2.0, 5.0), row("y", 1.0, 1.0, 1.0, 1.0)], schema)
    out = {r.g: r for r in scores.compared(df, ["g"], "a_", "b_", "clim").collect()}
    assert out["x"].n == 2 and math.isclose(out["x"].skill_a, 0.5) and math.isclose(out["x"].crps_a, 2 * out["x"].crps_b) and out["x"].mae_clim == 4.0
    assert (out["y"].skill_a, out["y"].skill_clim, out["y"].coverage_a) == (None, None, 1.0)


def test_calibration_by_weather_falls_back(spark):
    row = lambda v, w: ("ndci", v, w, 2, True, *[float(i) for i in range(7)])
    rows = spark.createDataFrame([row("A", "ORACLE"), row("A", "LIVE"), row("A", "OTHER"), row("B", "LIVE")], "variable string, variant string, weather string, horizon int, observable boolean, " + ", ".join(f"{n} double" for n in probability.NAMES))
    fits = lambda *w: spark.createDataFrame([(x, "ndci", "1-3", "observable", q) for x, q in w], "weather string, variable string, bucket string, obs_class string, q_adjust double")
    got = lambda f: {(r.variant, r.weather): (r.fit_weather, r.p05, r.p95) for r in probability.apply_by_weather(rows, f).collect()}
    assert got(fits(("ORACLE", 1.0), ("ASISSUED", 2.0))) == {("A", "ORACLE"): ("ORACLE", -1.0, 7.0), ("A", "LIVE"): ("ASISSUED", -2.0, 8.0), ("A", "OTHER"): ("ORACLE", -1.0, 7.0), ("B", "LIVE"): (None, 0.0, 6.0)}
    assert got(fits(("ORACLE", 1.0)))["A", "LIVE"] == ("ORACLE", -1.0, 7.0)


def test_sensitivity(spark):
    rows = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 4).alias("entity_id"), (F.col("id") / 2.0).alias("x"), (F.col("id") % 7).cast("double").alias("z"), (F.col("id") * 3.0).alias("y"))
    models = {"A": forest.fit(rows, ["x", "z"], "y"), "B": forest.fit(rows, ["z"], "y")}
    out = {r.variant: r for r in scenario.sensitivity(models, rows, "x", 20.0, 100.0, "k").collect()}
    assert (out["A"].status, out["A"].n, out["A"].share_up, out["A"].share_down) == ("OK", 4, 1.0, 0.0) and out["A"].median_change > 0
    assert (out["B"].status, out["B"].n) == ("NOT_A_FEATURE", None)
    still = scenario.sensitivity({"A": models["A"]}, rows, "x", 0.0, 100.0, "k").first()
    assert (still.share_up, still.share_down, still.median_change) == (0.0, 0.0, 0.0)


def test_catalogue_and_store(spark):
    levers = spark.createDataFrame([(1, 5.0), (2, 6.0)], "lever_id int, cost double")
    responses = spark.createDataFrame([(1, "v", 0.5), (2, "v", -0.5)], "lever_id int, variable string, change double")
    known = spark.createDataFrame([(2, "v", 0.3, "c")], "lever_id int, variable string, coefficient double, citation string")
    out = {(r.lever_id, r.variable): (r.verdict, r.path) for r in scenario.catalogue(levers, ["v", "w"], responses, known).collect()}
    assert out == {(1, "v"): ("TRUSTED", "MODEL_PERTURBATION"), (2, "v"): ("WRONG_SIGN", "LITERATURE_DIRECT"), (1, "w"): (None, "NOT_ESTIMABLE"), (2, "w"): (None, "NOT_ESTIMABLE")}
    applied = spark.createDataFrame([(7, 1, "v", 2, 0.1), (7, 1, "v", 2, 0.2), (7, 1, "v", 9, 0.3)], "scenario_id int, entity_id int, variable string, lever_id int, effect double")
    row = scenario.stored(applied, known.select("lever_id", "citation")).first()
    assert math.isclose(row.effect, 0.6) and row.citations == ["c"]


def test_dry_run_is_handed_over_at_the_splice(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
    # the archive: wet on day 2, dry until the issue on day 7 (its count there is 4), and what it says from then on isn't read
    archive = spark.createDataFrame([(c, day(i), 5.0 if i == 2 or i >= 7 else 0.0 if c < 3 or i != 5 else None) for c in range(4) for i in range(12)], "cell_id int, date date, precip_mm double")
    told = {0: [0, 0, 0, 0], 1: [0, 3, 0, 0], 2: [0, None, 2, 0], 3: [0, 0, 1.0, 0]}
    run = spark.createDataFrame([(c, day(7 + k), None if p is None else float(p)) for c, ps in told.items() for k, p in enumerate(ps)], "cell_id int, date date, precip_mm double")
    issues = spark.createDataFrame([(c, day(7)) for c in told], "cell_id int, issued date")
    got = {(r.cell_id, r.horizon): r.antecedent_dry_days for r in series.as_issued(archive, run, issues, 5).collect()}
    assert [got[0, h] for h in (1, 2, 3, 4, 5)] == [5, 6, 7, 8, None]  # a day beyond the run is missing
    assert [got[1, h] for h in (1, 2, 3, 4)] == [5, 0, 1, 2]
    assert [got[2, h] for h in (1, 2, 3, 4)] == [5, None, 0, 1]
    assert [got[3, h] for h in (1, 2, 3, 4)] == [None, None, 0, 1]  # a gap before the splice: the archive's count is unknown


def test_newest_run_is_one_version(spark):
    from streamwatch.operators import ranking

    rows = [("a", 1, "2024-01-01", 5, "v1"), ("a", 2, "2024-01-02", 3, "v1"), ("a", 3, "2024-01-02", 4, "v2"), ("a", 4, "2024-01-02", 1, "v2"), ("b", 5, "2024-01-01", 1, "v1"), ("c", 6, "2024-01-01", 1, "v1"), ("c", 7, "2024-01-01", 1, "v2")]
    df = spark.createDataFrame(rows, "city string, entity_id int, issued_date string, created_at int, model_version string")
    assert sorted(r.entity_id for r in ranking.latest_run(df, ["city"]).collect()) == [3, 4, 5, 7]


def test_alerts_refuse_forecasts_of_another_run(spark):
    from streamwatch.operators import guardrails

    df = spark.createDataFrame([(1, "2024-01-01", "m", "LIVE", 0.5), (2, "2024-01-01", "n", "LIVE", 0.5)], "entity_id int, d string, model_version string, weather string, exceedance_prob double").withColumn("issued_date", F.to_date("d"))
    assert guardrails.of_one_run(df.filter("entity_id = 1"), "2024-01-01", "m", "LIVE").first().exceedance_prob == 0.5
    for issued, weather in (("2024-01-01", "LIVE"), ("2024-01-02", "LIVE"), ("2024-01-01", "ORACLE")):
        with pytest.raises(Exception, match="a forecast of another run: 2024-01-01"):
            guardrails.of_one_run(df, issued, "m", weather).agg(F.max("exceedance_prob")).collect()

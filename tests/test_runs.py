"""Training, production and evaluation runs, by hand."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from streamwatch.operators import climate, scores, training

SETTINGS = training.Settings(trees=2, depth=3, least_rows=50)
FOLDS = [training.Fold("one", "2020-06-30", "2020-12-31")]
VARIANTS = {"A": ["x", "precip_fut", "precip_fut_cum"], "B": ["precip_fut", "precip_fut_cum"]}
DRIVERS, KEYS = ["precip_fut", "precip_fut_cum"], ["issued_date", "horizon"]


@pytest.fixture(scope="module")
def long(spark):
    rng, rows, day = random.Random(1), [], datetime.date(2020, 1, 1)
    for i in range(366):
        for e in ("a", "b"):
            for h, bucket in ((1, "1-3"), (5, "4-7")):
                issued = day + datetime.timedelta(i)
                x, p = rng.random(), rng.random()
                rows.append((e, issued, issued + datetime.timedelta(h), h, bucket, 2 * x + p, x, p, p if i % 9 else None))
    return spark.createDataFrame(rows, "entity_id string, issued_date date, target_date date, horizon int, bucket string, target double, x double, precip_fut double, precip_fut_cum double").cache()


def issued(long, days):
    return long.filter(days).select(*KEYS, F.lit(0.5).alias("precip_fut"), F.lit(1.0).alias("precip_fut_cum")).distinct()


def test_training_run_and_stored_fits(spark, long, tmp_path):
    run = issued(long, F.dayofmonth("issued_date") <= 10)
    fits, made = training.training_run(long, FOLDS, VARIANTS, DRIVERS, run, KEYS, str(tmp_path), SETTINGS)
    report = {(r.fit, r.bucket): r for r in training.run_report(spark, fits, made).collect()}
    assert sorted(report) == sorted((f"{v}.{f}", b) for v in "AB" for f in ("one", "production") for b in ("1-3", "4-7"))
    one = report["A.one", "4-7"]
    judged = long.filter("bucket = '4-7' and issued_date > '2020-06-30' and target_date <= '2020-12-31'")
    assert one.n_train == long.filter("bucket = '4-7' and target_date <= '2020-06-30'").count()
    assert one.eval_forecasts == judged.count() and one.eval_forecasts_asissued == judged.filter("day(issued_date) <= 10").count() and one.quantiles_crossed == 0
    assert report["B.production", "1-3"].n_train == long.filter("bucket = '1-3'").count() and report["B.production", "1-3"].eval_forecasts == 0
    assert len({r.version for r in report.values()}) == 8
    # a stored fit forecasts as the one that was stored
    fit = next(f for f in fits if f.name == "A.one" and f.bucket == "1-3")
    again = training.load(spark, str(tmp_path), fit.version)
    told = lambda f: sorted(tuple(r) for r in training.forecasts(f, judged.withColumn("bucket", F.lit("1-3")), "ORACLE", DRIVERS).select("entity_id", "issued_date", *climate.NAMES).collect())
    assert told(again) == told(fit) and (again.n_train, again.train_end, again.version) == (fit.n_train, fit.train_end, fit.version)


def test_versions_follow_the_content(long):
    rows = long.filter("bucket = '1-3' and target_date <= '2020-06-30'")
    fit = lambda r, features=("x",), s=SETTINGS: training.fitted(r, features, "A.one", "A", "1-3", "2020-06-30", s).version
    first = fit(rows)
    assert fit(rows.orderBy(F.rand(3))) == first
    changed = rows.withColumn("x", F.when((F.col("entity_id") == "a") & (F.col("issued_date") == "2020-02-02"), F.col("x") + 1e-9).otherwise(F.col("x")))
    assert len({first, fit(changed), fit(rows, ("x", "precip_fut")), fit(rows, s=training.Settings(trees=3, depth=3, least_rows=50)), fit(rows.limit(150))}) == 5


def test_fits_are_refused(long):
    rows = long.filter("bucket = '1-3'")
    with pytest.raises(ValueError, match="after the end of training"):
        training.fitted(rows, ["x"], "A.one", "A", "1-3", "2020-06-30", SETTINGS)
    with pytest.raises(ValueError, match="fewer than"):
        training.fitted(rows.filter("target_date <= '2020-06-30'").limit(49), ["x"], "A.one", "A", "1-3", "2020-06-30", SETTINGS)


def test_production_is_live_oracle_or_refused(spark, long, tmp_path):
    fits = training.production_fits(long, "A", VARIANTS["A"], str(tmp_path), SETTINGS)
    day = long.filter("issued_date = '2020-12-22'").withColumn("target", F.lit(None).cast("double"))
    versions, to = [f.version for f in fits], fits[0].train_end
    made = lambda rows, run: training.produced(spark, str(tmp_path), versions, to, rows, run, KEYS, DRIVERS).collect()
    whole = made(day, issued(long, F.col("issued_date") == "2020-12-22"))
    assert len(whole) == 4 and {(r.weather, r.reason, r.future_drivers_missing, r.precip_fut) for r in whole} == {("LIVE", None, 0, 0.5)}
    assert all(r.p05 <= r.p50 <= r.p95 for r in whole)
    nulls = day.withColumn("precip_fut", F.lit(None).cast("double"))
    expected = {1 + (r.precip_fut_cum is None) for r in day.collect()}
    for run in (None, issued(long, F.col("issued_date") == "2020-12-21")):
        none = made(nulls, run)
        assert {r.weather for r in none} == {"ORACLE"} and {r.future_drivers_missing for r in none} == expected and all(r.p50 is not None for r in none)
    part = made(day, issued(long, (F.col("issued_date") == "2020-12-22") & (F.col("horizon") == 1)))
    assert sorted((r.horizon, r.reason, r.weather, r.p50) for r in part) == [(1, "RUN_INCOMPLETE", None, None)] * 2 + [(5, "NOT_IN_RUN", None, None)] * 2
    with pytest.raises(ValueError, match="one issue date"):
        made(long.filter("issued_date >= '2020-12-21'"), None)
    with pytest.raises(ValueError, match="train again"):
        training.produced(spark, str(tmp_path), versions, "2021-06-01", day, None, KEYS, DRIVERS)
    with pytest.raises(ValueError, match="no fit for"):
        training.production(fits[:1], day, None, KEYS, DRIVERS)
    with pytest.raises(ValueError, match="one variant"):
        training.production([training.fitted(long.filter("bucket = '1-3'"), ["x"], "A.one", "A", "1-3", "2021-12-31", SETTINGS)], day.filter("horizon = 1"), None, KEYS, DRIVERS)


def test_evaluation_refuses_a_changed_frame_and_an_empty_fold(spark, long):
    made = spark.createDataFrame([("one", 1.0)], "fold string, p50 double")
    frame = training.fingerprint(long, long.columns)
    assert training.fingerprint(long.orderBy(F.rand(1)), long.columns) == frame
    changed = training.fingerprint(long.withColumn("x", F.when(F.col("issued_date") == "2020-03-03", F.lit(0.0)).otherwise(F.col("x"))), long.columns)
    with pytest.raises(ValueError, match="trained on"):
        training.evaluated(made, frame, changed, ["one"])
    with pytest.raises(ValueError, match="two"):
        training.evaluated(made, frame, frame, ["one", "two"])
    assert training.evaluated(made, frame, frame, ["one"]).count() == 1


def test_score_cube_compares_on_common_rows(spark):
    """A row without a seasonal value counts for the model's own scores only; a point's CRPS is its error."""
    q = lambda m: [float(m)] * 7
    rows = [("f", "v", 1, "b", "o", 1, 10.0, *q(8), *q(7), 13.0), ("f", "v", 1, "b", "o", 1, 10.0, *q(10), *q(10), None), ("f", "v", 2, "b", "o", 2, None, *q(1), *q(1), 1.0)]
    names = ", ".join(f"{p}{n} double" for p in ("", "clim_") for n in climate.NAMES)
    df = spark.createDataFrame(rows, f"fold string, variable string, horizon int, bucket string, obs_class string, entity_id int, target double, {names}, naive double")
    cube = scores.score_cube(df)
    r = cube.filter("gid = 15").first()
    assert (r.n, r.n_common, r.mae_all, r.mae, r.mae_naive, r.mae_clim) == (2, 1, 1.0, 2.0, 3.0, 3.0)
    weight = sum(2 * w * l for w, l in zip(scores.crps_weights(), climate.LEVELS, strict=True))
    assert r.crps == pytest.approx(2 * weight) and r.crps_clim == pytest.approx(3 * weight) and r.crps_all == pytest.approx(weight)
    assert r.skill_mae_naive == pytest.approx(1 / 3) and r.skill_crps_naive == pytest.approx(1 - 2 * weight / 3) and r.skill_crps_clim == pytest.approx(1 / 3)
    worse = df.withColumn("naive", F.lit(10.5))
    lost = {(x.comparison, x.gid) for x in scores.losses(scores.score_cube(worse)).collect()}
    assert {c for c, g in lost if g == 15} == {"skill_mae_naive", "skill_crps_naive"}

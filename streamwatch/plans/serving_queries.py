"""Bank payloads, mixtures, calibration by weather, sensitivity, and what is served of levers, scenarios and priorities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import FIT_END, VAL_END, table, view, with_views
from ..operators import forest, probability, ranking, scenario
from ..sources import payloads, sinks
from .forecast_queries import BASE, CLIM, EXC, FC, LONG, PRIORITY, SCORE, THR, WEIGHTS, WRITTEN, exceedances, forecasts, mixtures, written
from .frame_queries import forest_rows
from .more_queries import scratch
from .registry import query, rounded

LATEST = WRITTEN.format(rows="exc")


@query(with_views("v_obs") + """SELECT entity_id, obs_date, 'OK' AS status, CASE WHEN water_pixel_count % 5 = 0 THEN 0 ELSE water_pixel_count - 1 END AS n_data, CASE WHEN water_pixel_count % 5 <> 0 THEN CAST(round(0.25 * (water_pixel_count - 1)) AS BIGINT) END AS n_cloud,
CASE WHEN water_pixel_count % 5 <> 0 THEN CAST(round(0.75 * (water_pixel_count - 1)) AS BIGINT) END AS n_usable, CASE WHEN water_pixel_count % 5 <> 0 THEN CAST(round(0.5 * (water_pixel_count - 1)) AS BIGINT) END AS n_land,
round(CASE WHEN water_pixel_count % 5 <> 0 AND round(0.5 * (water_pixel_count - 1)) > 0 THEN CAST(0.1 AS DOUBLE) * (water_pixel_count - 1) / round(0.5 * (water_pixel_count - 1)) END, 6) + 0.0 AS ndvi FROM v_obs WHERE quality_flag <> 'CLOUD'
UNION ALL SELECT entity_id, obs_date, 'FAILED', NULL, NULL, NULL, NULL, NULL FROM v_obs WHERE quality_flag = 'CLOUD'""")
def src4_bank_payload(spark, sf_dir):
    o = view(spark, sf_dir, "v_obs")
    px = F.struct(F.col("water_pixel_count").alias("sampleCount"), F.lit(1).alias("noDataCount"), F.lit("0.25").alias("cloud"), F.lit("0.75").alias("usable"), F.lit("0.5").alias("land"))
    outputs = F.when(F.col("water_pixel_count") % 5 != 0, F.struct(px.alias("px"), F.struct(F.lit("0.1").alias("mean")).alias("rx")))
    failed = F.col("quality_flag") == "CLOUD"
    early = failed & (F.col("entity_id") % 2 == 0)  # half of the failed days come as intervals with an error
    item = F.struct(F.col("obs_date").cast("string").alias("from"), F.when(failed, "failed").alias("error"), outputs.alias("outputs"))
    p = o.groupBy("entity_id").agg(F.to_json(F.struct(F.collect_list(F.when(~failed | early, item)).alias("data"), F.collect_list(F.when(failed & ~early, F.struct(F.col("obs_date").cast("string").alias("from")))).alias("failed"))).alias("payload"))
    good, bad = payloads.bank_intervals(p, "payload")
    return rounded(good.withColumn("status", F.lit("OK")).unionByName(bad.withColumn("status", F.lit("FAILED")), allowMissingColumns=True))


def _ald(x: str, mu: str, b: float, tau: float) -> str:
    z = f"(({x} - {mu}) / {b})"
    return f"CASE WHEN {z} < 0 THEN {tau} * exp({1 - tau!r} * {z}) ELSE 1 - {1 - tau!r} * exp(-{tau} * {z}) END"


def _cdf(x: str) -> str:
    return f"(0.7 * ({_ald(x, 'x', 0.5, 0.5)}) + 0.3 * ({_ald(x, '2.0', 0.3, 0.2)}))"


@query(f"""WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) / 100000 AS x FROM orders), m AS (SELECT *, 0.7 * x + 0.3 * (2.0 + CAST(0.3 AS DOUBLE) * 0.6 / 0.16) AS m FROM o)
SELECT o_orderkey, round((m + 1 + 2 * m) / 2, 6) + 0.0 AS mean, round(({_cdf('1.5')} + {_cdf('0.25')}) / 2, 6) + 0.0 AS cdf FROM m""")
def pr6_mixture_ensemble(spark, sf_dir):
    """The ensemble of each mixture and of the same at twice the scale, one further up: its mean, and its distribution at 1.5."""
    m = mixtures(spark, sf_dir)
    e = probability.ensemble([m, probability.rescaled(m, 1.0, 2.0)], "o_orderkey")
    columns = [F.col(c) for c in ("mu", "b", "tau", "pi")]
    return rounded(e.select("o_orderkey", probability.mixture_mean(*columns).alias("mean"), probability.laplace_mixture_cdf(*columns, F.lit(1.5)).alias("cdf")))


WEATHER = "CASE entity_id % 3 WHEN 0 THEN 'ORACLE' WHEN 1 THEN 'ASISSUED' ELSE 'LIVE' END"


@query(BASE.rstrip() + f""", w AS (SELECT *, {WEATHER} AS weather, CASE WHEN horizon % 4 = 0 THEN 'B' ELSE 'A' END AS variant FROM fc),
conf AS (SELECT weather AS fit_weather, variable, bucket, obs_class, count(*) AS n, list_sort(list({SCORE})) AS s FROM w WHERE fold = 'val' AND variant = 'A' AND weather <> 'LIVE' GROUP BY ALL),
k AS (SELECT *, CASE WHEN variant = 'A' THEN CASE WHEN weather <> 'ORACLE' AND 'ASISSUED' IN (SELECT fit_weather FROM conf) THEN 'ASISSUED' ELSE 'ORACLE' END END AS fit_weather FROM w WHERE fold = 'test'),
a AS (SELECT k.*, CASE WHEN n >= 30 AND ceil((n + 1) * 0.8) <= n THEN s[CAST(ceil((n + 1) * 0.8) AS INTEGER)] END AS q FROM k LEFT JOIN conf USING (fit_weather, variable, bucket, obs_class))
SELECT entity_id, variable, target_date, weather, fit_weather, round(list_sort([lo, p50_])[1], 5) + 0.0 AS p10, round(hi, 5) + 0.0 AS p90 FROM (SELECT *, p50 AS p50_, CASE WHEN q IS NULL THEN p10 WHEN variable = 'ndci' THEN p10 - q ELSE exp(ln(1 + p10) - q) - 1 END AS lo, CASE WHEN q IS NULL THEN p90 WHEN variable = 'ndci' THEN p90 + q ELSE exp(ln(1 + p90) + q) - 1 END AS hi FROM a) b WHERE q IS NULL OR q >= 0""")
def pr10_applied_by_weather(spark, sf_dir):
    f = forecasts(spark, sf_dir).withColumns({"weather": F.expr(WEATHER), "variant": F.when(F.col("horizon") % 4 == 0, "B").otherwise("A")})
    fits = probability.conformal_fit(f.filter("fold = 'val' and variant = 'A' and weather <> 'LIVE'"), VAL_END, by=["weather"])
    out = probability.apply_by_weather(f.filter("fold = 'test'"), fits).filter("q_adjust is null or q_adjust >= 0")
    return rounded(out.select("entity_id", "variable", "target_date", "weather", "fit_weather", "p10", "p90"), 5)


@query()
def ag38_sensitivity(spark, sf_dir):
    """What 0.02 more tax, 0.08 at most, does to the medians of two models on the month starts of the validation period."""
    rows = forest_rows(spark, sf_dir)
    fit = rows.filter(F.col("date") <= F.lit(FIT_END).cast("date"))
    days = rows.filter((F.col("date") > F.lit(FIT_END).cast("date")) & (F.col("date") <= F.lit(VAL_END).cast("date")) & (F.dayofmonth("date") == 1)).dropDuplicates(["row_id"])
    models = {"A": forest.fit(fit, ["quantity", "discount", "tax"], "target"), "B": forest.fit(fit, ["quantity", "discount"], "target")}
    return rounded(scenario.sensitivity(models, days, "tax", 0.02, 0.08, "row_id"), 4)


@query(with_views("v_obs", "v_reaches", "v_exposure", more=",\n".join([LONG, CLIM, FC, THR, EXC, LATEST])) + PRIORITY)
def sq10_priorities(spark, sf_dir):
    """Priorities by each city's newest run and the model version that wrote it, instead of a fixed window."""
    run = ranking.latest_run(written(spark, sf_dir, exceedances(spark, sf_dir)), ["city"])
    p = ranking.priorities(view(spark, sf_dir, "v_reaches"), run, view(spark, sf_dir, "v_exposure"), WEIGHTS)
    return rounded(p.select("entity_id", "variable", "information_value", "reason"))


CENTS = "CAST(round({} * 100) AS BIGINT)"


@query(f"""WITH r AS (SELECT l_partkey AS lever_id, CAST(sum({CENTS.format('l_tax')} - {CENTS.format('l_discount')}) AS DOUBLE) / count(*) / 100 AS t, CAST(sum({CENTS.format('l_discount')} - 5) AS DOUBLE) / count(*) / 100 AS n FROM lineitem GROUP BY l_partkey),
v AS (SELECT lever_id, 'turbidity_proxy' AS variable, t AS change FROM r UNION ALL SELECT lever_id, 'ndci', n FROM r), c AS (SELECT p_partkey AS lever_id, 'turbidity_proxy' AS variable, CAST(p_size AS DOUBLE) / 50 AS coefficient, p_brand AS citation FROM part WHERE p_partkey % 3 <> 0),
e AS (SELECT p_partkey AS lever_id, CAST(p_retailprice AS DOUBLE) AS cost, u.variable FROM part, (SELECT unnest(['turbidity_proxy', 'ndci']) AS variable) u),
k AS (SELECT e.*, c.coefficient, c.citation, CASE WHEN change IS NULL THEN NULL WHEN abs(change) < 0.01 THEN 'NEGLIGIBLE' WHEN change > 0 THEN 'TRUSTED' ELSE 'WRONG_SIGN' END AS verdict FROM e LEFT JOIN v USING (lever_id, variable) LEFT JOIN c USING (lever_id, variable))
SELECT lever_id, variable, round(cost, 6) + 0.0 AS cost, round(coefficient, 6) + 0.0 AS coefficient, citation, verdict, CASE WHEN verdict = 'TRUSTED' THEN 'MODEL_PERTURBATION' WHEN coefficient IS NOT NULL THEN 'LITERATURE_DIRECT' ELSE 'NOT_ESTIMABLE' END AS path FROM k""")
def sq11_lever_catalogue(spark, sf_dir):
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("lever_id"))
    mean = lambda c: F.sum(c).cast("double") / F.count("*") / 100
    r = li.agg(mean(cents("l_tax") - cents("l_discount")).alias("turbidity_proxy"), mean(cents("l_discount") - 5).alias("ndci")).unpivot(["lever_id"], ["turbidity_proxy", "ndci"], "variable", "change")
    part = table(spark, sf_dir, "part")
    c = part.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("lever_id"), F.lit("turbidity_proxy").alias("variable"), (F.col("p_size").cast("double") / 50).alias("coefficient"), F.col("p_brand").alias("citation"))
    return rounded(scenario.catalogue(part.select(F.col("p_partkey").alias("lever_id"), F.col("p_retailprice").cast("double").alias("cost")), ["turbidity_proxy", "ndci"], r, c))


@query("""WITH a AS (SELECT CAST(l_linenumber AS INTEGER) AS scenario_id, l_suppkey AS entity_id, l_returnflag AS variable, p_brand, CAST(l_discount AS DOUBLE) AS d FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE l_linenumber <> 2 OR l_quantity >= 10)
SELECT scenario_id, entity_id, variable, round(sum(d), 6) + 0.0 AS effect, coalesce(list_sort(list(DISTINCT p_brand) FILTER (WHERE p_brand IS NOT NULL)), []) AS citations FROM a GROUP BY scenario_id, entity_id, variable""")
def sq12_scenario_store(spark, sf_dir):
    """A store by scenario, of which one is run anew with fewer levers and replaced, written and read again."""
    li = table(spark, sf_dir, "lineitem")
    applied = li.select(F.col("l_linenumber").cast("int").alias("scenario_id"), F.col("l_suppkey").alias("entity_id"), F.col("l_returnflag").alias("variable"), F.col("l_partkey").alias("lever_id"), F.col("l_discount").cast("double").alias("effect"), "l_quantity")
    citations = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lever_id"), F.col("p_brand").alias("citation"))
    old, new = scenario.stored(applied, citations), scenario.stored(applied.filter("scenario_id = 2 and l_quantity >= 10"), citations)
    to = scratch(spark, "scenarios")
    sinks.replace_slice(old, new, F.col("scenario_id") == 2).write.partitionBy("scenario_id").parquet(to)
    return rounded(spark.read.parquet(to))

"""Queries over daily and hourly series and observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import FIT_END, table, view, with_views
from ..functions import scalar
from ..operators import asof, climate, series
from .registry import query, rounded

SEASON_SQL = "CASE WHEN month({d}) IN (12, 1, 2) THEN 'DJF' WHEN month({d}) <= 5 THEN 'MAM' WHEN month({d}) <= 8 THEN 'JJA' ELSE 'SON' END"
LONG = """v_long AS (
  SELECT entity_id, obs_date, 'turbidity_proxy' AS variable, turbidity_proxy AS value FROM v_obs WHERE quality_flag = 'OK' AND turbidity_proxy IS NOT NULL
  UNION ALL SELECT entity_id, obs_date, 'ndci', ndci FROM v_obs WHERE quality_flag = 'OK' AND ndci IS NOT NULL)"""
DENSE = """bounds AS (SELECT min(date) AS lo, max(date) AS hi FROM v_weather),
days AS (SELECT CAST(lo + CAST(g.i AS INTEGER) AS DATE) AS date FROM bounds, generate_series(0, 20000) g(i) WHERE lo + CAST(g.i AS INTEGER) <= hi),
dense AS (SELECT d.date, w.precip_mm, w.precip_max_hourly, w.temp_mean_c FROM days d LEFT JOIN v_weather w ON w.date = d.date)"""
API7 = " + ".join(f"lag(precip_mm, {i}) OVER (ORDER BY date) * {0.9**i!r}" for i in range(1, 8))


def long_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return climate.long_observations(view(spark, sf_dir, "v_obs"))


@query(with_views("v_hourly") + """
SELECT entity_id, CAST(ts AS DATE) AS date, count(*) AS n_hours,
       round(CASE WHEN count(precip) = 24 THEN sum(precip) END, 6) + 0.0 AS precip_mm, round(CASE WHEN count(precip) = 24 THEN max(precip) END, 6) + 0.0 AS precip_max_hourly,
       CASE WHEN count(precip) = 24 THEN count(*) FILTER (WHERE precip > 0.5) END AS precip_duration_h, round(CASE WHEN count(temp) = 24 THEN avg(temp) END, 6) + 0.0 AS temp_mean_c
FROM v_hourly GROUP BY entity_id, CAST(ts AS DATE)""")
def ag1_daily_aggregate(spark, sf_dir):
    return rounded(series.daily(view(spark, sf_dir, "v_hourly"), "entity_id", "ts", "precip", "temp"))


@query(with_views("v_weather", more=DENSE) + "SELECT date, round(precip_mm, 6) + 0.0 AS precip_mm, precip_mm IS NULL AS missing FROM dense")
def wn1_densify(spark, sf_dir):
    d = series.densify(view(spark, sf_dir, "v_weather"), "cell_id")
    return rounded(d.select("date", "precip_mm", F.col("precip_mm").isNull().alias("missing")))


@query(with_views("v_weather") + """
SELECT cell_id, count(*) AS n_gaps FROM (SELECT cell_id, date - lag(date) OVER (PARTITION BY cell_id ORDER BY date) AS gap FROM v_weather) q WHERE gap <> 1 GROUP BY cell_id""")
def wn2_contiguity(spark, sf_dir):
    return series.gaps(view(spark, sf_dir, "v_weather"), "cell_id")


@query(with_views("v_weather", more=DENSE) + f"SELECT date, round({API7}, 6) + 0.0 AS api_7 FROM dense")
def wn3_antecedent_index(spark, sf_dir):
    d = series.densify(view(spark, sf_dir, "v_weather"), "cell_id")
    w = Window.partitionBy("cell_id").orderBy("date")
    return rounded(d.select("date", series.antecedent("precip_mm", w, 7).alias("api_7")))


@query(with_views("v_weather", more=DENSE) + """
SELECT date, CASE WHEN wet IS NOT NULL AND (gone IS NULL OR gone < wet) THEN CAST(date - wet - 1 AS INTEGER) END AS antecedent_dry_days
FROM (SELECT date, max(CASE WHEN precip_mm >= 1 THEN date END) OVER w AS wet, max(CASE WHEN precip_mm IS NULL THEN date END) OVER w AS gone
      FROM dense WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) q""")
def wn4_dry_days(spark, sf_dir):
    d = series.densify(view(spark, sf_dir, "v_weather"), "cell_id")
    w = Window.partitionBy("cell_id").orderBy("date")
    return d.select("date", series.dry_days("precip_mm", "date", w).alias("antecedent_dry_days"))


@query(with_views("v_weather", more=DENSE) + "SELECT date, " + ", ".join(f"round(lead(precip_mm, {h}) OVER (ORDER BY date), 6) + 0.0 AS precip_mm_h{h}" for h in range(1, 11)) + " FROM dense")
def wn5_leads(spark, sf_dir):
    d = series.densify(view(spark, sf_dir, "v_weather"), "cell_id")
    return rounded(series.leads(d, "cell_id", "precip_mm", range(1, 11)).select("date", *[f"precip_mm_h{h}" for h in range(1, 11)]))


@query()
def wn13_driver_features(spark, sf_dir):
    return rounded(series.features(view(spark, sf_dir, "v_weather"), "cell_id", FIT_END))


@query(with_views("v_weather", more=DENSE) + f""", a AS (SELECT date, {API7} AS api_7 FROM dense)
SELECT 0 AS cell_id, round(max(api_7), 6) + 0.0 AS largest FROM a WHERE date <= DATE '{FIT_END}'""")
def ag4_training_maximum(spark, sf_dir):
    d = series.densify(view(spark, sf_dir, "v_weather"), "cell_id")
    w = Window.partitionBy("cell_id").orderBy("date")
    a = d.withColumn("api_7", series.antecedent("precip_mm", w, 7)).filter(F.col("date") <= F.lit(FIT_END).cast("date"))
    return rounded(a.groupBy("cell_id").agg(F.max("api_7").alias("largest")))


@query(with_views("v_hourly") + """, cut AS (SELECT max(d) AS d FROM (SELECT CAST(ts AS DATE) AS d FROM v_hourly WHERE entity_id = 'click' GROUP BY CAST(ts AS DATE) HAVING count(precip) = 24) q),
both_ AS (SELECT ts, precip, 'ARCHIVE' AS source FROM v_hourly, cut WHERE entity_id = 'click' AND CAST(ts AS DATE) <= cut.d
          UNION ALL SELECT ts, precip, 'FORECAST' FROM v_hourly, cut WHERE entity_id = 'view' AND CAST(ts AS DATE) > cut.d)
SELECT CAST(ts AS DATE) AS date, max(source) AS source, round(sum(precip), 6) + 0.0 AS precip_mm, count(*) AS n_hours FROM both_ GROUP BY CAST(ts AS DATE)""")
def ag3_source_splice(spark, sf_dir):
    h = view(spark, sf_dir, "v_hourly")
    archive, run = h.filter("entity_id = 'click'"), h.filter("entity_id = 'view'")
    last = archive.groupBy(F.to_date("ts").alias("d")).agg(F.count("precip").alias("n")).filter("n = 24").agg(F.max("d").alias("d")).withColumn("k", F.lit(0))
    keep = lambda df, source, cond: df.withColumn("k", F.lit(0)).join(last, "k").filter(cond).select("ts", "precip", F.lit(source).alias("source"))
    both = keep(archive, "ARCHIVE", F.to_date("ts") <= F.col("d")).unionByName(keep(run, "FORECAST", F.to_date("ts") > F.col("d")))
    return rounded(both.groupBy(F.to_date("ts").alias("date")).agg(F.max("source").alias("source"), F.sum("precip").alias("precip_mm"), F.count("*").alias("n_hours")))


RUN = """run AS (SELECT h.entity_id, h.ts, coalesce(CASE WHEN hour(h.ts) = 0 THEN a.precip END, h.precip) AS precip
 FROM v_hourly h LEFT JOIN v_hourly a ON a.ts = h.ts AND a.entity_id = 'click' WHERE h.entity_id = 'view')"""


@query(with_views("v_hourly", more=RUN) + """SELECT CAST(ts AS DATE) AS date, count(*) AS n_hours, round(CASE WHEN count(precip) = 24 THEN sum(precip) END, 6) + 0.0 AS precip_mm FROM run
WHERE CAST(ts AS DATE) >= DATE '2024-01-10' GROUP BY CAST(ts AS DATE)""")
def ag2_run_daily(spark, sf_dir):
    h = view(spark, sf_dir, "v_hourly")
    first = h.filter("entity_id = 'click' and hour(ts) = 0").select("ts", F.col("precip").alias("_h00"))
    run = h.filter("entity_id = 'view'").join(first, "ts", "left").withColumn("precip", F.coalesce("_h00", "precip")).filter("to_date(ts) >= date'2024-01-10'")
    return rounded(run.groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n_hours"), F.when(F.count("precip") == 24, F.sum("precip")).alias("precip_mm")))


@query(with_views("v_obs", "v_reaches", more=LONG) + f""", q AS (SELECT entity_id, variable, {SEASON_SQL.format(d='obs_date')} AS season, value FROM v_long WHERE obs_date <= DATE '{FIT_END}'),
t AS (SELECT entity_id, variable, season, quantile_cont(value, 0.9) AS threshold, count(*) AS n_obs FROM q GROUP BY ALL HAVING count(*) >= 8)
SELECT t.entity_id, t.variable, t.season, round(any_value(threshold), 6) + 0.0 AS threshold, any_value(n_obs) AS n_obs, round(avg(CASE WHEN q.value > t.threshold THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS clim_exceed_freq
FROM t JOIN q USING (entity_id, variable, season) GROUP BY t.entity_id, t.variable, t.season""")
def ag5_seasonal_thresholds(spark, sf_dir):
    return rounded(climate.seasonal_thresholds(long_obs(spark, sf_dir), FIT_END))


CLIM = f"""clim AS (SELECT entity_id, variable, doy, count(*) AS n_clim, avg(value) AS m, quantile_cont(value, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]) AS q
 FROM (SELECT entity_id, variable, value, ((least(dayofyear(obs_date), 365) - 1 + o.o + 365) % 365) + 1 AS doy
       FROM v_long, generate_series(-15, 15) o(o) WHERE obs_date <= DATE '{FIT_END}') s GROUP BY entity_id, variable, doy)"""


@query(with_views("v_obs", more=LONG + ",\n" + CLIM) + """SELECT entity_id, variable, CAST(doy AS INTEGER) AS doy, n_clim, round(CASE WHEN n_clim >= 5 THEN m END, 6) + 0.0 AS clim_mean, """
       + ", ".join(f"round(CASE WHEN n_clim >= 5 THEN q[{i + 1}] END, 6) + 0.0 AS {n}" for i, n in enumerate(climate.NAMES)) + " FROM clim")
def ag6_climatology(spark, sf_dir):
    c = climate.climatology(long_obs(spark, sf_dir), FIT_END)
    return rounded(c.withColumn("doy", F.col("doy").cast("int")))


@query(with_views("v_obs", more=LONG) + "SELECT entity_id, obs_date, variable, round(value, 6) + 0.0 AS value FROM v_long")
def ag7_long_observations(spark, sf_dir):
    return rounded(long_obs(spark, sf_dir))


@query(with_views("v_obs", more=LONG) + f""", n AS (SELECT entity_id, variable, month(obs_date) AS m, quantile_cont(value, 0.5) AS normal FROM v_long WHERE obs_date < DATE '{FIT_END}' GROUP BY ALL)
SELECT l.entity_id, l.variable, l.obs_date, round(l.value - n.normal, 6) + 0.0 AS anomaly FROM v_long l LEFT JOIN n ON n.entity_id = l.entity_id AND n.variable = l.variable AND n.m = month(l.obs_date)""")
def ag20_deseasonalise(spark, sf_dir):
    return rounded(climate.deseasonalised(long_obs(spark, sf_dir), FIT_END).select("entity_id", "variable", "obs_date", "anomaly"))


@query("""WITH p AS (SELECT CAST(l_shipdate AS DATE) AS date, list_sort(list_distinct(list(l_returnflag))) AS modes FROM lineitem GROUP BY CAST(l_shipdate AS DATE))
SELECT date, CASE WHEN len(modes) > 1 THEN 'MIXED' ELSE modes[1] END AS platform, CAST(len(modes) AS INTEGER) AS n_platforms FROM p""")
def ag21_platform_by_day(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    p = li.groupBy(F.to_date("l_shipdate").alias("date")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("modes"))
    return p.select("date", F.when(F.size("modes") > 1, "MIXED").otherwise(F.get("modes", F.lit(0))).alias("platform"), F.size("modes").alias("n_platforms"))


@query(with_views("v_obs") + """, years AS (SELECT DISTINCT entity_id, y.y AS year FROM v_obs, generate_series(1995, 2002) y(y)),
g AS (SELECT entity_id, year(obs_date) AS year, quantile_cont(turbidity_proxy, 0.5) AS median, count(*) AS n_clear FROM v_obs WHERE quality_flag = 'OK' GROUP BY ALL),
a AS (SELECT entity_id, year(obs_date) AS year, count(*) AS n FROM v_obs GROUP BY ALL)
SELECT CAST(years.entity_id AS BIGINT) AS entity_id, CAST(years.year AS INTEGER) AS year, round(median, 6) + 0.0 AS median, coalesce(n_clear, 0) AS n_clear, coalesce(n, 0) AS n_acquisitions,
       CASE WHEN n_clear > 0 THEN 'OK' WHEN n > 0 THEN 'NO_CLEAR_ACQUISITION' ELSE 'NO_ACQUISITION' END AS flag
FROM years LEFT JOIN g USING (entity_id, year) LEFT JOIN a USING (entity_id, year)""")
def ag22_window_medians(spark, sf_dir):
    obs = view(spark, sf_dir, "v_obs")
    years = obs.select("entity_id").distinct().withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(2002))))
    good = obs.filter("quality_flag = 'OK'").withColumn("value", F.col("turbidity_proxy"))
    return rounded(climate.yearly_medians(good, obs, years).select("entity_id", "year", "median", "n_clear", "n_acquisitions", "flag"))


@query(with_views("v_obs") + f""", g AS (SELECT entity_id, year(obs_date) AS year, quantile_cont(turbidity_proxy, 0.5) AS median FROM v_obs WHERE quality_flag = 'OK' GROUP BY ALL)
SELECT entity_id, round(avg(median), 6) + 0.0 AS climatology, count(*) AS n_years FROM g WHERE year <= year(DATE '{FIT_END}') GROUP BY entity_id""")
def ag23_yearly_climatology(spark, sf_dir):
    g = view(spark, sf_dir, "v_obs").filter("quality_flag = 'OK'").groupBy("entity_id", F.year("obs_date").alias("year")).agg(F.percentile("turbidity_proxy", F.lit(0.5)).alias("median"))
    return rounded(g.filter(F.col("year") <= int(FIT_END[:4])).groupBy("entity_id").agg(F.avg("median").alias("climatology"), F.count("*").alias("n_years")))


@query(with_views("v_obs", "v_reaches") + """, u AS (SELECT entity_id, quantile_cont(water_pixel_count, 0.5) AS md, min(water_pixel_count) AS lo, max(water_pixel_count) AS hi, count(*) AS n FROM v_obs WHERE quality_flag <> 'CLOUD' GROUP BY entity_id)
SELECT r.entity_id, round(CAST(md AS DOUBLE), 6) + 0.0 AS median_water_pixels, lo AS min_water_pixels, hi AS max_water_pixels, n AS n_usable, md >= 5 AS observable, CASE WHEN n IS NULL THEN 'NO_USABLE_DATE' END AS reason
FROM v_reaches r LEFT JOIN u ON u.entity_id = r.entity_id""")
def ag24_observability_gate(spark, sf_dir):
    return rounded(climate.observability(view(spark, sf_dir, "v_obs"), view(spark, sf_dir, "v_reaches")))


@query(with_views("v_obs") + "SELECT entity_id, year(obs_date) AS year, quality_flag, count(*) AS n FROM v_obs GROUP BY ALL")
def ag35_rows_per_year(spark, sf_dir):
    return view(spark, sf_dir, "v_obs").groupBy("entity_id", F.year("obs_date").alias("year"), "quality_flag").agg(F.count("*").alias("n"))


@query(with_views("v_obs") + """, s AS (SELECT entity_id, water_pixel_count AS v, row_number() OVER (PARTITION BY entity_id ORDER BY water_pixel_count) - 1 AS i, count(*) OVER (PARTITION BY entity_id) AS n FROM v_obs)
SELECT entity_id, max(CASE WHEN i = CAST(floor(0.5 * (n - 1)) AS BIGINT) THEN v END) AS q50, max(CASE WHEN i = CAST(floor(0.9 * (n - 1)) AS BIGINT) THEN v END) AS q90 FROM s GROUP BY entity_id""")
def ag25_lower_index_quantiles(spark, sf_dir):
    w = Window.partitionBy("entity_id")
    s = view(spark, sf_dir, "v_obs").withColumn("i", F.row_number().over(w.orderBy("water_pixel_count")) - 1).withColumn("n", F.count("*").over(w))
    pick = lambda q: F.max(F.when(F.col("i") == F.floor(F.lit(q) * (F.col("n") - 1)), F.col("water_pixel_count")))
    return s.groupBy("entity_id").agg(pick(0.5).alias("q50"), pick(0.9).alias("q90"))


@query(with_views("v_obs") + """, d AS (SELECT entity_id, obs_date, CASE WHEN quality_flag = 'OK' THEN turbidity_proxy END AS v FROM v_obs),
a AS (SELECT entity_id, obs_date, last_value(v IGNORE NULLS) OVER w AS v0, max(CASE WHEN v IS NOT NULL THEN obs_date END) OVER w AS seen FROM d WINDOW w AS (PARTITION BY entity_id ORDER BY obs_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT entity_id, obs_date, round(CASE WHEN obs_date - seen <= 60 THEN v0 END, 6) + 0.0 AS turbidity_proxy_asof, CAST(CASE WHEN obs_date - seen <= 60 THEN obs_date - seen END AS INTEGER) AS turbidity_proxy_age FROM a""")
def jn4_carry_forward(spark, sf_dir):
    o = view(spark, sf_dir, "v_obs")
    c = series.carried(o, "entity_id", "turbidity_proxy", F.col("quality_flag") == "OK", 60, "obs_date")
    return rounded(c.select("entity_id", "obs_date", "turbidity_proxy_asof", "turbidity_proxy_age"))


@query(with_views("v_obs", "v_topology", "v_reaches") + """, good AS (SELECT entity_id, obs_date, turbidity_proxy, ndci FROM v_obs WHERE quality_flag = 'OK'),
days AS (SELECT DISTINCT r.entity_id, d.obs_date AS date FROM v_reaches r, (SELECT DISTINCT obs_date FROM v_obs) d),
e AS (SELECT t.upstream_id, t.downstream_id, CASE WHEN max(CASE WHEN a.catchment_area_km2 > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY t.downstream_id) = 1 THEN 1.0 ELSE a.catchment_area_km2 END AS w FROM v_topology t LEFT JOIN v_reaches a ON a.entity_id = t.upstream_id),
l AS (SELECT e.downstream_id, g.date, e.w, (SELECT max_by(x.turbidity_proxy, x.obs_date) FROM good x WHERE x.entity_id = e.upstream_id AND x.obs_date BETWEEN g.date - 3 AND g.date - 1 AND x.turbidity_proxy IS NOT NULL) AS t,
      (SELECT max_by(x.ndci, x.obs_date) FROM good x WHERE x.entity_id = e.upstream_id AND x.obs_date BETWEEN g.date - 3 AND g.date - 1 AND x.ndci IS NOT NULL) AS n FROM e JOIN days g ON g.entity_id = e.downstream_id),
m AS (SELECT downstream_id, date, sum(t * w) / sum(CASE WHEN t IS NOT NULL THEN w END) AS t, sum(n * w) / sum(CASE WHEN n IS NOT NULL THEN w END) AS n FROM l GROUP BY downstream_id, date)
SELECT d.entity_id, d.date, round(m.t, 6) + 0.0 AS upstream_turbidity_proxy, round(m.n, 6) + 0.0 AS upstream_ndci,
       CASE WHEN d.entity_id NOT IN (SELECT downstream_id FROM e) THEN 'NO_UPSTREAM_REACH' WHEN coalesce(m.t, m.n) IS NOT NULL THEN 'OK' ELSE 'NO_RECENT_UPSTREAM_OBS' END AS upstream_state_flag
FROM days d LEFT JOIN m ON m.downstream_id = d.entity_id AND m.date = d.date""")
def jn5_upstream_state(spark, sf_dir):
    obs = view(spark, sf_dir, "v_obs")
    dates = obs.select(F.col("obs_date").alias("date")).distinct().withColumn("k", F.lit(0))
    reaches = view(spark, sf_dir, "v_reaches")
    days = reaches.select("entity_id").withColumn("k", F.lit(0)).join(dates, "k").drop("k")
    return rounded(asof.upstream_state(obs, view(spark, sf_dir, "v_topology"), reaches, days, ["turbidity_proxy", "ndci"]))


@query(with_views("v_obs", more=LONG) + f""", t AS (SELECT entity_id, variable, obs_date AS target_date, CAST(obs_date - CAST(1 + (entity_id % 10) AS INTEGER) AS DATE) AS issued_date FROM v_long WHERE obs_date > DATE '{FIT_END}'),
c AS (SELECT t.entity_id, t.variable, t.issued_date, t.target_date, min_by(l.value, (k.k * 100000 + abs(l.obs_date - CAST(t.target_date - to_years(CAST(k.k AS INTEGER)) AS DATE)) * 1000 + CASE WHEN l.obs_date <= CAST(t.target_date - to_years(CAST(k.k AS INTEGER)) AS DATE) THEN 0 ELSE 1 END)) AS naive
      FROM t, generate_series(1, 15) k(k) JOIN v_long l ON l.entity_id = t.entity_id AND l.variable = t.variable
       AND abs(l.obs_date - CAST(t.target_date - to_years(CAST(k.k AS INTEGER)) AS DATE)) <= 7 AND l.obs_date <= t.issued_date GROUP BY ALL)
SELECT t.entity_id, t.variable, t.issued_date, t.target_date, round(c.naive, 6) + 0.0 AS naive FROM t LEFT JOIN c USING (entity_id, variable, issued_date, target_date)""")
def jn9_seasonal_naive(spark, sf_dir):
    obs = long_obs(spark, sf_dir)
    targets = obs.filter(F.col("obs_date") > F.lit(FIT_END).cast("date")).select("entity_id", "variable", F.date_sub("obs_date", (1 + F.col("entity_id") % 10).cast("int")).alias("issued_date"), F.col("obs_date").alias("target_date"))
    return rounded(asof.seasonal_naive(obs, targets, ["entity_id", "variable"]))


@query("""SELECT l_orderkey, l_linenumber, """ + SEASON_SQL.format(d="l_shipdate") + """ AS season, round(CASE WHEN l_tax >= 0 AND l_tax < 0.9 * 0.19563 THEN 366.14 * CAST(l_tax AS DOUBLE) / (1 - CAST(l_tax AS DOUBLE) / 0.19563) END, 6) + 0.0 AS turbidity,
round(sin(dayofyear(l_shipdate) * (2 * pi() / 365.25)), 6) + 0.0 AS doy_sin, round(cos(dayofyear(l_shipdate) * (2 * pi() / 365.25)), 6) + 0.0 AS doy_cos,
CASE WHEN l_linenumber <= 3 THEN '1-3' WHEN l_linenumber <= 7 THEN '4-7' END AS bucket, CASE WHEN l_linenumber = 1 THEN 'unassessed' WHEN l_linenumber % 2 = 0 THEN 'observable' ELSE 'driver_only' END AS obs_class,
round(CASE WHEN l_discount IS NOT NULL AND l_tax IS NOT NULL THEN l_quantity * (1 - greatest(0.0, least(1.0, l_tax / 0.05))) END, 6) + 0.0 AS low_flow, CAST(3 * ceil(l_quantity / 14) * ceil(l_linenumber / 10.0) AS BIGINT) AS weight FROM lineitem""")
def fn_scalars(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    sin, cos = scalar.harmonics(F.col("l_shipdate"))
    n = F.col("l_linenumber")
    tax = F.col("l_tax").cast("double")
    return rounded(li.select("l_orderkey", "l_linenumber", scalar.season(F.col("l_shipdate")).alias("season"), scalar.turbidity(tax).alias("turbidity"), sin.alias("doy_sin"), cos.alias("doy_cos"),
                             scalar.bucket_of(n, {"1-3": (1, 2, 3), "4-7": (4, 5, 6, 7)}).alias("bucket"), scalar.obs_class(F.when(n != 1, n % 2 == 0)).alias("obs_class"),
                             scalar.low_flow(F.col("l_quantity").cast("double"), tax, F.lit(0.05)).alias("low_flow"), scalar.call_weight(F.lit(3), F.col("l_quantity"), n).cast("long").alias("weight")))


@query(with_views("v_obs") + """, c AS (SELECT entity_id, obs_date, water_pixel_count, quality_flag, (entity_id % 7) / 10.0 AS cloud, (water_pixel_count % 11) / 10.0 AS valid FROM v_obs)
SELECT entity_id, obs_date, CASE WHEN water_pixel_count <= 0 OR cloud > 0.2 THEN 'CLOUD' WHEN coalesce(water_pixel_count, 0) < 5 THEN 'NO_WATER_PIXELS' WHEN valid >= 0.5 AND quality_flag = 'OK' THEN 'OK' ELSE 'OUT_OF_RANGE' END AS flag FROM c""")
def fn2_classify_water(spark, sf_dir):
    o = view(spark, sf_dir, "v_obs")
    flag = scalar.classify_water(F.col("water_pixel_count"), (F.col("entity_id") % 7) / 10, F.col("water_pixel_count"), (F.col("water_pixel_count") % 11) / 10, F.col("quality_flag") == "OK")
    return o.select("entity_id", "obs_date", flag.alias("flag"))


@query("""SELECT s_suppkey, l.k AS level, round(CASE WHEN p < (md - lo) / (hi - lo) THEN lo + sqrt(p * (hi - lo) * (md - lo)) ELSE hi - sqrt((1 - p) * (hi - lo) * (hi - md)) END, 6) + 0.0 AS coefficient
FROM (SELECT s_suppkey, 0.1 AS lo, 0.1 + (s_suppkey % 9 + 1) / 20.0 AS md, 0.8 AS hi FROM supplier) s, (SELECT k, (k + 0.5) / 9 AS p FROM generate_series(0, 8) g(k)) l""")
def fn13_coefficient_levels(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("level"))
    p = (F.col("level") + 0.5) / 9
    return rounded(s.select("s_suppkey", F.col("level").cast("long").alias("level"), scalar.triangular_quantile(p, F.lit(0.1), 0.1 + (F.col("s_suppkey") % 9 + 1) / 20, F.lit(0.8)).alias("coefficient")))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) % 5 AS flag, count(*) AS n FROM events GROUP BY ALL")
def fn15_json_flag_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string, int>")).alias("key", "value")).filter("key not like '\\\\_%'")
    return e.groupBy("event_type", (F.col("value") % 5).alias("flag")).agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey, greatest(DATE '2017-03-15', make_date(CAST(y.y AS INTEGER), 1, 1)) AS chunk_start, least(CAST(DATE '2020-02-01' + CAST(n_nationkey AS INTEGER) * 30 AS DATE), make_date(CAST(y.y AS INTEGER), 12, 31)) AS chunk_end
FROM nation, generate_series(2017, 2026) y(y) WHERE make_date(CAST(y.y AS INTEGER), 1, 1) <= DATE '2020-02-01' + CAST(n_nationkey AS INTEGER) * 30""")
def fn17_year_chunks(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.date_add(F.lit("2020-02-01").cast("date"), (F.col("n_nationkey") * 30).cast("int")).alias("_end"))
    y = n.withColumn("_y", F.explode(F.sequence(F.lit(2017), F.year("_end"))))
    return y.select("n_nationkey", F.greatest(F.lit("2017-03-15").cast("date"), F.make_date("_y", F.lit(1), F.lit(1))).alias("chunk_start"), F.least("_end", F.make_date("_y", F.lit(12), F.lit(31))).alias("chunk_end"))


@query(with_views("v_reaches") + """SELECT entity_id, CAST(y.y AS INTEGER) AS year, k.kind FROM v_reaches, generate_series(2018, 2020) y(y), (SELECT unnest(['water', 'riparian']) AS kind) k WHERE k.kind = 'water' OR coalesce(observable, FALSE)""")
def fn18_work_plan(spark, sf_dir):
    r = view(spark, sf_dir, "v_reaches").withColumn("year", F.explode(F.sequence(F.lit(2018), F.lit(2020)))).withColumn("kind", F.explode(F.array(F.lit("water"), F.lit("riparian"))))
    return r.filter((F.col("kind") == "water") | F.coalesce("observable", F.lit(False))).select("entity_id", "year", "kind")


@query("SELECT o_orderkey, round(round_even(round_even(CAST(o_totalprice AS DOUBLE) / 0.25, 0) * 0.25, 6), 6) + 0.0 AS snapped FROM orders")
def fn6_snap(spark, sf_dir):
    return rounded(table(spark, sf_dir, "orders").select("o_orderkey", scalar.snap(F.col("o_totalprice").cast("double"), 0.25).alias("snapped")))


@query("SELECT l_suppkey, count(*) AS n, min(l_shipdate) AS first, max(l_shipdate) AS last, count(*) FILTER (WHERE l_comment IS NULL) AS nulls FROM (SELECT l_suppkey, l_shipdate, CASE WHEN l_linenumber = 2 THEN NULL ELSE 'x' END AS l_comment FROM lineitem) q GROUP BY l_suppkey")
def fn19_payload_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("c", F.when(F.col("l_linenumber") != 2, "x"))
    return li.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.count_if(F.col("c").isNull()).alias("nulls"))

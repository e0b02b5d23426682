"""Queries over the modelling frame, folds, the forest model and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import FIT_END, VAL_END, table, view, with_views
from ..operators import forest, frame, graph, series
from ..streaming import daily as streaming
from .registry import query, rounded
from .series_queries import DENSE

HORIZONS = tuple(range(1, 11))
FOLD = f"CASE WHEN date <= DATE '{FIT_END}' THEN 'train' WHEN date <= DATE '{VAL_END}' THEN 'val' WHEN date <= DATE '2001-12-31' THEN 'test' END"
FRAME = DENSE + f""", frame AS (SELECT date, precip_mm, temp_mean_c, {FOLD} AS fold, {", ".join(f"lead(temp_mean_c, {h}) OVER (ORDER BY date) AS target_h{h}, lead(precip_mm, {h}) OVER (ORDER BY date) AS precip_h{h}" for h in HORIZONS)} FROM dense)"""
ENDS = {"train": FIT_END, "val": VAL_END, "test": "2001-12-31"}


def frame_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = series.densify(view(spark, sf_dir, "v_weather"), "cell_id")
    return frame.with_folds(frame.build(days, "cell_id", "temp_mean_c", "precip_mm", HORIZONS), ENDS)


@query(with_views("v_weather", more=FRAME) + "SELECT date, fold, round(temp_mean_c, 6) + 0.0 AS temp_mean_c, " + ", ".join(f"round(target_h{h}, 6) + 0.0 AS target_h{h}" for h in HORIZONS) + " FROM frame")
def fr1_frame(spark, sf_dir):
    return rounded(frame_of(spark, sf_dir).select("date", "fold", "temp_mean_c", *[f"target_h{h}" for h in HORIZONS]))


EMBARGOED = FRAME + ", emb AS (SELECT date, fold, " + ", ".join(f"CASE WHEN date + {h} <= CASE fold WHEN 'train' THEN DATE '{FIT_END}' WHEN 'val' THEN DATE '{VAL_END}' ELSE DATE '2001-12-31' END THEN target_h{h} END AS target_h{h}, CASE WHEN date + {h} <= CASE fold WHEN 'train' THEN DATE '{FIT_END}' WHEN 'val' THEN DATE '{VAL_END}' ELSE DATE '2001-12-31' END THEN precip_h{h} END AS precip_h{h}" for h in HORIZONS) + " FROM frame WHERE fold IS NOT NULL)"


@query(with_views("v_weather", more=EMBARGOED) + "SELECT fold, count(*) AS n, " + ", ".join(f"count(target_h{h}) AS n_h{h}" for h in HORIZONS) + " FROM emb GROUP BY fold")
def fr3_embargo(spark, sf_dir):
    e = frame.embargoed(frame_of(spark, sf_dir), ENDS, HORIZONS)
    return e.groupBy("fold").agg(F.count("*").alias("n"), *[F.count(f"target_h{h}").alias(f"n_h{h}") for h in HORIZONS])


LONG_SQL = EMBARGOED + ", long_ AS (" + " UNION ALL ".join(f"SELECT date, fold, {h} AS horizon, target_h{h} AS target, precip_h{h} AS precip_fut, " + " + ".join(f"precip_h{k}" for k in range(1, h + 1)) + f" AS precip_fut_cum FROM emb WHERE target_h{h} IS NOT NULL" for h in HORIZONS) + ")"


@query(with_views("v_weather", more=LONG_SQL) + "SELECT date, fold, CAST(horizon AS INTEGER) AS horizon, round(target, 6) + 0.0 AS target, round(precip_fut, 6) + 0.0 AS precip_fut, round(precip_fut_cum, 6) + 0.0 AS precip_fut_cum FROM long_")
def fr5_long(spark, sf_dir):
    return rounded(frame.to_long(frame.embargoed(frame_of(spark, sf_dir), ENDS, HORIZONS), HORIZONS).select("date", "fold", "horizon", "target", "precip_fut", "precip_fut_cum"))


@query(with_views("v_weather", more=DENSE) + "SELECT date, CASE WHEN precip_mm IS NULL THEN 0 ELSE 1 END AS quality_code, round(precip_mm, 6) + 0.0 AS precip_mm FROM dense")
def fr15_daily_export(spark, sf_dir):
    d = series.densify(view(spark, sf_dir, "v_weather"), "cell_id")
    return rounded(d.select("date", F.when(F.col("precip_mm").isNull(), 0).otherwise(1).alias("quality_code"), "precip_mm"))


@query(with_views("v_weather", more=FRAME) + "SELECT CAST(h.h AS INTEGER) AS horizon, fold, count(*) AS n FROM frame, generate_series(1, 10) h(h) WHERE fold IS NOT NULL AND date + CAST(h.h AS INTEGER) <= CASE fold WHEN 'train' THEN DATE '1998-12-31' WHEN 'val' THEN DATE '1999-12-31' ELSE DATE '2001-12-31' END GROUP BY ALL")
def fr14_simulation_rows(spark, sf_dir):
    f = frame_of(spark, sf_dir).filter("fold is not null").select("date", "fold").withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(10))))
    return f.filter(F.date_add("date", F.col("horizon")) <= frame.end_of(F.col("fold"), ENDS)).groupBy("horizon", "fold").agg(F.count("*").alias("n"))


def forest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("entity_id"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").cast("double").alias("quantity"), F.when(F.col("l_linenumber") != 2, F.col("l_discount").cast("double")).alias("discount"), F.col("l_tax").cast("double").alias("tax"), F.log1p(F.col("l_extendedprice").cast("double")).alias("target")).withColumn("row_id", F.xxhash64("entity_id", "date", "quantity", "discount", "tax", "target"))


@query()
def fr8_forest_quantiles(spark, sf_dir):
    rows = forest_rows(spark, sf_dir)
    model = forest.fit(rows.filter(F.col("date") <= F.lit(FIT_END).cast("date")), ["quantity", "discount", "tax"], "target")
    out = forest.predict(model, rows.filter(F.col("date") > F.lit(FIT_END).cast("date")).dropDuplicates(["row_id"]), "row_id")
    return rounded(out.select("row_id", *forest.NAMES), 4)


@query()
def fr9_occlusion_attribution(spark, sf_dir):
    rows = forest_rows(spark, sf_dir)
    fit = rows.filter(F.col("date") <= F.lit(FIT_END).cast("date"))
    model = forest.fit(fit, ["quantity", "discount", "tax"], "target")
    new = rows.filter(F.col("date") > F.lit("2001-06-30").cast("date")).dropDuplicates(["row_id"])
    return rounded(forest.occlusion(model, fit, new, "row_id"), 4)


@query(with_views("v_hourly") + """, b AS (SELECT entity_id, ts, precip FROM v_hourly), last AS (SELECT max(ts) AS t FROM b)
SELECT entity_id, CAST(ts AS DATE) AS date, count(precip) AS n_hours, round(CASE WHEN count(precip) = 24 THEN sum(precip) END, 6) + 0.0 AS precip_mm, round(CASE WHEN count(precip) = 24 THEN max(precip) END, 6) + 0.0 AS precip_max_hourly FROM b, last
GROUP BY entity_id, CAST(ts AS DATE), t HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= t - INTERVAL 6 HOUR""")
def st1_streaming_days(spark, sf_dir):
    """The live feed read as a stream from files, run until it has seen them all; closed days come out."""
    feed = f"{graph.shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    view(spark, sf_dir, "v_hourly").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{feed}/in")
    stream = spark.readStream.schema("entity_id string, ts timestamp, precip double, temp double").parquet(f"{feed}/in")
    done = streaming.complete_days(stream).writeStream.outputMode("append").format("parquet").option("path", f"{feed}/out").option("checkpointLocation", f"{feed}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return rounded(spark.read.schema("entity_id string, date date, n_hours long, precip_mm double, precip_max_hourly double").parquet(f"{feed}/out"))


@query(with_views("v_obs", "v_reaches") + "SELECT r.entity_id, o.n FROM v_reaches r LEFT JOIN (SELECT entity_id, count(*) AS n FROM v_obs GROUP BY entity_id) o USING (entity_id)")
def jn1_static_join(spark, sf_dir):
    n = view(spark, sf_dir, "v_obs").groupBy("entity_id").agg(F.count("*").alias("n"))
    return view(spark, sf_dir, "v_reaches").select("entity_id").join(n, "entity_id", "left")


@query("SELECT s.s_suppkey, w.n AS cell_days, w.total FROM supplier s LEFT JOIN (SELECT c_nationkey, count(DISTINCT CAST(o_orderdate AS DATE)) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey) w ON w.c_nationkey = s.s_nationkey")
def jn2_cell_broadcast(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    w = o.groupBy("c_nationkey").agg(F.count_distinct(F.to_date("o_orderdate")).alias("cell_days"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return table(spark, sf_dir, "supplier").join(w, F.col("s_nationkey") == F.col("c_nationkey"), "left").select("s_suppkey", "cell_days", "total")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber AS horizon, l_shipdate, sum(l_tax) AS oracle FROM lineitem GROUP BY ALL), a AS (SELECT l_orderkey, l_linenumber AS horizon, l_shipdate, sum(l_discount) AS issued FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY ALL)
SELECT f.l_orderkey, CAST(f.horizon AS INTEGER) AS horizon, f.l_shipdate, round(a.issued, 6) + 0.0 AS driver FROM f JOIN a ON a.l_orderkey = f.l_orderkey AND a.horizon = f.horizon AND a.l_shipdate = f.l_shipdate""")
def jn7_as_issued_substitution(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "horizon")
    keys = ["l_orderkey", "horizon", "l_shipdate"]
    long = li.groupBy(*keys).agg(F.sum("l_tax").alias("driver"))
    run = li.filter("l_orderkey % 2 = 0").groupBy(*keys).agg(F.sum("l_discount").alias("driver"))
    return rounded(frame.substituted(long, run, keys, ["driver"]))


@query("SELECT p_partkey, coalesce(a.v, b.v) AS value, CASE WHEN a.v IS NOT NULL THEN 'first' WHEN b.v IS NOT NULL THEN 'second' END AS used FROM part p LEFT JOIN (SELECT l_partkey AS k, min(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey) a ON a.k = p_partkey LEFT JOIN (SELECT l_partkey AS k, max(l_quantity) AS v FROM lineitem GROUP BY l_partkey) b ON b.k = p_partkey")
def jn20_coalesce_chain(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    a = li.filter("l_returnflag = 'A'").groupBy("p_partkey").agg(F.min("l_quantity").alias("a"))
    b = li.groupBy("p_partkey").agg(F.max("l_quantity").alias("b"))
    p = table(spark, sf_dir, "part").select("p_partkey").join(a, "p_partkey", "left").join(b, "p_partkey", "left")
    return p.select("p_partkey", F.coalesce("a", "b").alias("value"), F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second").alias("used"))


@query(with_views("v_reaches") + "SELECT entity_id, CASE WHEN observable THEN 1.0 WHEN NOT observable THEN 0.0 END AS observable_feature, CASE WHEN observable THEN 'observable' WHEN NOT observable THEN 'driver_only' ELSE 'unassessed' END AS obs_class FROM v_reaches")
def fn12_three_valued(spark, sf_dir):
    from ..functions.scalar import obs_class, three_valued

    return view(spark, sf_dir, "v_reaches").select("entity_id", three_valued(F.col("observable")).alias("observable_feature"), obs_class(F.col("observable")).alias("obs_class"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, list_sort([l_quantity, l_tax * 100, l_discount * 100])[1] AS q1, list_sort([l_quantity, l_tax * 100, l_discount * 100])[3] AS q3, list_sort([l_quantity, l_tax * 100, l_discount * 100]) <> [l_quantity, l_tax * 100, l_discount * 100] AS crossed FROM lineitem")
def fn11_rearranged(spark, sf_dir):
    from ..functions.scalar import rearranged

    q, crossed = rearranged([F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 100])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", q[0].alias("q1"), q[2].alias("q3"), crossed.alias("crossed"))

"""Walk-forward folds, support tracking, coefficient checks, corridors and per-weather calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import FIT_END, VAL_END, table, view, with_views
from ..operators import frame, probability, scenario, spatial
from ..sources import payloads
from .forecast_queries import BASE, SCORE, forecasts
from .frame_queries import ENDS, HORIZONS, forest_rows, frame_of
from .library_queries import DIST, SEGMENTS, _segments
from .registry import query, rounded

YEARS = (1997, 1998, 1999)


@query("""WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), c AS (SELECT CAST(y.y AS INTEGER) AS cut FROM generate_series(1997, 1999) y(y))
SELECT cut, count(*) FILTER (WHERE year(date) <= cut) AS n_train, count(*) FILTER (WHERE year(date) = cut + 1) AS n_test FROM o, c GROUP BY cut""")
def fr4_walk_forward(spark, sf_dir):
    """Expanding folds: all days up to a year's end, judged on the next year."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    folds = frame.walk_forward(days, YEARS)
    return folds.groupBy("cut").agg(F.count_if(F.col("part") == "train").alias("n_train"), F.count_if(F.col("part") == "test").alias("n_test"))


@query()
def fr6_feature_lists(spark, sf_dir):
    """The frame's features by variant, with the share of rows that miss each."""
    e = frame.embargoed(frame_of(spark, sf_dir), ENDS, HORIZONS)
    names = frame.feature_names(e.columns, "A")
    missing = e.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in names])
    own = frame.feature_names(e.columns, "B")
    return rounded(missing.unpivot([], names, "feature", "missing").withColumn("in_b", F.col("feature").isin(own)))


@query(f"""WITH r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem WHERE CAST(l_shipdate AS DATE) <= DATE '{FIT_END}')
SELECT l_suppkey AS entity_id, count(*) FILTER (WHERE l_quantity * 1.2 > hi OR l_quantity * 1.2 < lo) AS out_of_support, count(*) FILTER (WHERE l_quantity * 1.2 = l_quantity) AS no_change, count(*) AS n FROM lineitem, r WHERE CAST(l_shipdate AS DATE) > DATE '{FIT_END}' GROUP BY l_suppkey""")
def sc5_change_tracking(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("v"))
    cut = F.col("date") <= F.lit(FIT_END).cast("date")
    return scenario.tracked(li.filter(cut), li.filter(~cut).withColumn("after", F.col("v") * 1.2), "v", "after")


@query("SELECT p_partkey, unnest(CASE WHEN p_retailprice > 1000 THEN ['OUT_OF_BRACKET'] ELSE [] END || CASE WHEN p_size % 7 = 0 THEN ['NO_REFERENCE'] ELSE [] END) AS rule FROM part")
def sc1_coefficient_rules(spark, sf_dir):
    return payloads.rule_violations(table(spark, sf_dir, "part"), ["p_partkey"], {"OUT_OF_BRACKET": F.col("p_retailprice") <= 1000, "NO_REFERENCE": F.col("p_size") % 7 != 0})


@query()
def sc6_response_check(spark, sf_dir):
    """Whether the forest's median answers a feature raised by a standard deviation with the expected sign."""
    rows = forest_rows(spark, sf_dir)
    cut = F.col("date") <= F.lit(FIT_END).cast("date")
    return rounded(scenario.response_check(rows.filter(cut), rows.filter(~cut).filter(F.col("date") <= F.lit(VAL_END).cast("date")).dropDuplicates(["row_id"]), ["quantity", "discount", "tax"], "target"), 4)


@query(with_views("v_points", more=SEGMENTS + """, t AS (SELECT s.entity_id, p.point_id, p.label, x, y, x1, y1, x2, y2, CASE WHEN (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) > 0 THEN greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) ELSE 0.0 END AS t FROM seg s, v_points p)""")
       + "SELECT entity_id, count(*) AS n_pixels, round(30 * avg(CASE WHEN label >= 5 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS width FROM t WHERE " + DIST + " <= 30 GROUP BY entity_id")
def jn18_corridor_width(spark, sf_dir):
    """Vegetated share of the pixels within the corridor, times its width."""
    points = view(spark, sf_dir, "v_points")
    met = spatial.near_counts(_segments(spark, sf_dir), points, 30.0, "label").withColumn("green", F.when(F.col("label") >= 5, F.col("n")).otherwise(0))
    known = F.nullif(F.sum(F.when(F.col("label").isNotNull(), F.col("n"))), F.lit(0))
    return rounded(met.groupBy("entity_id").agg(F.sum("n").alias("n_pixels"), (30 * (F.sum("green") / known)).alias("width")))


@query(BASE.rstrip() + f""", w AS (SELECT *, CASE WHEN entity_id % 2 = 0 THEN 'ORACLE' ELSE 'ASISSUED' END AS weather FROM fc WHERE fold = 'val'), c AS (SELECT weather, variable, count(*) AS n, list_sort(list({SCORE})) AS s FROM w GROUP BY ALL)
SELECT weather, variable, n, round(s[CAST(ceil((n + 1) * 0.8) AS INTEGER)], 6) + 0.0 AS q_adjust FROM c WHERE ceil((n + 1) * 0.8) <= n""")
def pr10_fits_by_weather(spark, sf_dir):
    f = forecasts(spark, sf_dir).filter("fold = 'val'").withColumn("weather", F.when(F.col("entity_id") % 2 == 0, "ORACLE").otherwise("ASISSUED"))
    return rounded(probability.conformal_by(f, ["weather", "variable"]))

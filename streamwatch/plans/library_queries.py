"""Queries over networks, places, sources, sinks, sets, scenarios and serving tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import FIT_END, table, view, with_views
from ..operators import graph, linear, ranking, scenario, spatial
from ..sources import payloads, sinks
from .registry import query, rounded

# --- graph ---------------------------------------------------------------------------------------------------------


@query("WITH RECURSIVE " + with_views("v_topology", "v_reaches")[5:].rstrip() + """,
r AS (SELECT entity_id, entity_id AS reached_id, 0 AS hops FROM v_reaches UNION ALL SELECT r.entity_id, t.downstream_id, r.hops + 1 FROM r JOIN v_topology t ON t.upstream_id = r.reached_id WHERE r.hops < 3)
SELECT entity_id, reached_id, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY entity_id, reached_id""")
def gr7_downstream(spark, sf_dir):
    return graph.downstream(view(spark, sf_dir, "v_reaches"), view(spark, sf_dir, "v_topology"), 3)


@query("WITH RECURSIVE " + with_views("v_topology", "v_reaches")[5:].rstrip() + """,
r AS (SELECT entity_id, entity_id AS nd, 0 AS steps FROM v_reaches UNION ALL SELECT r.entity_id, t.downstream_id, r.steps + 1 FROM r JOIN v_topology t ON t.upstream_id = r.nd)
SELECT entity_id, nd AS outlet_id, CAST(steps AS BIGINT) AS steps FROM r WHERE nd NOT IN (SELECT upstream_id FROM v_topology)""")
def gr8_outlets(spark, sf_dir):
    return graph.outlets(view(spark, sf_dir, "v_topology"), view(spark, sf_dir, "v_reaches"))


@query("WITH RECURSIVE " + with_views("v_topology", "v_reaches")[5:].rstrip() + """,
r AS (SELECT entity_id AS nd, catchment_area_km2 AS a FROM v_reaches UNION ALL SELECT t.downstream_id, r.a FROM r JOIN v_topology t ON t.upstream_id = r.nd)
SELECT nd AS entity_id, round(sum(a), 6) + 0.0 AS contributing FROM r GROUP BY nd""")
def gr8_contributing_area(spark, sf_dir):
    return rounded(graph.contributing(view(spark, sf_dir, "v_topology"), view(spark, sf_dir, "v_reaches"), "catchment_area_km2"))


@query()
def gr3_strahler(spark, sf_dir):
    return graph.strahler(view(spark, sf_dir, "v_topology"), view(spark, sf_dir, "v_reaches"))


@query()
def gr4_of_order(spark, sf_dir):
    reaches = view(spark, sf_dir, "v_reaches")
    return graph.of_order(reaches.select("entity_id", "city"), graph.strahler(view(spark, sf_dir, "v_topology"), reaches), 2)


@query(with_views("v_topology", "v_reaches") + """SELECT t.upstream_id, t.downstream_id, round(a.catchment_area_km2, 6) + 0.0 AS up_area, round(b.catchment_area_km2, 6) + 0.0 AS down_area FROM v_topology t JOIN v_reaches a ON a.entity_id = t.upstream_id JOIN v_reaches b ON b.entity_id = t.downstream_id
WHERE a.catchment_area_km2 - b.catchment_area_km2 > greatest(0.01, 0.02 * a.catchment_area_km2)""")
def gr10_not_monotone(spark, sf_dir):
    return rounded(graph.not_monotone(view(spark, sf_dir, "v_topology"), view(spark, sf_dir, "v_reaches")).select("upstream_id", "downstream_id", "up_area", "down_area"))


WAYS = """w AS (SELECT o_custkey AS way_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, CAST(floor(o_totalprice) AS BIGINT) % 997 AS node_id, CAST(floor(o_totalprice) AS BIGINT) % 997 * 1.0 AS x, (CAST(floor(o_totalprice) AS BIGINT) % 997) % 31 * 1.0 AS y FROM orders)"""


@query("WITH " + WAYS + """, u AS (SELECT node_id, count(*) AS n FROM w GROUP BY node_id),
a AS (SELECT w.*, CASE WHEN u.n > 1 THEN 1 ELSE 0 END AS c, sqrt(power(x - lag(x) OVER p, 2) + power(y - lag(y) OVER p, 2)) AS step FROM w JOIN u USING (node_id) WINDOW p AS (PARTITION BY way_id ORDER BY pos)),
b AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS link FROM a)
SELECT way_id, CAST(link AS BIGINT) AS link, round(sum(step), 6) + 0.0 AS length, count(*) AS n_steps FROM b WHERE step IS NOT NULL GROUP BY way_id, link HAVING sum(step) > 0""")
def gr1_links(spark, sf_dir):
    return rounded(graph.links(_ways(spark, sf_dir)).select("way_id", "link", "length", "n_steps"))


def _ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    node = F.floor("o_totalprice").cast("long") % 997
    return o.select(F.col("o_custkey").alias("way_id"), pos.alias("pos"), node.alias("node_id")).withColumns({"x": F.col("node_id") * F.lit(1.0), "y": F.col("node_id") % 31 * F.lit(1.0)})


@query("""WITH n AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) / 100 AS length, CAST(greatest(1, round(CAST(o_totalprice AS DOUBLE) / 100 / 350), ceil(CAST(o_totalprice AS DOUBLE) / 100 / 500)) AS INTEGER) AS n FROM orders)
SELECT o_orderkey, CAST(p.p AS INTEGER) AS piece, round(p.p * length / n, 6) + 0.0 AS from_m, round((p.p + 1) * length / n, 6) + 0.0 AS to_m, CASE WHEN length / n < 200 THEN 'SHORT_LINK' END AS flag FROM n, generate_series(0, 60) p(p) WHERE p.p < n""")
def gr5_pieces(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice").cast("double") / 100).alias("length"))
    return rounded(graph.pieces(lines).select("o_orderkey", "piece", "from_m", "to_m", "flag"))


#: The box whose pieces are kept, of the ways' own coordinates.
STUDY = (100.5, 2.5, 800.5, 28.5)


@query("WITH " + WAYS + f""", s AS (SELECT way_id, pos, x AS x1, y AS y1, lead(x) OVER p AS x2, lead(y) OVER p AS y2 FROM w WINDOW p AS (PARTITION BY way_id ORDER BY pos)), t AS (SELECT *, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS len FROM s WHERE x2 IS NOT NULL),
c AS (SELECT *, sum(len) OVER (PARTITION BY way_id ORDER BY pos) AS b, sum(len) OVER (PARTITION BY way_id) AS total FROM t WHERE len > 0), l AS (SELECT way_id, any_value(total) AS total FROM c GROUP BY way_id),
n AS (SELECT *, CAST(CASE WHEN total <= 500 THEN 1 ELSE least(greatest(1, round(total / 350), ceil(total / 500)), greatest(1, floor(total / 200))) END AS INTEGER) AS n FROM l),
q AS (SELECT n.*, CAST(p.p AS INTEGER) AS piece, d.d AS part, total / n * (p.p + d.d) AS m FROM n, generate_series(0, 2000) p(p), (SELECT unnest([0.0, 0.5, 1.0]) AS d) d WHERE p.p < n),
f AS (SELECT q.*, c.x1 + (c.x2 - c.x1) * (q.m - (c.b - c.len)) / c.len AS x, c.y1 + (c.y2 - c.y1) * (q.m - (c.b - c.len)) / c.len AS y FROM q ASOF JOIN (SELECT *, CASE WHEN b - len < 1e-7 THEN -1.0 ELSE b - len END AS a FROM c) c ON q.way_id = c.way_id AND q.m - 1e-9 >= c.a),
g AS (SELECT way_id, piece, n AS n_pieces, total, max(x) FILTER (WHERE part = 0.0) AS x1, max(y) FILTER (WHERE part = 0.0) AS y1, max(x) FILTER (WHERE part = 0.5) AS mid_x, max(y) FILTER (WHERE part = 0.5) AS mid_y, max(x) FILTER (WHERE part = 1.0) AS x2, max(y) FILTER (WHERE part = 1.0) AS y2 FROM f GROUP BY ALL)
SELECT way_id, piece, n_pieces, round(total / n_pieces, 6) + 0.0 AS length, {", ".join(f"round({k}, 4) + 0.0 AS {k}" for k in ("x1", "y1", "mid_x", "mid_y", "x2", "y2"))}, mid_x > {STUDY[0]} AND mid_x < {STUDY[2]} AND mid_y > {STUDY[1]} AND mid_y < {STUDY[3]} AS inside, CASE WHEN total < 200 THEN 'SHORT_LINK' END AS flag FROM g""")
def gr5_cut_lines(spark, sf_dir):
    """The pieces of whole ways: their ends, middles and lengths on the ground, and whether they belong to the study box."""
    cut = linear.cut_lines(_ways(spark, sf_dir), ["way_id"], STUDY)
    first, last = F.col("line")[0], F.element_at("line", -1)
    ends = {"x1": first["x"], "y1": first["y"], "mid_x": F.col("mid_x"), "mid_y": F.col("mid_y"), "x2": last["x"], "y2": last["y"]}
    return rounded(cut.select("way_id", "piece", "n_pieces", "length", *[(F.round(c, 4) + 0.0).alias(k) for k, c in ends.items()], "inside", "flag"))


@query(with_views("v_topology", "v_reaches") + """SELECT r.entity_id, coalesce((SELECT list_sort(list(upstream_id)) FROM v_topology t WHERE t.downstream_id = r.entity_id), []) AS upstream_ids FROM v_reaches r""")
def sq2_entity_detail(spark, sf_dir):
    up = view(spark, sf_dir, "v_topology").groupBy(F.col("downstream_id").alias("entity_id")).agg(F.array_sort(F.collect_list("upstream_id")).alias("upstream_ids"))
    return view(spark, sf_dir, "v_reaches").select("entity_id").join(up, "entity_id", "left").select("entity_id", F.coalesce("upstream_ids", F.array().cast("array<bigint>")).alias("upstream_ids"))


# --- places --------------------------------------------------------------------------------------------------------

SEGMENTS = "seg AS (SELECT s_suppkey AS entity_id, (s_suppkey * 37 % 600) - 300.0 AS x1, (s_suppkey * 91 % 600) - 300.0 AS y1, (s_suppkey * 53 % 600) - 300.0 AS x2, (s_suppkey * 71 % 600) - 300.0 AS y2 FROM supplier)"
DIST = "sqrt(power(x - (x1 + t * (x2 - x1)), 2) + power(y - (y1 + t * (y2 - y1)), 2))"
NEAR = SEGMENTS + """, t AS (SELECT s.entity_id, p.point_id, p.label, x, y, x1, y1, x2, y2, CASE WHEN (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) > 0 THEN greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) ELSE 0.0 END AS t FROM seg s, v_points p),
near AS (SELECT entity_id, point_id, label, """ + DIST + " AS distance FROM t WHERE " + DIST + " <= 25)"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.col("s_suppkey") * k % 600 - 300.0
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), at(37).alias("x1"), at(91).alias("y1"), at(53).alias("x2"), at(71).alias("y2"))


@query(with_views("v_points", more=NEAR) + "SELECT s.entity_id, l.label AS feature_type, count(n.point_id) AS n_features, round(min(n.distance), 6) + 0.0 AS nearest_distance FROM seg s CROSS JOIN (SELECT DISTINCT label FROM v_points) l LEFT JOIN near n ON n.entity_id = s.entity_id AND n.label = l.label GROUP BY s.entity_id, l.label")
def jn14_exposure(spark, sf_dir):
    points = view(spark, sf_dir, "v_points")
    return rounded(spatial.exposure(_segments(spark, sf_dir), points, "label", points.select(F.col("label").alias("feature_type")), 25.0))


@query(with_views("v_points", more=NEAR) + "SELECT s.entity_id, CASE WHEN count(n.point_id) FILTER (WHERE n.label = 0) = 0 THEN count(n.point_id) END AS population, CASE WHEN count(n.point_id) FILTER (WHERE n.label = 0) > 0 THEN 'NODATA_IN_BUFFER' END AS flag FROM seg s LEFT JOIN near n ON n.entity_id = s.entity_id GROUP BY s.entity_id")
def jn15_population(spark, sf_dir):
    points = view(spark, sf_dir, "v_points")
    met = spatial.near_counts(_segments(spark, sf_dir), points, 25.0, "label").groupBy("entity_id")
    out = _segments(spark, sf_dir).select("entity_id").join(met.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == 0, F.col("n"))).alias("gone")), "entity_id", "left")
    n, gone = F.coalesce("n", F.lit(0)), F.coalesce("gone", F.lit(0))
    return out.select("entity_id", F.when(gone == 0, n).alias("population"), F.when(gone > 0, "NODATA_IN_BUFFER").alias("flag"))


@query(with_views("v_points", more="zone AS (SELECT s_suppkey AS zone_id, (s_suppkey * 37 % 400) - 300.0 AS x0, (s_suppkey * 91 % 400) - 300.0 AS y0 FROM supplier)") + """SELECT z.zone_id, CASE WHEN count(p.point_id) > 0 THEN count(p.point_id) END AS n_pixels, round(sum(p.label), 6) + 0.0 AS total, round(avg(p.label), 6) + 0.0 AS mean, CASE WHEN count(p.point_id) = 0 THEN 'NO_PIXELS' ELSE 'OK' END AS flag
FROM zone z LEFT JOIN v_points p ON p.x >= x0 AND p.x < x0 + 120 AND p.y >= y0 AND p.y < y0 + 120 AND (p.x - x0) + (p.y - y0) < 180 GROUP BY z.zone_id""")
def jn16_zonal(spark, sf_dir):
    pixels = view(spark, sf_dir, "v_points").select("x", "y", F.col("label").cast("double").alias("value"))
    x0, y0 = F.col("s_suppkey") * 37 % 400 - 300.0, F.col("s_suppkey") * 91 % 400 - 300.0
    corner = lambda dx, dy: F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y"))
    zones = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("zone_id"), F.array(corner(0, 0), corner(120, 0), corner(120, 60), corner(60, 120), corner(0, 120)).alias("ring"))
    return rounded(spatial.zonal(pixels, zones, 60.0).select("zone_id", "n_pixels", "total", "mean", "flag"))


@query(with_views("v_exposure") + "SELECT entity_id, CAST(sum(n_features) AS BIGINT) AS total, max(CASE WHEN feature_type = 'BUILDING' THEN n_features END) AS building FROM v_exposure GROUP BY entity_id")
def jn21_exposure_map(spark, sf_dir):
    m = view(spark, sf_dir, "v_exposure").groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature_type", "n_features")))).alias("counts"))
    return m.select("entity_id", F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.try_element_at("counts", F.lit("BUILDING")).alias("building"))


@query(with_views("v_exposure") + "SELECT feature_type, count(DISTINCT entity_id) AS n_entities, CAST(sum(n_features) AS BIGINT) AS total FROM v_exposure GROUP BY feature_type")
def ag37_exposure_summary(spark, sf_dir):
    return view(spark, sf_dir, "v_exposure").groupBy("feature_type").agg(F.count_if(F.col("n_features") > 0).alias("n_entities"), F.sum("n_features").alias("total"))


@query(with_views("v_exposure") + "SELECT feature_type, list_sort(list_distinct(list(entity_id))) AS entity_ids FROM v_exposure GROUP BY feature_type")
def sq6_exposure_layer(spark, sf_dir):
    return view(spark, sf_dir, "v_exposure").groupBy("feature_type").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))


# --- sources and sinks -----------------------------------------------------------------------------------------------


@query(with_views("v_hourly") + "SELECT entity_id, ts, round(precip, 6) + 0.0 AS precip, round(temp, 6) + 0.0 AS temp FROM v_hourly")
def src1_hourly_payload(spark, sf_dir):
    h = view(spark, sf_dir, "v_hourly").groupBy("entity_id", F.to_date("ts").alias("d")).agg(F.array_sort(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("t"), "precip", "temp"))).alias("r"))
    text = F.to_json(F.struct(F.struct(F.col("r.t").alias("time"), F.col("r.precip").cast("array<string>").alias("precip"), F.col("r.temp").cast("array<string>").alias("temp")).alias("hourly")))
    return rounded(payloads.hourly(h.select("entity_id", text.alias("payload")), "payload", ["precip", "temp"]).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query(with_views("v_obs") + "SELECT entity_id, obs_date, water_pixel_count - 1 AS n_data, CAST(round(0.25 * (water_pixel_count - 1)) AS BIGINT) AS n_water FROM v_obs WHERE quality_flag <> 'CLOUD'")
def src3_zonal_payload(spark, sf_dir):
    o = view(spark, sf_dir, "v_obs")
    item = F.struct(F.col("obs_date").cast("string").alias("from"), F.when(F.col("quality_flag") == "CLOUD", "failed").alias("error"), F.struct(F.lit("0.25").alias("mean"), F.col("water_pixel_count").alias("sampleCount"), F.lit(1).alias("noDataCount")).alias("stats"))
    p = o.withColumn("item", item).groupBy("entity_id").agg(F.to_json(F.collect_list("item")).alias("payload"))
    return payloads.zonal_intervals(p, "payload")[0].select("entity_id", "obs_date", F.col("n_data").cast("int").alias("n_data"), "n_water")


@query("SELECT event_type, CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) IS NOT NULL AND event_type = 'click' THEN 'CLICKED' WHEN event_type IN ('view', 'error') THEN 'SEEN' END AS class, count(*) AS n FROM events GROUP BY ALL")
def src6_classified_tags(spark, sf_dir):
    tags = F.create_map(F.lit("type"), F.col("event_type"), F.col("event_type"), F.lit("yes"))
    c = payloads.classify_tags(tags, [("click", None, "CLICKED"), ("type", "view", "SEEN"), ("type", "error", "SEEN")])
    return table(spark, sf_dir, "events").select("event_type", c.alias("class")).groupBy("event_type", "class").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, arg_min(y, (abs(y - 1998), -y)) AS year FROM (SELECT DISTINCT l_suppkey, year(l_shipdate) AS y FROM lineitem WHERE year(l_shipdate) <> 1998) q GROUP BY l_suppkey")
def src11_nearest_year(spark, sf_dir):
    years = table(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year")).filter("year <> 1998").distinct()
    return payloads.nearest_year(years, ["l_suppkey"], "year", 1998)


OLD = "old_ AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) AS price, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0), new_ AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) * 2 AS price, 'N' AS status FROM orders WHERE o_orderkey % 2 = 0)"


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("double")
    old = o.filter("o_orderkey % 3 <> 0").select("o_orderkey", "o_custkey", price.alias("price"), F.col("o_orderstatus").alias("status"))
    return old, o.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey", (price * 2).alias("price"), F.lit("N").alias("status"))


@query("WITH " + OLD + " SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_custkey, round(CASE WHEN b.o_orderkey IS NOT NULL THEN b.price ELSE a.price END, 6) + 0.0 AS price, a.status FROM old_ a FULL JOIN new_ b ON a.o_orderkey = b.o_orderkey")
def snk1_upsert(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return rounded(sinks.upsert(old, new, ["o_orderkey"], ["price"]))


@query("WITH " + OLD + " SELECT o_orderkey, o_custkey, round(price, 6) + 0.0 AS price, status FROM old_ WHERE NOT o_custkey % 2 = 0 UNION ALL SELECT o_orderkey, o_custkey, round(price, 6) + 0.0, status FROM new_")
def snk2_replace_slice(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return rounded(sinks.replace_slice(old, new, F.col("o_custkey") % 2 == 0))


@query("WITH " + OLD + " SELECT o_orderkey, o_custkey, round(price, 6) + 0.0 AS price, status FROM old_ WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new_) UNION ALL SELECT o_orderkey, o_custkey, round(price, 6) + 0.0, status FROM new_")
def snk3_merge_by_key(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return rounded(sinks.merge_by_key(old, new, ["o_orderkey"]))


@query("SELECT CASE WHEN l_quantity < 10 THEN 'SMALL' WHEN l_discount > 0.08 THEN 'DISCOUNTED' ELSE 'KEPT' END AS reason, count(*) AS n FROM lineitem GROUP BY ALL")
def snk5_stage_accounting(spark, sf_dir):
    return sinks.accounting(table(spark, sf_dir, "lineitem"), F.when(F.col("l_quantity") < 10, "SMALL").when(F.col("l_discount") > 0.08, "DISCOUNTED"))


@query(with_views("v_obs") + "SELECT entity_id, obs_date, r AS rule FROM (SELECT entity_id, obs_date, unnest(CASE WHEN turbidity_proxy > 200 THEN ['range'] ELSE [] END || CASE WHEN water_pixel_count < 3 THEN ['pixels'] ELSE [] END) AS r FROM v_obs) q")
def snk6_rule_violations(spark, sf_dir):
    return payloads.rule_violations(view(spark, sf_dir, "v_obs"), ["entity_id", "obs_date"], {"range": F.col("turbidity_proxy") <= 200, "pixels": F.col("water_pixel_count") >= 3})


@query("WITH " + OLD + " SELECT b.o_orderkey, b.o_custkey, round(b.price, 6) + 0.0 AS price, CASE WHEN a.o_custkey = b.o_custkey THEN a.status END AS status FROM new_ b LEFT JOIN old_ a ON a.o_orderkey = b.o_orderkey")
def snk7_carry_over(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return rounded(sinks.carry_over(old, new, "o_orderkey", "o_custkey", ["status"]).select("o_orderkey", "o_custkey", "price", "status"))


@query("SELECT max(d) AS last, count(*) AS n FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders UNION ALL SELECT CAST(l_shipdate AS DATE) FROM lineitem) q")
def so1_latest_run_date(spark, sf_dir):
    o, l = (table(spark, sf_dir, t).select(F.to_date(c).alias("d")) for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate")))
    return o.unionByName(l).agg(F.max("d").alias("last"), F.count("*").alias("n"))


@query(with_views("v_topology") + "SELECT upstream_id, downstream_id FROM v_topology UNION SELECT s_suppkey, s_suppkey + 1 FROM supplier")
def so4_edge_union(spark, sf_dir):
    return view(spark, sf_dir, "v_topology").union(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey") + 1)).distinct()


# --- selection -------------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256('salt' || CAST(s_suppkey AS VARCHAR)), s_suppkey) AS k, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT s_nationkey, s_suppkey, k <= CASE WHEN n >= 2 THEN greatest(1, round(n * 0.2)) ELSE round(n * 0.2) END AS held_out FROM r""")
def tk3_holdout(spark, sf_dir):
    return ranking.holdout(table(spark, sf_dir, "supplier"), "s_suppkey", 0.2, "salt", "s_nationkey")


@query("SELECT s_suppkey, 'R-' || CAST(s_nationkey AS VARCHAR) || '-' || lpad(CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS VARCHAR), 4, '0') AS stable_id FROM supplier")
def tk4_stable_ids(spark, sf_dir):
    return ranking.stable_ids(table(spark, sf_dir, "supplier"), "s_nationkey", [F.desc("s_acctbal"), "s_suppkey"], "R").select("s_suppkey", "stable_id")


@query("""WITH c AS (SELECT l_orderkey, 'f' || l_linenumber || '-' || l_partkey AS feature, CAST(l_tax AS DOUBLE) - CAST(l_discount AS DOUBLE) AS v FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY -abs(v), feature) AS k FROM c WHERE v <> 0)
SELECT l_orderkey, CAST(k AS INTEGER) AS k, feature, round(v, 6) + 0.0 AS contribution FROM r WHERE k <= 2""")
def tk2_top_drivers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    c = F.struct(F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("feature"), (F.col("l_tax").cast("double") - F.col("l_discount").cast("double")).alias("contribution"))
    g = li.groupBy("l_orderkey").agg(F.collect_list(c).alias("c")).select("l_orderkey", F.posexplode(ranking.top_drivers(F.col("c"), 2)).alias("k", "d"))
    return rounded(g.select("l_orderkey", (F.col("k") + 1).alias("k"), "d.feature", "d.contribution"))


@query(with_views("v_reaches") + "SELECT city, count(*) AS n, count(*) FILTER (WHERE observable) AS observable, count(*) FILTER (WHERE NOT observable) AS driver_only, count(*) FILTER (WHERE observable IS NULL) AS unassessed FROM v_reaches GROUP BY city")
def sq1_city_counts(spark, sf_dir):
    o = F.col("observable")
    return view(spark, sf_dir, "v_reaches").groupBy("city").agg(F.count("*").alias("n"), F.count_if(o).alias("observable"), F.count_if(~o).alias("driver_only"), F.count_if(o.isNull()).alias("unassessed"))


@query(with_views("v_obs") + "SELECT entity_id, obs_date, quality_flag, round(turbidity_proxy, 6) + 0.0 AS turbidity_proxy FROM (SELECT *, max(obs_date) OVER (PARTITION BY entity_id) AS last FROM v_obs) q WHERE obs_date > last - 90")
def sq3_observation_history(spark, sf_dir):
    o = view(spark, sf_dir, "v_obs").withColumn("last", F.max("obs_date").over(Window.partitionBy("entity_id"))).filter("obs_date > date_sub(last, 90)")
    return rounded(o.select("entity_id", "obs_date", "quality_flag", "turbidity_proxy"))


# --- tables as features ----------------------------------------------------------------------------------------------


@query("SELECT 'l_tax' AS feature, round(min(CAST(l_tax AS DOUBLE)), 6) + 0.0 AS low, round(max(CAST(l_tax AS DOUBLE)), 6) + 0.0 AS high FROM lineitem WHERE l_shipdate <= DATE '1998-12-31' UNION ALL SELECT 'l_discount', round(min(CAST(l_discount AS DOUBLE)), 6) + 0.0, round(max(CAST(l_discount AS DOUBLE)), 6) + 0.0 FROM lineitem WHERE l_shipdate <= DATE '1998-12-31'")
def ag27_training_ranges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter(F.to_date("l_shipdate") <= F.lit(FIT_END).cast("date")).select(*[F.col(c).cast("double").alias(c) for c in ("l_tax", "l_discount")])
    return rounded(li.unpivot([], ["l_tax", "l_discount"], "feature", "v").groupBy("feature").agg(F.min("v").alias("low"), F.max("v").alias("high")))


@query("SELECT l_orderkey, count(DISTINCT l_suppkey) + CAST(max(CASE WHEN l_suppkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_values, count(DISTINCT l_suppkey) <= 1 AS static FROM lineitem GROUP BY l_orderkey")
def ag28_static_check(spark, sf_dir):
    n = F.count_distinct("l_suppkey") + F.max(F.col("l_suppkey").isNull().cast("long"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(n.alias("n_values")).withColumn("static", F.col("n_values") <= 1)


@query("SELECT l_returnflag, f AS feature, round(avg(abs(v)), 6) + 0.0 AS mean_abs, round(avg(abs(v)) / sum(avg(abs(v))) OVER (PARTITION BY l_returnflag), 6) + 0.0 AS share FROM (SELECT l_returnflag, unnest(['tax', 'discount']) AS f, unnest([CAST(l_tax AS DOUBLE), CAST(l_discount AS DOUBLE)]) AS v FROM lineitem) q GROUP BY l_returnflag, f")
def ag30_attribution_share(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_tax").cast("double").alias("tax"), F.col("l_discount").cast("double").alias("discount"))
    g = li.unpivot("l_returnflag", ["tax", "discount"], "feature", "v").groupBy("l_returnflag", "feature").agg(F.avg(F.abs("v")).alias("mean_abs"))
    return rounded(g.withColumn("share", F.col("mean_abs") / F.sum("mean_abs").over(Window.partitionBy("l_returnflag"))))


@query("SELECT l_returnflag, round(sum(CAST(l_extendedprice AS DOUBLE)) / sum(CAST(l_quantity AS DOUBLE)), 6) + 0.0 AS rate FROM lineitem GROUP BY l_returnflag")
def ag34_weighted_rate(spark, sf_dir):
    return rounded(table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg((F.sum(F.col("l_extendedprice").cast("double")) / F.sum(F.col("l_quantity").cast("double"))).alias("rate")))


@query(with_views("v_obs") + "SELECT count(*) AS n, round(avg(CASE WHEN turbidity_proxy IS NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS turbidity_missing, round(avg(CASE WHEN ndci IS NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS ndci_missing FROM v_obs")
def ag26_frame_summary(spark, sf_dir):
    miss = lambda c: F.avg(F.col(c).isNull().cast("double"))
    return rounded(view(spark, sf_dir, "v_obs").agg(F.count("*").alias("n"), miss("turbidity_proxy").alias("turbidity_missing"), miss("ndci").alias("ndci_missing")))


# --- scenarios -------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, l.lever, round(CASE l.lever WHEN 'floor' THEN greatest(v, 30.0) WHEN 'treated' THEN v - 0.25 * greatest(v - 10.0, 0) ELSE v * (1 - 0.2) END, 6) + 0.0 AS perturbed, CASE WHEN CASE l.lever WHEN 'floor' THEN greatest(v, 30.0) WHEN 'treated' THEN v - 0.25 * greatest(v - 10.0, 0) ELSE v * 0.8 END = v THEN 'NO_CHANGE' END AS note
FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS v FROM part) p, (SELECT unnest(['floor', 'treated', 'scale']) AS lever) l""")
def sc3_perturb(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("v"), F.explode(F.array(*[F.lit(x) for x in ("floor", "treated", "scale")])).alias("lever"))
    out = scenario.perturbed(F.col("v"), F.col("lever"), floor=30.0, share=0.25, residual=10.0, scale=0.2)
    return rounded(p.withColumn("perturbed", out).select("p_partkey", "lever", "perturbed", F.when(F.col("perturbed") == F.col("v"), "NO_CHANGE").alias("note")))


@query("SELECT o_orderkey, round(greatest(0.0, least(365.0 - 1.5 * w, c - 0.75 * w)), 6) + 0.0 AS low, round(greatest(0.0, least(365.0 - 1.5 * w, c - 0.75 * w)) + 1.5 * w, 6) + 0.0 AS high FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) / 2000 AS c, 20 + o_custkey % 50 AS w FROM orders WHERE CAST(o_totalprice AS DOUBLE) / 2000 <= 365) q")
def sc9_widened_interval(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice").cast("double") / 2000).alias("c"), (20 + F.col("o_custkey") % 50).cast("double").alias("w")).filter("c <= 365")
    low, high = scenario.widened(F.col("c"), F.col("w"), 1.5, 0.0, 365.0)
    return rounded(o.select("o_orderkey", low.alias("low"), high.alias("high")))


@query(with_views("v_reaches") + "SELECT entity_id, round(10 * CAST(abs(catchment_area_km2) AS DOUBLE), 6) + 0.0 AS unit_total FROM v_reaches WHERE catchment_area_km2 > 0")
def sc10_cost(spark, sf_dir):
    return rounded(view(spark, sf_dir, "v_reaches").filter("catchment_area_km2 > 0").select("entity_id", (F.abs("catchment_area_km2") * 10).alias("unit_total")))


#: Lines are cut into parts of at most so many metres.
PART = 10.0


@query("WITH " + SEGMENTS + f""", zone AS (SELECT s_suppkey AS zone_id, (s_suppkey * 37 % 400) - 300.137 AS x0, (s_suppkey * 91 % 400) - 300.291 AS y0, CASE WHEN s_suppkey % 7 <> 0 THEN 0.0126 END AS area FROM supplier),
p AS (SELECT *, sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) AS len FROM seg), q AS (SELECT *, CAST(ceil(len / {PART}) AS INTEGER) AS n FROM p WHERE len > 0),
m AS (SELECT x1 + (x2 - x1) * (k.k + 0.5) / n AS x, y1 + (y2 - y1) * (k.k + 0.5) / n AS y, len / n AS v FROM q, generate_series(0, 200) k(k) WHERE k.k < n),
t AS (SELECT z.zone_id, any_value(z.area) AS area, coalesce(sum(m.v), 0.0) AS length_m FROM zone z LEFT JOIN m ON m.x >= x0 AND m.x < x0 + 120 AND m.y >= y0 AND m.y < y0 + 120 AND (m.x - x0) + (m.y - y0) < 180 GROUP BY z.zone_id)
SELECT zone_id, round(length_m, 6) + 0.0 AS length_m, round(length_m / 1000 / area, 6) + 0.0 AS density, CASE WHEN area IS NULL THEN 'NO_AREA' END AS flag FROM t""")
def jn17_zone_density(spark, sf_dir):
    """Length of all lines within each five-cornered zone over its area; every seventh zone's area isn't known."""
    at = lambda k, off: F.col("s_suppkey") * k % 400 - F.lit(off)
    x0, y0 = at(37, 300.137), at(91, 300.291)
    corner = lambda dx, dy: F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y"))
    ring = F.array(corner(0, 0), corner(120, 0), corner(120, 60), corner(60, 120), corner(0, 120))
    zones = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("zone_id"), ring.alias("ring"), F.when(F.col("s_suppkey") % 7 != 0, 0.0126).alias("area_km2"))
    return rounded(spatial.line_density(_segments(spark, sf_dir), zones, 120.0, PART))

"""The tables that queries run on, as views over the star-schema and event tables. The SQL is portable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("supplier", "customer", "orders", "lineitem", "events", "nation", "part", "embeddings")

VIEWS = {
    # flagged observations; the supplier is the entity. Sums of doubles differ in their last digits by order, so values
    # have 9 and 12 digits: equal ones are equal in any engine
    "v_obs": """
SELECT entity_id, obs_date, 'S2' AS source, quality_flag, water_pixel_count,
       CASE WHEN quality_flag = 'OK' THEN ROUND(t, 9) END AS turbidity_proxy,
       CASE WHEN quality_flag = 'OK' THEN ROUND((d - x) / NULLIF(d + x, 0), 12) END AS ndci
FROM (SELECT l_suppkey AS entity_id, CAST(l_shipdate AS DATE) AS obs_date,
             SUM(CAST(l_extendedprice AS DOUBLE)) / 1000 AS t, AVG(CAST(l_discount AS DOUBLE)) AS d, AVG(CAST(l_tax AS DOUBLE)) AS x,
             CAST(SUM(l_quantity) AS INT) AS water_pixel_count,
             CASE WHEN MAX(CAST(l_discount AS DOUBLE)) >= 0.0999E0 THEN 'CLOUD'
                  WHEN SUM(l_quantity) < 10 THEN 'NO_WATER_PIXELS' ELSE 'OK' END AS quality_flag
      FROM {lineitem} GROUP BY l_suppkey, CAST(l_shipdate AS DATE)) q""",
    # hourly feed; absent hours are missing data
    "v_hourly": """
SELECT event_type AS entity_id, date_trunc('hour', ts) AS ts, SUM(value) AS precip, AVG(value) AS temp
FROM {events} GROUP BY event_type, date_trunc('hour', ts)""",
    # daily weather of one cell
    "v_weather": """
SELECT 0 AS cell_id, CAST(o_orderdate AS DATE) AS date,
       SUM(CASE WHEN o_orderpriority LIKE '1%' THEN 1.0E0 ELSE 0.0E0 END) AS precip_mm,
       MAX(CAST(o_totalprice AS DOUBLE)) / 100000 AS precip_max_hourly, AVG(CAST(o_totalprice AS DOUBLE)) / 10000 AS temp_mean_c
FROM {orders} GROUP BY CAST(o_orderdate AS DATE)""",
    # a binary tree that drains to the smallest key
    "v_topology": """
SELECT u.s_suppkey AS upstream_id, d.s_suppkey AS downstream_id
FROM {supplier} u JOIN {supplier} d ON d.s_suppkey = CAST(FLOOR(u.s_suppkey / 2) AS BIGINT)
WHERE u.s_suppkey <> d.s_suppkey""",
    "v_reaches": """
SELECT s_suppkey AS entity_id, CAST(s_acctbal AS DOUBLE) AS catchment_area_km2, s_nationkey AS city,
       CASE WHEN s_suppkey % 5 = 0 THEN FALSE WHEN s_suppkey % 5 = 1 THEN NULL ELSE TRUE END AS observable
FROM {supplier}""",
    "v_exposure": """
SELECT s_suppkey AS entity_id, c_mktsegment AS feature_type, COUNT(*) AS n_features
FROM {supplier} JOIN {customer} ON s_nationkey = c_nationkey GROUP BY s_suppkey, c_mktsegment""",
    "v_points": """
SELECT vec_id AS point_id, CAST(embedding[1] AS DOUBLE) * 1000 AS x, CAST(embedding[2] AS DOUBLE) * 1000 AS y, label
FROM {embeddings}""",
}
#: Arrays count from 0 in one dialect and from 1 in the other; a city's customers are counted once, not for each of its entities.
SPARK_TEXT = {
    "v_points": VIEWS["v_points"].replace("embedding[2]", "embedding[1]").replace("embedding[1]", "embedding[0]", 1),
    "v_exposure": """
SELECT s_suppkey AS entity_id, c_mktsegment AS feature_type, SUM(n) AS n_features
FROM {supplier} JOIN (SELECT c_nationkey, c_mktsegment, COUNT(*) AS n FROM {customer} GROUP BY c_nationkey, c_mktsegment) c
  ON s_nationkey = c_nationkey GROUP BY s_suppkey, c_mktsegment""",
}

#: End of the fitting period; the validation year follows.
FIT_END, VAL_END = "1998-12-31", "1999-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = SPARK_TEXT.get(name, VIEWS[name])
    used = [t for t in TABLES if "{" + t + "}" in text]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def with_views(*names: str, more: str = "") -> str:
    """WITH clause that defines the views by name, and more expressions after them."""
    texts = [f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names]
    return "WITH " + ",\n".join([*texts, *([more] if more else [])]) + "\n"

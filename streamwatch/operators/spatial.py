"""Proximity and containment joins on a grid: cells first, exact geometry after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / length))).otherwise(0.0)
    return F.sqrt(F.pow(px - (x1 + t * dx), 2) + F.pow(py - (y1 + t * dy), 2))


def _spread(df: DataFrame, *columns: str) -> DataFrame:
    """df in as many parts as shuffles have: few bytes make much work here, so they aren't put together by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def _shapes(segments: DataFrame) -> DataFrame:
    """entity_id, shape: an entity's segments as one sorted array, so that entities of equal segments have equal shapes."""
    return segments.groupBy("entity_id").agg(F.array_sort(F.collect_set(F.struct("x1", "y1", "x2", "y2"))).alias("shape"))


def _near_shapes(shapes: DataFrame, points: DataFrame, buffer: float) -> DataFrame:
    """points with the distance and the shape of each of the different shapes that they lie within the buffer of.

    A segment goes to the cells that its buffer meets, a point to its own; so a point meets a shape once, with all of the
    shape's segments that can be near.
    """
    size = max(2 * buffer, 1e-9)
    lo = lambda a, b: _cell(F.least(F.col(a), F.col(b)) - buffer, size)
    hi = lambda a, b: _cell(F.greatest(F.col(a), F.col(b)) + buffer, size)
    s = shapes.select("shape").distinct().select("shape", F.explode("shape").alias("s")).select("shape", "s", "s.*")
    s = s.withColumn("cx", F.explode(F.sequence(lo("x1", "x2"), hi("x1", "x2")))).withColumn("cy", F.explode(F.sequence(lo("y1", "y2"), hi("y1", "y2"))))
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    middle = segment_distance((F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size, *ends)
    s = s.filter(middle <= buffer + 0.71 * size + 1e-6).groupBy("shape", "cx", "cy").agg(F.collect_list("s").alias("_segments"))
    p = points.withColumns({"cx": _cell(F.col("x"), size), "cy": _cell(F.col("y"), size)})
    d = F.array_min(F.transform("_segments", lambda e: segment_distance(F.col("x"), F.col("y"), e["x1"], e["y1"], e["x2"], e["y2"])))
    return p.join(s, ["cx", "cy"]).withColumn("distance", d).filter(F.col("distance") <= buffer).drop("cx", "cy", "_segments")


def near_lines(segments: DataFrame, points: DataFrame, buffer: float) -> DataFrame:
    """entity_id, point_id, distance of points within the buffer of an entity's segments (x1, y1, x2, y2)."""
    shapes = _shapes(segments)
    met = _near_shapes(shapes, points.select("point_id", "x", "y"), buffer).groupBy("shape", "point_id").agg(F.min("distance").alias("distance"))
    return shapes.join(met, "shape").select("entity_id", "point_id", "distance")


def near_counts(segments: DataFrame, points: DataFrame, buffer: float, kind: str) -> DataFrame:
    """entity_id, the kind, n and least distance of an entity's near points (x, y and the kind), a row a kind that it has.

    Points of one place and kind and entities of the same segments are counted together: no pair of a point and an entity
    is shuffled, and the work follows the different places and shapes.
    """
    shapes = _shapes(segments)
    places = _spread(points.select("x", "y", kind), "x", "y").groupBy("x", "y", kind).agg(F.count("*").alias("_n"))
    met = _near_shapes(shapes, places, buffer).groupBy("shape", kind).agg(F.sum("_n").alias("n"), F.min("distance").alias("distance"))
    return shapes.join(met, "shape").drop("shape")


def exposure(segments: DataFrame, points: DataFrame, kind: str, kinds: DataFrame, buffer: float) -> DataFrame:
    """Count and least distance by entity and kind; kinds without a feature keep the count 0."""
    counted = near_counts(segments, points, buffer, kind).select("entity_id", F.col(kind).alias("feature_type"), F.col("n").alias("n_features"), F.col("distance").alias("nearest_distance"))
    key = F.lit(0)
    grid = segments.select("entity_id").distinct().withColumn("_k", key).join(kinds.select("feature_type").distinct().withColumn("_k", key), "_k").drop("_k")
    return grid.join(counted, ["entity_id", "feature_type"], "left").withColumn("n_features", F.coalesce("n_features", F.lit(0)))


def zonal(pixels: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """Count, sum, mean and coverage flag of pixel values (x, y, value) whose centres lie in polygons (zone_id, ring).

    ring is an array of (x, y); the crossing rule decides. Polygons go to the cells of their boxes. Pixels of one place are
    added up first and polygons of the same ring are met once, so the work follows the different places and rings.
    """
    places = _spread(pixels.select("x", "y", "value"), "x", "y").groupBy("x", "y").agg(F.count("*").alias("_n"), F.count("value").alias("_v"), F.sum("value").alias("_s"))
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    n = F.size("ring")
    edges = F.zip_with("ring", F.concat(F.slice("ring", 2, n), F.slice("ring", 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cells = lambda v: F.explode(F.sequence(_cell(F.array_min(v), size), _cell(F.array_max(v), size)))
    z = polygons.select("ring").distinct().withColumn("_edges", edges).withColumn("cx", cells(xs)).withColumn("cy", cells(ys))
    p = places.withColumns({"cx": _cell(F.col("x"), size), "cy": _cell(F.col("y"), size)})
    px, py = F.col("x"), F.col("y")

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > py) != (b["y"] > py)) & (px < (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"])

    inside = F.size(F.filter("_edges", crosses)) % 2 == 1
    met = _spread(p, "cx", "cy").join(_spread(z, "cx", "cy"), ["cx", "cy"]).filter(inside)
    hit = met.groupBy("ring").agg(F.sum("_n").alias("n_pixels"), F.sum("_v").alias("n_valid"), F.sum("_s").alias("total")).withColumn("mean", F.col("total") / F.nullif(F.col("n_valid"), F.lit(0)))
    flag = F.when(F.col("n_pixels").isNull(), "NO_PIXELS").when(F.col("n_valid") < F.col("n_pixels"), "PARTIAL_COVERAGE").otherwise("OK")
    return polygons.select("zone_id", "ring").join(hit, "ring", "left").drop("ring").withColumn("flag", flag)


def line_density(segments: DataFrame, polygons: DataFrame, size: float, step: float) -> DataFrame:
    """zone_id, length_m, density (km of line a km2) and flag of polygons (zone_id, ring, area_km2).

    A segment (x1, y1, x2, y2) is cut into equal parts of at most `step`, and a part counts where its middle lies: so a
    polygon's length is off by less than a step for each crossing of its edge. A polygon without a line has 0; without an
    area over 0 it has no density, NO_AREA. Equal segments are cut once.
    """
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    parts = segments.groupBy("x1", "y1", "x2", "y2").agg(F.count("*").alias("_same")).withColumn("_len", length).filter("_len > 0").withColumn("_n", F.ceil(F.col("_len") / step).cast("int"))
    parts = parts.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * (F.col("_k") + 0.5) / F.col("_n")
    middles = parts.select(at("x1", "x2").alias("x"), at("y1", "y2").alias("y"), (F.col("_len") / F.col("_n") * F.col("_same")).alias("value"))
    met = zonal(middles, polygons.select("zone_id", "ring"), size).select("zone_id", F.coalesce("total", F.lit(0.0)).alias("length_m"))
    area = F.when(F.col("area_km2") > 0, F.col("area_km2"))
    out = polygons.select("zone_id", "area_km2").join(met, "zone_id")
    return out.select("zone_id", "length_m", (F.col("length_m") / 1000 / area).alias("density"), F.when(area.isNull(), "NO_AREA").alias("flag"))

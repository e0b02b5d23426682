"""The anomaly run: labelled observations localised, matched to events and scored, with intervals over entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import asof, scores
from .graph import cut

UNEXPLAINED = "UNEXPLAINED"


def localised(labels: DataFrame, topology: DataFrame, high_pit: float = 0.975) -> DataFrame:
    """Unexplained rows with `localised`: true where all direct upstream entities are judged that day and none is unusual
    itself, false where one is, null where there is none to compare with."""
    keys = ["variable", "target_date"]
    odd = labels.filter(F.col("label") == UNEXPLAINED).select("entity_id", *keys)
    up = labels.filter(F.col("label").isNotNull()).select(F.col("entity_id").alias("upstream_id"), *keys, ((F.col("label") != UNEXPLAINED) & ~(F.col("pit") > high_pit)).alias("quiet"))
    pairs = odd.join(topology, odd["entity_id"] == topology["downstream_id"]).join(up, ["upstream_id", *keys])
    return odd.join(pairs.groupBy("entity_id", *keys).agg(F.bool_and("quiet").alias("localised")), ["entity_id", *keys], "left")


def run(labels: DataFrame, topology: DataFrame, replicates: int = 2000, seed: int = 7, window_days: int = 3, hops: int = 3) -> DataFrame:
    """A row a variable: numbers of labels, detections, events and localised detections, precision, recall and F1, and their
    intervals where there are replicates.

    labels: entity_id, variable, target_date, label, pit, event. Every unexplained row is a detection, every event one of the
    entity it is at. labels are read several times: cut them before. All variables are matched at once, and what is drawn
    are the sums of an entity.
    """
    counts = labels.groupBy("variable").agg(F.count_if(F.col("label") == "NORMAL").alias("normal"), F.count_if(F.col("label") == "WEATHER_EXPLAINED").alias("weather_explained"), F.count_if(F.col("label") == UNEXPLAINED).alias("detections"), F.count_if("event").alias("events"))
    near = localised(labels, topology).groupBy("variable").agg(F.count_if("localised").alias("localised"))
    out = counts.join(near, "variable", "left").withColumn("localised", F.coalesce("localised", F.lit(0)))
    odd = F.col("label") == UNEXPLAINED
    found = cut(labels.filter(odd | F.col("event")).select("variable", "entity_id", F.col("target_date").alias("date"), odd.alias("odd"), "event"))
    sides = [found.filter(c).select("variable", "entity_id", "date") for c in ("odd", "event")]
    units = cut(scores.matched_units(*asof.matched(*sides, topology, window_days, hops, ["variable"]), ["variable", "entity_id"]))
    total = units.groupBy("variable").agg(*[F.sum(c).alias(c) for c in scores.SUMS])
    out = out.join(total.select("variable", *scores.ratios()), "variable", "left")
    if replicates:
        known = [r["variable"] for r in total.select("variable").orderBy("variable").collect()]  # a few variables
        spread = [scores.bootstrap_units(units.filter(F.col("variable").eqNullSafe(F.lit(v))), replicates, seed).withColumn("variable", F.lit(v)) for v in known]
        none = out.limit(0).select(*[F.lit(None).cast("double").alias(f"{m}_{e}") for m in ("precision", "recall", "f1") for e in ("low", "high")], "variable")
        out = out.join(reduce(DataFrame.unionByName, spread, none), "variable", "left")
    return out

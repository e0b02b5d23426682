"""Priorities, drivers, holdouts and stable ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_run(forecasts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of each key's newest run: those of the issue date and model version of the row that is newest by
    (issued_date, created_at); the greater version on ties.
    """
    run = F.struct("issued_date", "created_at", "model_version")
    newest = forecasts.groupBy(*keys).agg(F.max(run).alias("_run")).select(*keys, "_run.issued_date", "_run.model_version")
    return forecasts.join(newest, [*keys, "issued_date", "model_version"], "left_semi")


def priorities(entities: DataFrame, forecasts: DataFrame, exposure: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """information value = uncertainty * peak risk * exposure weight of an entity's best variable, ranked by (-value, id).

    Uncertainty is the mean P10-P90 width over the largest among rankable entities, for each variable. Entities that
    can't be ranked follow with a reason and no rank.
    """
    known = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("feature_type"))
    e = exposure.groupBy("entity_id").agg(F.sum(F.coalesce(known * F.col("n_features"), F.lit(0.0))).alias("exposure"))
    per = forecasts.groupBy("entity_id", "variable").agg(F.max("exceedance_prob").alias("risk"), F.avg(F.col("p90") - F.col("p10")).alias("width"))
    scored = per.filter("risk is not null and width is not null")
    rankable = scored.join(e, "entity_id")
    widest = rankable.groupBy("variable").agg(F.max("width").alias("_w"))
    most = rankable.agg(F.max("exposure").alias("_e")).withColumn("_k", F.lit(0))
    r = rankable.join(widest, "variable").withColumn("_k", F.lit(0)).join(most, "_k").drop("_k")
    r = r.withColumns({"uncertainty": F.when(F.col("_w") > 0, F.col("width") / F.col("_w")).otherwise(0.0), "exposure_weight": F.when(F.col("_e") > 0, F.log1p("exposure") / F.log1p("_e")).otherwise(0.0)})
    best = Window.partitionBy("entity_id").orderBy(F.desc(F.col("uncertainty") * F.col("risk")), "variable")
    r = r.withColumn("_n", F.row_number().over(best)).filter("_n = 1").withColumn("information_value", F.col("uncertainty") * F.col("risk") * F.col("exposure_weight"))
    r = r.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("information_value"), "entity_id")))
    has = forecasts.select("entity_id").distinct().withColumn("_f", F.lit(True))
    sc = scored.select("entity_id").distinct().withColumn("_s", F.lit(True))
    out = entities.select("entity_id").distinct().join(has, "entity_id", "left").join(sc, "entity_id", "left").join(r.select("entity_id", "variable", "risk", "uncertainty", "exposure_weight", "information_value", "rank"), "entity_id", "left")
    return out.withColumn("reason", F.when(F.col("_f").isNull(), "NO_FORECAST").when(F.col("_s").isNull(), "NO_THRESHOLD").when(F.col("rank").isNull(), "NO_EXPOSURE")).drop("_f", "_s")


def top_drivers(contributions: Column, k: int, skip: Sequence[str] = ("entity_id", "horizon")) -> Column:
    """The k largest contributions by size from an array of (feature, contribution); zeros and non-finite ones go."""
    good = F.filter(contributions, lambda c: ~c["feature"].isin(list(skip)) & c["contribution"].isNotNull() & (c["contribution"] != 0) & (F.abs(c["contribution"]) < float("inf")))
    keyed = F.array_sort(F.transform(good, lambda c: F.struct((-F.abs(c["contribution"])).alias("o"), c["feature"].alias("feature"), c["contribution"].alias("contribution"))))
    return F.slice(F.transform(keyed, lambda c: F.struct(c["feature"].alias("feature"), c["contribution"].alias("contribution"))), 1, k)


def holdout(ids: DataFrame, key: str, share: float, salt: str, group: str) -> DataFrame:
    """round(share * n) of each group's ids by sha256(salt + id), at least one of two or more."""
    h = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)
    w = Window.partitionBy(group)
    n = F.count("*").over(w)
    take = F.when(n >= 2, F.greatest(F.lit(1), F.round(n * share))).otherwise(F.round(n * share)).cast("long")
    ranked = ids.select(group, key).distinct().withColumn("_h", h).withColumn("_n", take).withColumn("_r", F.row_number().over(w.orderBy("_h", key)))
    return ranked.select(group, key, (F.col("_r") <= F.col("_n")).alias("held_out"))


def stable_ids(df: DataFrame, group: str, order: Sequence[Column | str], prefix: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("stable_id", F.format_string(f"{prefix}-%s-%04d", F.col(group), F.row_number().over(w)))

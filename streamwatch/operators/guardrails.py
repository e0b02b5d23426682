"""Alerts from forecasts: evidence, ordered guardrails, composition."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .probability import Z_SPREAD


@dataclass(frozen=True)
class Rules:
    min_probability: float = 0.60
    cooldown_hours: int = 72
    staleness_days: int = 21
    drift_days: int = 60
    drift_z: float = 2.5
    drift_outside: float = 0.5
    drift_residuals: int = 3


def evidence(reaches: DataFrame, topology: DataFrame, good: DataFrame, issued: str) -> DataFrame:
    """Last good date and count of 30 days: an observable entity's own, else those of its direct upstream entities.

    good: entity_id, obs_date of usable observations.
    """
    day = F.lit(issued).cast("date")
    own = reaches.filter("observable").select("entity_id", F.col("entity_id").alias("source_id"), F.lit("reach").alias("evidence_source"))
    up = reaches.filter("observable is null or not observable").join(topology, F.col("entity_id") == F.col("downstream_id")).select("entity_id", F.col("upstream_id").alias("source_id"), F.lit("upstream").alias("evidence_source"))
    dates = good.filter(F.col("obs_date") <= day).select(F.col("entity_id").alias("source_id"), "obs_date").distinct()
    seen = own.unionByName(up).join(dates, "source_id").groupBy("entity_id").agg(F.max("obs_date").alias("last_usable"), F.count_distinct(F.when(F.datediff(day, "obs_date") <= 30, F.col("obs_date"))).alias("usable_30d"))
    return reaches.select("entity_id", "observable").join(seen, "entity_id", "left").withColumns({"usable_30d": F.coalesce("usable_30d", F.lit(0)), "evidence_source": F.when(F.col("observable"), "reach").otherwise("upstream")})


def drift(residuals: DataFrame, issued: str, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """n, mean |z| and share outside P10-P90 of residuals of the last days; no spread counts as infinite."""
    age = F.datediff(F.lit(issued).cast("date"), "obs_date")
    sigma = (F.col("p90") - F.col("p10")) / Z_SPREAD
    z = F.when(sigma > 0, F.abs(F.col("observed") - F.col("p50")) / sigma).otherwise(float("inf"))
    recent = residuals.filter((age > 0) & (age <= rules.drift_days))
    return recent.groupBy("entity_id", "variable").agg(F.count("*").alias("n_residuals"), F.avg(z).alias("mean_abs_z"), F.avg(((F.col("observed") < F.col("p10")) | (F.col("observed") > F.col("p90"))).cast("double")).alias("outside_fraction"))


def cooling(candidates: DataFrame, history: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """Entities with an alert or watch less than the cooldown ago; the variable doesn't matter."""
    h = history.filter(F.col("severity").isin("ALERT", "WATCH")).select("entity_id", F.col("issued_at").alias("_at"))
    age = (F.unix_timestamp("issued_at") - F.unix_timestamp("_at")) / 3600
    return candidates.select("entity_id", "issued_at").distinct().join(h, "entity_id").filter((age >= 0) & (age < rules.cooldown_hours)).select("entity_id").distinct()


def guarded(candidates: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """Outcome of each candidate: the first guardrail that ends it decides; later ones aren't evaluated.

    candidates: entity_id, variable, issued (date), exceedance_prob, reason (of a refusal so far), observable,
    last_usable, n_residuals, mean_abs_z, outside_fraction, cooling.
    """
    p = F.col("exceedance_prob")
    fired: dict[str, Column] = {
        "staleness": F.col("last_usable").isNull() | (F.datediff("issued", "last_usable") > rules.staleness_days),
        "drift": (F.coalesce("n_residuals", F.lit(0)) >= rules.drift_residuals) & ((F.col("mean_abs_z") > rules.drift_z) | (F.col("outside_fraction") > rules.drift_outside)),
        "confidence": p.isNull() | F.isnan(p) | (p < rules.min_probability),
        "cooldown": F.coalesce("cooling", F.lit(False)),
    }
    order = list(fired)
    ended = F.lit(None).cast("string")
    for name in reversed(order):
        ended = F.when(fired[name], name).otherwise(ended)
    out = candidates.withColumn("guardrail", F.when(F.col("reason").isNull(), ended))
    capped = ~F.coalesce(F.col("observable"), F.lit(False))
    severity = F.when(F.col("reason").isNotNull() | (F.col("guardrail") == "staleness"), "INSUFFICIENT_EVIDENCE").when(F.col("guardrail").isNull(), F.when(capped, "WATCH").otherwise("ALERT"))
    rank = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("guardrail"))
    states = [F.when(F.col("reason").isNotNull(), "not_evaluated").when(F.col("guardrail").isNull() | (i + 1 < rank), "pass").when(rank == i + 1, "fired").otherwise("not_evaluated") for i in range(len(order))]
    states.append(F.when(F.col("reason").isNotNull() | F.col("guardrail").isNotNull(), "not_evaluated").when(capped, "fired").otherwise("pass"))
    out = out.withColumn("severity", severity).withColumns({f"status_{n}": s for n, s in zip([*order, "observability"], states, strict=True)})
    refused = F.col("severity") == "INSUFFICIENT_EVIDENCE"
    outcome = F.when(F.col("severity").isNotNull(), "ALERT").otherwise("SUPPRESSED")
    return out.withColumns({"withheld_exceedance_prob": F.when(refused, p), "exceedance_prob": F.when(~F.coalesce(refused, F.lit(False)), p), "outcome": outcome, "reason": F.coalesce("reason", F.when(F.col("guardrail") == "staleness", "STALE_EVIDENCE"))})


def composed(pairs: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Peak daily probability of each (entity, variable), the day of it, or why there is none.

    pairs: every (entity, variable) to be judged. forecasts: exceedance_prob, threshold, target_date, p90 by day.
    """
    peak = forecasts.groupBy("entity_id", "variable").agg(
        F.max("exceedance_prob").alias("exceedance_prob"), F.max_by("target_date", F.when(F.col("exceedance_prob").isNotNull(), F.struct("exceedance_prob", -F.datediff("target_date", F.lit("1970-01-01").cast("date"))))).alias("peak_date"),
        F.count("threshold").alias("_t"), F.count("*").alias("_n"),
    )
    out = pairs.join(peak, ["entity_id", "variable"], "left")
    return out.withColumn("reason", F.when(F.col("_n").isNull(), "NO_FORECAST").when(F.col("_t") == 0, "NO_THRESHOLD")).drop("_t", "_n")


def of_one_run(forecasts: DataFrame, issued: str, model_version: str, weather: str) -> DataFrame:
    """forecasts (issued_date, model_version, weather, exceedance_prob), which fail to be read where a row is of another run."""
    own = F.col("issued_date").eqNullSafe(F.lit(issued).cast("date")) & F.col("model_version").eqNullSafe(F.lit(model_version)) & F.col("weather").eqNullSafe(F.lit(weather))
    told = F.concat_ws(" ", F.lit("a forecast of another run:"), F.col("issued_date").cast("string"), "model_version", "weather")
    return forecasts.withColumn("exceedance_prob", F.when(own, F.col("exceedance_prob")).otherwise(F.raise_error(told).cast("double")))


def severest(alerts: DataFrame) -> DataFrame:
    """The most severe alert of each entity; the first by variable on ties."""
    rank = F.array_position(F.array(*[F.lit(s) for s in ("ALERT", "WATCH", "INSUFFICIENT_EVIDENCE")]), F.col("severity"))
    w = Window.partitionBy("entity_id").orderBy(rank, "variable")
    return alerts.filter("severity is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

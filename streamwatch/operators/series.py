"""Daily series: completeness, antecedent wetness, dry runs, leads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DECAY, DRY_BELOW = 0.9, 1.0


def daily(hourly: DataFrame, entity: str, ts: str, precip: str, temp: str, wet_above: float = 0.5) -> DataFrame:
    """UTC days: a value only where all 24 hours have one; the first row of a repeated hour counts."""
    one = hourly.groupBy(entity, F.date_trunc("hour", F.col(ts)).alias("hour")).agg(F.min_by(precip, F.struct(ts, precip)).alias("p"), F.min_by(temp, F.struct(ts, temp)).alias("t"))
    whole = lambda c, value: F.when(F.count(c) == 24, value)
    return one.groupBy(entity, F.to_date("hour").alias("date")).agg(
        F.count("*").alias("n_hours"), whole("p", F.sum("p")).alias("precip_mm"), whole("p", F.max("p")).alias("precip_max_hourly"),
        whole("p", F.count_if(F.col("p") > wet_above)).alias("precip_duration_h"), whole("t", F.avg("t")).alias("temp_mean_c"),
    )


def densify(df: DataFrame, key: str, date: str = "date") -> DataFrame:
    """A row for every day between a key's first and last; missing days hold nulls."""
    days = df.groupBy(key).agg(F.sequence(F.min(date), F.max(date)).alias("_d")).select(key, F.explode("_d").alias(date))
    return days.join(df, [key, date], "left")


def gaps(df: DataFrame, key: str, date: str = "date") -> DataFrame:
    """Keys whose days aren't contiguous, with the number of gaps."""
    before = F.lag(date).over(Window.partitionBy(key).orderBy(date))
    return df.withColumn("_gap", F.datediff(date, before) != 1).groupBy(key).agg(F.count_if("_gap").alias("n_gaps")).filter("n_gaps > 0")


def antecedent(precip: str, window: Window, k: int, decay: float = DECAY) -> F.Column:
    """Sum over i = 1..k of precip(t - i) * decay ** i; null where one of the days is."""
    total = F.lit(0.0)
    for i in range(1, k + 1):
        total = total + F.lag(precip, i).over(window) * F.lit(decay**i)
    return total


def dry_days(precip: str, date: str, window: Window, below: float = DRY_BELOW) -> F.Column:
    """Days since the last wet one before t; unknown at the start, and after a missing day until the next wet one."""
    past = window.rowsBetween(Window.unboundedPreceding, -1)
    wet = F.max(F.when(F.col(precip) >= below, F.col(date))).over(past)
    unknown = F.max(F.when(F.col(precip).isNull(), F.col(date))).over(past)
    return F.when(wet.isNotNull() & (unknown.isNull() | (unknown < wet)), F.datediff(F.col(date), wet) - 1)


def features(days: DataFrame, key: str, fit_end: str, ks: Sequence[int] = (7, 14, 30)) -> DataFrame:
    """Dense days with antecedent indices, dry days, first flush, low flow (normalised on the fitting period), harmonics."""
    from ..functions.scalar import first_flush, harmonics, low_flow

    w = Window.partitionBy(key).orderBy("date")
    out = densify(days, key).withColumns({f"api_{k}": antecedent("precip_mm", w, k) for k in ks} | {"antecedent_dry_days": dry_days("precip_mm", "date", w)})
    largest = F.max(F.when(F.col("date") <= F.lit(fit_end).cast("date"), F.col("api_14"))).over(Window.partitionBy(key))
    sin, cos = harmonics(F.col("date"))
    return out.withColumn("_largest", largest).withColumns({
        "first_flush_index": first_flush(F.col("antecedent_dry_days"), F.col("precip_max_hourly")),
        "temp_low_flow_index": low_flow(F.col("temp_mean_c"), F.col("api_14"), F.when(F.col("_largest") > 0, F.col("_largest"))), "doy_sin": sin, "doy_cos": cos,
    }).drop("_largest")


def leads(df: DataFrame, key: str, value: str, horizons: Sequence[int], date: str = "date") -> DataFrame:
    """Adds value_h<h>: the value exactly h days ahead on a dense calendar."""
    w = Window.partitionBy(key).orderBy(date)
    return df.withColumns({f"{value}_h{h}": F.lead(value, h).over(w) for h in horizons})


def carried(df: DataFrame, key: str, value: str, ok: F.Column, max_age: int, date: str = "date") -> DataFrame:
    """Adds the last good value at or before each day, and its age; both null beyond max_age days."""
    w = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    at = F.last(F.when(ok, F.col(date)), True).over(w)
    age = F.datediff(F.col(date), at)
    return df.withColumns({f"{value}_asof": F.when(age <= max_age, F.last(F.when(ok, F.col(value)), True).over(w)), f"{value}_age": F.when(age <= max_age, age)})


def as_issued(archive: DataFrame, run: DataFrame, issues: DataFrame, horizons: int, decay: float = DECAY, below: float = DRY_BELOW) -> DataFrame:
    """Future drivers as known at each issue: days before it from the archive, the issue day and later ones from the run.

    archive (every day), run: cell_id, date, precip_mm. issues: cell_id, issued. A week's index and the sum of rain up to each
    lead, null where one of their days is. antecedent_dry_days is counted back over the run's days; where all of them are
    dry, the archive's own count at the issue is added, which knows of the days before it. Null where a missing day is met
    before a wet one, or where the archive's count is needed and unknown.
    """
    before = archive.withColumn("_before", dry_days("precip_mm", "date", Window.partitionBy("cell_id").orderBy("date"), below)).select("cell_id", F.col("date").alias("issued"), "_before")
    issues = issues.join(before, ["cell_id", "issued"], "left")
    span = issues.withColumn("date", F.explode(F.sequence(F.date_sub("issued", 7), F.date_add("issued", horizons))))
    past = archive.select("cell_id", "date", F.col("precip_mm").alias("_a"))
    ahead = run.select("cell_id", "date", F.col("precip_mm").alias("_r"))
    days = span.join(past, ["cell_id", "date"], "left").join(ahead, ["cell_id", "date"], "left").withColumn("p", F.when(F.col("date") < F.col("issued"), F.col("_a")).otherwise(F.col("_r")))
    w = Window.partitionBy("cell_id", "issued").orderBy("date")
    lead_ = F.datediff("date", "issued")
    future = F.when(F.count_if((lead_ > 0) & F.col("p").isNull()).over(w) == 0, F.sum(F.when(lead_ > 0, F.col("p"))).over(w))
    past_ = w.rowsBetween(Window.unboundedPreceding, -1)
    wet = F.max(F.when((lead_ >= 0) & (F.col("p") >= below), lead_)).over(past_)
    gone = F.max(F.when((lead_ >= 0) & F.col("p").isNull(), lead_)).over(past_)
    dry = F.when(gone.isNotNull() & (wet.isNull() | (gone > wet)), F.lit(None)).otherwise(F.coalesce(lead_ - 1 - wet, lead_ + F.col("_before")))
    out = days.withColumns({"api_7": antecedent("p", w, 7, decay), "precip_fut_cum": future, "antecedent_dry_days": dry, "horizon": lead_}).filter("horizon > 0")
    return out.select("cell_id", "issued", "horizon", "api_7", "precip_fut_cum", "antecedent_dry_days")

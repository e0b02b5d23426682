"""Landed payloads to rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """Double, or null for anything that isn't a finite number."""
    v = F.try_cast(text, "double") if hasattr(F, "try_cast") else text.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def hourly(payloads: DataFrame, column: str, variables: Sequence[str]) -> DataFrame:
    """{"hourly": {"time": [...], variable: [...]}} to one row an hour; a missing variable raises."""
    schema = "struct<hourly: struct<time: array<string>, " + ", ".join(f"`{v}`: array<string>" for v in variables) + ">>"
    h = payloads.withColumn("_h", F.from_json(column, schema)["hourly"])
    for v in variables:
        h = h.withColumn("_h", F.when(F.col(f"_h.{v}").isNull(), F.raise_error(F.lit(f"payload lacks {v}")).cast(h.schema["_h"].dataType)).otherwise(F.col("_h")))
    rows = h.withColumn("_r", F.explode(F.arrays_zip("_h.time", *[f"_h.{v}" for v in variables])))
    keep = [c for c in payloads.columns if c != column]
    return rows.select(*keep, F.to_timestamp("_r.time").alias("ts"), *[number(F.col(f"_r.{v}")).alias(v) for v in variables])


def zonal_intervals(payloads: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """[{"from", "error", "stats": {"mean", "sampleCount", "noDataCount"}}] to days, and the failed days apart."""
    schema = "array<struct<`from`: string, error: string, stats: struct<mean: string, sampleCount: bigint, noDataCount: bigint>>>"
    keep = [c for c in payloads.columns if c != column]
    rows = payloads.withColumn("_r", F.explode(F.from_json(column, schema))).withColumn("obs_date", F.to_date("_r.from"))
    bad = F.col("_r.error").isNotNull()
    data = F.col("_r.stats.sampleCount") - F.col("_r.stats.noDataCount")
    good = rows.filter(~bad).select(*keep, "obs_date", data.alias("n_data"), F.round(number(F.col("_r.stats.mean")) * data).cast("long").alias("n_water"), number(F.col("_r.stats.mean")).alias("mean"))
    return good, rows.filter(bad).select(*keep, "obs_date", F.col("_r.error").alias("error"))


def bank_intervals(payloads: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """{"data": [{"from", "error", "outputs": {"px", "rx"}}], "failed": [{"from"}]} to days of the bank, failed days apart.

    px holds sampleCount, noDataCount and the shares of cloud, usable and land pixels, rx the mean NDVI with 0 off the
    land. A day without outputs has no data pixels and nothing else.
    """
    px = "struct<sampleCount: bigint, noDataCount: bigint, cloud: string, usable: string, land: string>"
    schema = f"struct<data: array<struct<`from`: string, error: string, outputs: struct<px: {px}, rx: struct<mean: string>>>>, failed: array<struct<`from`: string>>>"
    keep = [c for c in payloads.columns if c != column]
    parsed = payloads.withColumn("_p", F.from_json(column, schema))
    rows = parsed.withColumn("_r", F.explode("_p.data")).withColumn("obs_date", F.to_date("_r.from"))
    bad, o = F.col("_r.error").isNotNull(), "_r.outputs"
    there = F.col(f"{o}.px").isNotNull() & F.col(f"{o}.rx").isNotNull()
    data = F.when(there, F.col(f"{o}.px.sampleCount") - F.col(f"{o}.px.noDataCount")).otherwise(0).cast("long")
    part = lambda c: F.when(there, F.round(number(F.col(f"{o}.px.{c}")) * data)).cast("long")
    ndvi = F.when(there & (part("land") > 0), number(F.col(f"{o}.rx.mean")) * data / part("land"))
    good = rows.filter(~bad).select(*keep, "obs_date", data.alias("n_data"), part("cloud").alias("n_cloud"), part("usable").alias("n_usable"), part("land").alias("n_land"), ndvi.alias("ndvi"))
    failed = rows.filter(bad).select(*keep, "obs_date").unionByName(parsed.select(*keep, F.explode("_p.failed.from").alias("_f")).select(*keep, F.to_date("_f").alias("obs_date")))
    return good, failed


def classify_tags(tags: Column, rules: Sequence[tuple[str, str | None, str]]) -> Column:
    """The class of the first rule (key, value or None for any, class) that a tag map meets."""
    out = F.lit(None).cast("string")
    for key, value, name in reversed(rules):
        has = F.map_contains_key(tags, F.lit(key))
        out = F.when(has if value is None else has & (F.element_at(tags, F.lit(key)) == value), name).otherwise(out)
    return out


def nearest_year(catalogue: DataFrame, keys: Sequence[str], year: str, wanted: int) -> DataFrame:
    """The nearest year of each key, the later one on ties."""
    return catalogue.groupBy(*keys).agg(F.min_by(year, F.struct(F.abs(F.col(year) - wanted), -F.col(year))).alias(year))


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, whose evaluation fails where a key repeats."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(F.lit("repeated key")).cast("long")).otherwise(F.col("_n"))).filter("_n = 1").drop("_n")


def rule_violations(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks; an unknown outcome is no violation."""
    broken = F.array_compact(F.array(*[F.when(~r, name) for name, r in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("rule"))

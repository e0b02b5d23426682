"""Merges of new rows into kept ones, as DataFrames that a caller writes to the affected partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of either; where a key is in both, only the listed columns take the new value."""
    n = new.select(*keys, F.struct(*columns).alias("_new"))
    both = old.withColumn("_old", F.lit(True)).join(n, list(keys), "full_outer")
    rest = [c for c in old.columns if c not in keys]
    return both.select(*keys, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rest])


def replace_slice(old: DataFrame, new: DataFrame, inside: Column) -> DataFrame:
    """New rows instead of all kept rows of the slice."""
    return old.filter(~F.coalesce(inside, F.lit(False))).unionByName(new)


def merge_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Kept rows whose key isn't in the new ones, and the new ones."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def carry_over(old: DataFrame, new: DataFrame, key: str, same: str, columns: Sequence[str]) -> DataFrame:
    """New entities; the columns keep the old value only where `same` hasn't changed."""
    o = old.select(key, F.col(same).alias("_same"), *[F.col(c).alias(f"_{c}") for c in columns])
    j = new.drop(*columns).join(o, key, "left")
    return j.select(*[c for c in new.columns if c not in columns], *[F.when(F.col(same).eqNullSafe(F.col("_same")), F.col(f"_{c}")).alias(c) for c in columns])


def accounting(df: DataFrame, reason: Column) -> DataFrame:
    """Rows by the reason that drops them; null is kept."""
    return df.groupBy(F.coalesce(reason, F.lit("KEPT")).alias("reason")).agg(F.count("*").alias("n"))

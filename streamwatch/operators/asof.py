"""As-of and nearest-date joins as unions and windows, equi-joins, or one search in order a key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys whose dates one task searches at once.
KEYS = 500


def backward(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, right_at: str, values: Sequence[str]) -> DataFrame:
    """left with the values of the last right row dated at or before it, and that date (as <right_at>)."""
    lnames = left.columns
    l = left.select(F.struct(*lnames).alias("_row"), *keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).alias("_v"))
    packed = F.struct(F.col(right_at), *values)
    r = right.select(F.lit(None).alias("_row"), *keys, F.col(right_at).alias("_t"), F.lit(0).alias("_side"), packed.alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.drop("_v").withColumn("_v", F.lit(None).cast(r.schema["_v"].dataType)).unionByName(r.drop("_row").withColumn("_row", F.lit(None).cast(l.schema["_row"].dataType)))
    found = both.withColumn("_f", F.last("_v", True).over(w)).filter("_side = 1")
    return found.select("_row.*", *[F.col(f"_f.{c}").alias(c) for c in (right_at, *values)])


def at_leads(obs: DataFrame, keys: Sequence[str], leads: Sequence[int]) -> DataFrame:
    """keys, horizon, target_date, target, issued_date, obs_date, last_value: a row an observation and lead, with the last
    observation dated at or before the issue date, so many days ahead of the target (nulls where there is none).

    backward() of each observation by its own key's, from one search in order; leads are added behind it, so they aren't
    shuffled.
    """
    schema = obs.select(*keys).schema
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    known = obs.filter("value is not null and obs_date is not null").select(*keys, F.struct(F.datediff("obs_date", F.lit("1970-01-01").cast("date")).alias("day"), F.col("value").cast("double").alias("value")).alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        date = lambda x: pa.array(x.astype(np.int32)).cast(pa.date32())
        for batch in batches:
            for first in range(0, batch.num_rows, KEYS):
                part = batch.slice(first, KEYS)
                rows = part.column("_known")
                whose = np.repeat(np.arange(part.num_rows), np.diff(rows.offsets.to_numpy()))
                day, value = (rows.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(2))
                order = np.lexsort((value, day, whose))
                whose, day, value = whose[order], day[order].astype(np.int64), value[order]
                place = (whose << 32) + day
                for lead in leads:
                    at = np.searchsorted(place, place - lead, side="right") - 1
                    none = (at < 0) | (whose[at] != whose)
                    own = pa.array(whose)
                    known_at = [pa.array(day[at].astype(np.int32), mask=none).cast(pa.date32()), pa.array(value[at], mask=none)]
                    yield pa.RecordBatch.from_arrays([*[part.column(k).take(own) for k in keys], pa.array(np.full(len(day), lead, dtype=np.int32)), date(day), pa.array(value), date(day - lead), *known_at], names=[*keys, "horizon", "target_date", "target", "issued_date", "obs_date", "last_value"])

    held = known.groupBy(*keys).agg(F.collect_list("_row").alias("_known"))
    return held.mapInArrow(run, f"{fields}, horizon int, target_date date, target double, issued_date date, obs_date date, last_value double")


def upstream_state(obs: DataFrame, topology: DataFrame, area: DataFrame, days: DataFrame, values: Sequence[str], max_age: int = 3) -> DataFrame:
    """Area-weighted mean over direct upstream entities of their last good value dated in [t - max_age, t - 1].

    days: entity_id, date. Weights are equal where an upstream area is missing or not positive. The flag says whether
    there is an upstream entity, and a recent value.
    """
    good = obs.filter("quality_flag = 'OK'").select(F.col("entity_id").alias("upstream_id"), "obs_date", *values)
    slots = good.withColumn("date", F.explode(F.sequence(F.date_add("obs_date", 1), F.date_add("obs_date", max_age))))
    # a later observation without a value doesn't hide an earlier one that has it
    latest = slots.groupBy("upstream_id", "date").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("obs_date"))).alias(v) for v in values])
    edges = topology.join(area.select(F.col("entity_id").alias("upstream_id"), F.col("catchment_area_km2").alias("_a")), "upstream_id", "left")
    bad = Window.partitionBy("downstream_id")
    edges = edges.withColumn("_w", F.when(F.max(F.coalesce(F.col("_a") <= 0, F.lit(True))).over(bad), 1.0).otherwise(F.col("_a")))
    met = edges.join(latest, "upstream_id").groupBy(F.col("downstream_id").alias("entity_id"), "date")
    means = met.agg(*[(F.sum(F.col(v) * F.col("_w")) / F.sum(F.when(F.col(v).isNotNull(), F.col("_w")))).alias(f"upstream_{v}") for v in values])
    has = edges.select(F.col("downstream_id").alias("entity_id")).distinct().withColumn("_has", F.lit(True))
    any_ = F.coalesce(*[F.col(f"upstream_{v}") for v in values])
    flag = F.when(F.col("_has").isNull(), "NO_UPSTREAM_REACH").when(any_.isNotNull(), "OK").otherwise("NO_RECENT_UPSTREAM_OBS")
    return days.join(has, "entity_id", "left").join(means, ["entity_id", "date"], "left").withColumn("upstream_state_flag", flag).drop("_has")


def years_before(day: np.ndarray, years: int) -> np.ndarray:
    """Days since 1970 so many years earlier; 29 February becomes the 28th in a year without it."""
    months = day.astype("datetime64[D]").astype("datetime64[M]")
    of_month = day.astype("datetime64[D]") - months.astype("datetime64[D]")
    back = months - np.timedelta64(12 * years, "M")
    last = (back + np.timedelta64(1, "M")).astype("datetime64[D]") - np.timedelta64(1, "D")
    return np.minimum(back.astype("datetime64[D]") + of_month, last).astype(np.int64)


def naive_of(day: np.ndarray, value: np.ndarray, issued: np.ndarray, target: np.ndarray, window: int, years: int) -> np.ndarray:
    """Of each target the value nearest to it so many years before, from one key's days in order; NaN where there is none."""
    out = np.full(len(target), np.nan)
    open_ = np.arange(len(target))
    for k in range(1, years + 1):
        anchor = years_before(target[open_], k)
        open_, anchor = open_[anchor + window >= day[0]], anchor[anchor + window >= day[0]]  # nothing lies before the first day
        if not len(open_):
            break
        known = np.searchsorted(day, issued[open_], side="right") - 1
        left = np.minimum(np.searchsorted(day, anchor, side="right") - 1, known)
        right = np.searchsorted(day, anchor, side="right")
        before = np.where((left >= 0) & (day[left] >= anchor - window), anchor - day[left], window + 1)
        held = np.minimum(right, len(day) - 1)
        after = np.where((right <= known) & (day[held] <= anchor + window), day[held] - anchor, window + 1)
        found = np.minimum(before, after) <= window
        out[open_[found]] = value[np.where(before <= after, left, held)[found]]
        open_ = open_[~found]
    return out


def seasonal_naive(obs: DataFrame, targets: DataFrame, keys: Sequence[str], window_days: int = 7, max_years: int = 15) -> DataFrame:
    """targets with naive: the value nearest to the target date k years before, within the window and known at issue.

    The first k that has one wins, then the nearest, then the earlier. A key's observations and the dates that are asked of
    it are gathered once and searched in order, so no date is joined with each year's neighbours.
    """
    asked = targets.filter("issued_date is not null and target_date is not null").select(*keys, "issued_date", "target_date").distinct()
    epoch = F.lit("1970-01-01").cast("date")
    days = lambda c: F.datediff(c, epoch)
    known = obs.filter("value is not null and obs_date is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(days("obs_date").alias("day"), F.col("value").cast("double").alias("value")))).alias("_known"))
    wanted = asked.groupBy(*keys).agg(F.collect_list(F.struct(days("issued_date").alias("issued"), days("target_date").alias("target"))).alias("_asked"))
    schema = targets.select(*keys, "issued_date", "target_date").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, KEYS):
                part = batch.slice(first, KEYS)
                lists = [part.column(c) for c in ("_known", "_asked")]
                (a, b), (c, d) = ([flat.field(i).to_numpy(zero_copy_only=False) for i in range(2)] for flat in (x.flatten() for x in lists))
                at, to = (x.offsets.to_numpy() - x.offsets.to_numpy()[0] for x in lists)
                told = [naive_of(a[at[i] : at[i + 1]], b[at[i] : at[i + 1]], c[to[i] : to[i + 1]], d[to[i] : to[i + 1]], window_days, max_years) for i in range(part.num_rows)]
                whose = pa.array(np.repeat(np.arange(part.num_rows), np.diff(to)))
                dates = [pa.array(x.astype(np.int32)).cast(pa.date32()) for x in (c, d)]
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(whose) for k in keys], *dates, pa.array(np.concatenate(told), from_pandas=True)], names=[*keys, "issued_date", "target_date", "naive"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    best = known.join(wanted, list(keys)).mapInArrow(run, f"{fields}, naive double")
    return targets.join(best, [*keys, "issued_date", "target_date"], "left")


def matched(detections: DataFrame, events: DataFrame, topology: DataFrame, window_days: int = 3, hops: int = 3, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Both sides with `matched`: a detection within so many days on the event's entity or up to so many hops downstream,
    and of the same `by`.

    Both sides are read several times: cut them before. Dates meet in bins as wide as the window, so an event is two rows
    an entity at most and not one for each of its days; who met whom is computed once.
    """
    from .graph import cut, downstream

    width, epoch = 2 * window_days + 1, F.lit("1970-01-01").cast("date")
    bin_of = lambda c, days: F.floor((F.datediff(c, epoch) + days) / width)
    reach = downstream(events.select("entity_id").distinct(), topology, hops)
    near = events.select(*by, F.col("entity_id").alias("event_entity"), F.col("date").alias("event_date")).distinct().join(reach.select(F.col("entity_id").alias("event_entity"), F.col("reached_id").alias("entity_id")), "event_entity")
    near = near.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of("event_date", -window_days), bin_of("event_date", window_days)))))
    found = detections.select(*by, "entity_id", "date").distinct().withColumn("_bin", bin_of("date", 0))
    hits = cut(near.join(found, [*by, "entity_id", "_bin"]).filter(F.abs(F.datediff("date", "event_date")) <= window_days).select(*by, "entity_id", "date", "event_entity", "event_date"))
    keys = [*by, "entity_id", "date"]
    det = hits.select(*keys).distinct().withColumn("matched", F.lit(True))
    evs = hits.select(*by, F.col("event_entity").alias("entity_id"), F.col("event_date").alias("date")).distinct().withColumn("matched", F.lit(True))
    flag = F.coalesce("matched", F.lit(False))
    return detections.join(det, keys, "left").withColumn("matched", flag), events.join(evs, keys, "left").withColumn("matched", flag)

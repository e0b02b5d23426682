"""Seasonal thresholds, climatologies and other per-entity statistics fitted on a closed period."""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import season
from .asof import naive_of

LEVELS = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
NAMES = ("p05", "p10", "p25", "p50", "p75", "p90", "p95")
MIN_OBS = 8
#: Entities' variables whose forecasts one task makes at once.
ENTITIES = 500


def long_observations(obs: DataFrame, variables: Sequence[str] = ("turbidity_proxy", "ndci")) -> DataFrame:
    """entity_id, obs_date, variable, value of good observations that have one."""
    return obs.filter("quality_flag = 'OK'").unpivot(["entity_id", "obs_date"], list(variables), "variable", "value").filter("value is not null")


def seasonal_thresholds(obs: DataFrame, fit_end: str, share: float = 0.9, min_obs: int = MIN_OBS) -> DataFrame:
    """threshold (exact percentile), n_obs and share above it, by entity, variable and season up to fit_end."""
    fit = obs.filter(F.col("obs_date") <= F.lit(fit_end).cast("date")).withColumn("season", season(F.col("obs_date")))
    keys = ["entity_id", "variable", "season"]
    limits = fit.groupBy(*keys).agg(F.percentile("value", F.lit(share)).alias("threshold"), F.count("value").alias("n_obs")).filter(F.col("n_obs") >= min_obs)
    above = fit.join(limits.select(*keys, "threshold"), keys).groupBy(*keys).agg(F.avg((F.col("value") > F.col("threshold")).cast("double")).alias("clim_exceed_freq"))
    return limits.join(above, keys)


def circular(doy: np.ndarray, values: np.ndarray, window: int, levels: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, mean and exact percentiles [day, level] of the values within the window of each of 365 days on a circle."""
    order = np.argsort(doy, kind="stable")
    doy, values = doy[order], values[order]
    around = np.concatenate([doy - 365, doy, doy + 365])
    held = np.concatenate([values] * 3)
    days = np.arange(1, 366)
    first, last = np.searchsorted(around, days - window), np.searchsorted(around, days + window, side="right")
    n = last - first
    at = np.minimum(first[:, None] + np.arange(max(1, n.max())), len(held) - 1)
    inside = np.arange(at.shape[1]) < n[:, None]
    near = np.sort(np.where(inside, held[at], np.inf), axis=1)
    some = np.maximum(n, 1)
    mean = np.where(inside, held[at], 0.0).sum(axis=1) / some
    place = (some - 1)[:, None] * np.asarray(levels)
    low = np.floor(place).astype(np.int64)
    a, b = np.take_along_axis(near, low, axis=1), np.take_along_axis(near, np.ceil(place).astype(np.int64), axis=1)
    share = place - low
    quantiles = np.where((share == 0) | (a == b), a, np.minimum(b, a + share * np.where(np.isfinite(b), b - a, 0.0)))
    return n, mean, quantiles


def climatology(obs: DataFrame, fit_end: str, window: int = 15, min_obs: int = 5, levels: Sequence[float] = LEVELS) -> DataFrame:
    """mean, quantiles and n for each day of year: fitting-period values within the window on a circle of 365 days.

    An entity's values of a variable are gathered once, and all its days' windows are sorted together, which is quicker
    than to shuffle each value to the days it counts for. Days without a value are left out.
    """
    if not 0 <= window <= 182:
        raise ValueError("a window is at most half a year")
    names = list(NAMES[: len(levels)])
    fit = obs.filter((F.col("obs_date") <= F.lit(fit_end).cast("date")) & F.col("value").isNotNull())
    fit = fit.select("entity_id", "variable", F.least(F.dayofyear("obs_date"), F.lit(365)).alias("doy"), F.col("value").cast("double").alias("value"))
    # few bytes make much work here, so partitions aren't put together by size
    fit = fit.repartition(int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "entity_id", "variable")

    def of_group(rows: pd.DataFrame) -> pd.DataFrame:
        n, mean, quantiles = circular(rows["doy"].to_numpy(), rows["value"].to_numpy(), window, levels)
        enough = n >= max(1, min_obs)
        out = pd.DataFrame({"entity_id": rows["entity_id"].iloc[0], "variable": rows["variable"].iloc[0], "doy": np.arange(1, 366), "n_clim": n, "clim_mean": np.where(enough, mean, np.nan)})
        out[names] = np.where(enough[:, None], quantiles, np.nan)
        return out[n > 0]

    types = dict(fit.dtypes)
    made = fit.groupBy("entity_id", "variable").applyInPandas(of_group, f"entity_id {types['entity_id']}, variable {types['variable']}, doy int, n_clim long, " + ", ".join(f"{c} double" for c in ["clim_mean", *names]))
    return made.select("entity_id", "variable", "doy", "n_clim", *[F.nanvl(c, F.lit(None)).alias(c) for c in ["clim_mean", *names]])


def of_entity(day: np.ndarray, doy: np.ndarray, code: np.ndarray, value: np.ndarray, end: int, window: int, levels: Sequence[float], share: float, least: int, digits: int) -> tuple[np.ndarray, ...] | None:
    """What with_climatology tells of the days after `end`: their places, n, mean, quantiles, threshold and share above it."""
    known = day <= end
    later = np.flatnonzero(~known)
    if not len(later) or not known.any():
        return None
    n, mean, quantiles = circular(doy[known], value[known], window, levels)
    limit, above = np.full(4, np.nan), np.full(4, np.nan)
    for s in range(4):
        own = np.sort(value[known & (code == s)])
        if len(own) >= max(1, least):
            place = (len(own) - 1) * share
            low, high = int(np.floor(place)), int(np.ceil(place))
            limit[s] = own[low] if own[low] == own[high] else (high - place) * own[low] + (place - low) * own[high]
            above[s] = np.count_nonzero(own > limit[s]) / len(own)
    at = doy[later] - 1
    return later, n[at], mean[at], np.round(quantiles[at], digits), np.round(limit, digits)[code[later]], above[code[later]]


def known_at_issue(day: np.ndarray, value: np.ndarray, later: np.ndarray, lead: np.ndarray, n: np.ndarray, middle: np.ndarray, split: int, min_obs: int) -> tuple[np.ndarray, ...]:
    """What was known of an entity when its later days were forecast, `lead` days before: the seasonal naive value, and the
    last later day of the same fold (up to `split` or after it) that has a forecast, its value and that forecast's median."""
    order = np.argsort(day, kind="stable")
    target = day[later].astype(np.int64)
    issued = target - lead[later]
    naive = naive_of(day[order].astype(np.int64), value[order], issued, target, 7, 15)
    own = np.flatnonzero(n >= min_obs)
    own = own[np.argsort(target[own], kind="stable")]
    dates = target[own]
    at = np.searchsorted(dates, issued, side="right") - 1
    known = at >= 0
    if len(own):
        known &= (dates[at] > split) == (target > split)
        at = own[np.maximum(at, 0)]
    else:
        at = np.zeros(len(target), dtype=np.int64)
    told = lambda v: np.where(known, v, np.nan)
    return naive, told(target[at]), told(value[later][at]), told(middle[at])


#: Columns that with_climatology adds where observations have a lead.
AT_ISSUE = ("naive", "last_date", "last_value", "last_p50")


def with_climatology(
    obs: DataFrame, fit_end: str, window: int = 15, levels: Sequence[float] = LEVELS, share: float = 0.9, least: int = MIN_OBS, digits: Mapping[str, int] | None = None, split: str | None = None, min_obs: int = 5,
) -> DataFrame:
    """Observations after fit_end with the climatology of their day (as climatology() says it) and the threshold of their
    season with the share above it (as seasonal_thresholds()), quantiles and threshold to the variable's `digits`.

    An entity's values of a variable are gathered once and only the days that are asked for leave the task, so nothing is
    shuffled day by day. Observations without any fitting-period value within the window are left out; the threshold is
    null where the season has fewer than `least` values.

    With `split`, obs have a `lead` as well, and AT_ISSUE tells what was known so many days before, as asof.seasonal_naive()
    and probability.last_residual() say it: folds are the days up to `split` and those after, forecasts are days with
    min_obs values within the window. So a forecast isn't shuffled to meet its entity's other days.
    """
    if split is not None and levels[NAMES.index("p50")] != 0.5:
        raise ValueError("residuals are those of the median")
    if not 0 <= window <= 182:
        raise ValueError("a window is at most half a year")
    names = list(NAMES[: len(levels)])
    epoch = F.lit("1970-01-01").cast("date")
    code = F.floor(F.month("obs_date") % 12 / 3).cast("int")  # DJF, MAM, JJA, SON
    row = F.struct(F.datediff("obs_date", epoch).alias("day"), F.least(F.dayofyear("obs_date"), F.lit(365)).alias("doy"), code.alias("code"), F.col("value").cast("double").alias("value"), *([F.col("lead").cast("int").alias("lead")] if split else []))
    types = dict(obs.dtypes)
    some = obs.filter(F.col("value").isNotNull() & F.col("obs_date").isNotNull()).select("entity_id", "variable", row.alias("row"))
    # few bytes make much work here, so partitions aren't put together by size
    some = some.repartition(int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "entity_id", "variable")
    held = some.groupBy("entity_id", "variable").agg(F.collect_list("row").alias("rows"))
    since = lambda d: (datetime.date.fromisoformat(d) - datetime.date(1970, 1, 1)).days
    end, parted = since(fit_end), since(split) if split else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ENTITIES):
                part = batch.slice(first, ENTITIES)
                rows = part.column("rows")
                starts = rows.offsets.to_numpy()
                flat = rows.flatten()
                day, doy, season_code, value = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                starts = starts - starts[0]
                names_of = part.column("variable").to_pylist()
                lead = flat.field(4).to_numpy(zero_copy_only=False) if split else None
                told, whose, where = [], [], []
                for i in range(part.num_rows):
                    a, b = starts[i], starts[i + 1]
                    one = of_entity(day[a:b], doy[a:b], season_code[a:b], value[a:b], end, window, levels, share, least, (digits or {}).get(names_of[i], 15))
                    if one is not None:
                        more = known_at_issue(day[a:b], value[a:b], one[0], lead[a:b], one[1], one[3][:, NAMES.index("p50")], parted, min_obs) if split else ()
                        told.append((*one[1:], *more))
                        where.append(a + one[0])
                        whose.append(np.full(len(one[0]), i))
                if not told:
                    continue
                n, mean, quantiles, limit, above, *more = (np.concatenate(c) for c in zip(*told, strict=True))
                at, own = np.concatenate(where), np.concatenate(whose)
                keep = n > 0
                at, own = at[keep], pa.array(own[keep])
                numbers = [mean, *quantiles.T, limit, above]
                columns = [part.column("entity_id").take(own), part.column("variable").take(own), pa.array(day[at].astype(np.int32)).cast(pa.date32()), pa.array(value[at]), pa.array(n[keep].astype(np.int64))]
                columns += [pa.array(c[keep], from_pandas=True) for c in numbers]
                for name, c in zip(AT_ISSUE, more, strict=False):
                    c = pa.array(c[keep], from_pandas=True)
                    columns.append(c.cast(pa.int32()).cast(pa.date32()) if name == "last_date" else c)
                yield pa.RecordBatch.from_arrays(columns, names=[*out, *(AT_ISSUE if split else ())])

    out = ["entity_id", "variable", "obs_date", "value", "n_clim", "clim_mean", *names, "threshold", "clim_exceed_freq"]
    schema = f"entity_id {types['entity_id']}, variable {types['variable']}, obs_date date, value double, n_clim long, " + ", ".join(f"{c} double" for c in out[5:])
    if split:
        schema += ", " + ", ".join(f"{c} {'date' if c == 'last_date' else 'double'}" for c in AT_ISSUE)
    return held.mapInArrow(run, schema)


def deseasonalised(obs: DataFrame, before: str) -> DataFrame:
    """value minus the median of the same entity, variable and month before a date."""
    month = F.month("obs_date")
    normal = obs.filter(F.col("obs_date") < F.lit(before).cast("date")).groupBy("entity_id", "variable", month.alias("month")).agg(F.percentile("value", F.lit(0.5)).alias("normal"))
    return obs.withColumn("month", month).join(normal, ["entity_id", "variable", "month"], "left").withColumn("anomaly", F.col("value") - F.col("normal"))


def yearly_medians(obs: DataFrame, flags: DataFrame, years: DataFrame) -> DataFrame:
    """median of good values a year, a flag for what is missing, and the count of each flag."""
    good = obs.groupBy("entity_id", F.year("obs_date").alias("year")).agg(F.percentile("value", F.lit(0.5)).alias("median"), F.count("*").alias("n_clear"))
    counted = flags.groupBy("entity_id", F.year("obs_date").alias("year"), "quality_flag").count()
    all_ = counted.groupBy("entity_id", "year").agg(F.sum("count").alias("n_acquisitions"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("quality_flag", "count")))).alias("flag_counts"))
    out = years.join(all_, ["entity_id", "year"], "left").join(good, ["entity_id", "year"], "left")
    flag = F.when(F.col("n_clear") > 0, "OK").when(F.col("n_acquisitions") > 0, "NO_CLEAR_ACQUISITION").otherwise("NO_ACQUISITION")
    return out.withColumn("flag", flag).withColumn("n_clear", F.coalesce("n_clear", F.lit(0))).withColumn("n_acquisitions", F.coalesce("n_acquisitions", F.lit(0)))


def observability(obs: DataFrame, reaches: DataFrame, least: int = 5) -> DataFrame:
    """Median, least and most water pixels over usable dates; observable where the median is enough, null with no date."""
    usable = obs.filter("quality_flag <> 'CLOUD'").groupBy("entity_id").agg(
        F.percentile("water_pixel_count", F.lit(0.5)).alias("median_water_pixels"), F.min("water_pixel_count").alias("min_water_pixels"), F.max("water_pixel_count").alias("max_water_pixels"), F.count("*").alias("n_usable")
    )
    out = reaches.select("entity_id").join(usable, "entity_id", "left")
    return out.withColumn("observable", F.col("median_water_pixels") >= least).withColumn("reason", F.when(F.col("n_usable").isNull(), "NO_USABLE_DATE"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[F.Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

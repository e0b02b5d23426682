"""Distributions given by quantiles or mixtures; calibration and assimilation of forecasts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import backward, bucket_of, forward, obs_class
from .asof import backward as asof_backward
from .climate import LEVELS, NAMES

TRANSFORMS = {"turbidity_proxy": "log1p", "ndci": "identity"}
BUCKETS = {"1-3": (1, 2, 3), "4-7": (4, 5, 6, 7), "8-10": (8, 9, 10)}
Z_SPREAD = 2.5631031310892007


def cdf(quantiles: Sequence[Column], levels: Sequence[float], x: Column) -> Column:
    """Piecewise-linear distribution function with its outer segments carried on; a flat segment is a point mass.

    Null where an input is null. Crossing quantiles raise.
    """
    q, lv = list(quantiles), [float(l) for l in levels]
    gap = [round(b - a, 10) for a, b in zip(lv, lv[1:], strict=False)]
    first, last = q[1] - q[0], q[-1] - q[-2]
    low = F.when(first > 0, F.greatest(F.lit(0.0), lv[0] - F.lit(gap[0]) * (q[0] - x) / first)).otherwise(0.0)
    high = F.when(last > 0, F.least(F.lit(1.0), lv[-1] + F.lit(gap[-1]) * (x - q[-1]) / last)).otherwise(F.when(x > q[-1], 1.0).otherwise(lv[-1]))
    out = F.when(x < q[0], low).when(x >= q[-1], high)
    for k in range(len(q) - 1):
        out = out.when((x >= q[k]) & (x < q[k + 1]), lv[k] + F.lit(gap[k]) * (x - q[k]) / (q[k + 1] - q[k]))
    missing, crossed = x.isNull(), F.lit(False)
    for k, c in enumerate(q):
        missing = missing | c.isNull()
        crossed = crossed | (F.lit(False) if k == 0 else c < q[k - 1])
    return F.when(missing, F.lit(None).cast("double")).when(crossed, F.raise_error(F.lit("quantiles cross")).cast("double")).otherwise(out)


def exceedance(quantiles: Sequence[Column], levels: Sequence[float], threshold: Column) -> Column:
    return 1 - cdf(quantiles, levels, threshold)


def surprise(pit: Column) -> Column:
    """-ln(1 - PIT), infinite at 1 (to the last digits of a double)."""
    return F.when(pit >= 1 - 1e-12, float("inf")).otherwise(-F.log(1 - pit))


def anomaly_label(pit: Column, y: Column, p10: Column, p90: Column, threshold: Column) -> Column:
    """y and quantiles in transformed space."""
    return F.when(pit.isNull(), F.lit(None)).when((pit > 0.975) & (y > p90 + 0.25 * (p90 - p10)), "UNEXPLAINED").when(y > threshold, "WEATHER_EXPLAINED").otherwise("NORMAL")


def laplace_mixture_cdf(mu: Column, b: Column, tau: Column, pi: Column, x: Column) -> Column:
    """Distribution function of a mixture of asymmetric Laplace components given as arrays."""
    parts = F.arrays_zip(mu.alias("mu"), b.alias("b"), tau.alias("tau"), pi.alias("pi"))

    def one(c: Column) -> Column:
        z = (x - c["mu"]) / c["b"]
        return c["pi"] * F.when(z < 0, c["tau"] * F.exp((1 - c["tau"]) * z)).otherwise(1 - (1 - c["tau"]) * F.exp(-c["tau"] * z))

    return F.aggregate(parts, F.lit(0.0), lambda a, c: a + one(c))


def normalised(pi: Column) -> Column:
    return F.transform(pi, lambda w: w / F.aggregate(pi, F.lit(0.0), lambda a, x: a + x))


def mixture_mean(mu: Column, b: Column, tau: Column, pi: Column) -> Column:
    """Mean of a mixture of asymmetric Laplace components: mu + b (1 - 2 tau) / (tau (1 - tau)) each, by weight."""
    parts = F.arrays_zip(mu.alias("mu"), b.alias("b"), tau.alias("tau"), normalised(pi).alias("pi"))
    return F.aggregate(parts, F.lit(0.0), lambda a, c: a + c["pi"] * (c["mu"] + c["b"] * (1 - 2 * c["tau"]) / (c["tau"] * (1 - c["tau"]))))


def rescaled(df: DataFrame, centre: float, scale: float) -> DataFrame:
    """Mixtures (columns mu, b, tau, pi) of scale * x + centre; scale over 0."""
    if not scale > 0:
        raise ValueError(f"scale must be over 0, not {scale}")
    return df.withColumns({"mu": F.transform("mu", lambda m: m * scale + centre), "b": F.transform("b", lambda x: x * scale)})


def ensemble(members: Sequence[DataFrame], key: str) -> DataFrame:
    """key, mu, b, tau, pi: the mixture of equal parts of the members' mixtures; keys that a member lacks are left out."""
    if not members:
        raise ValueError("an ensemble needs a member")
    parts = [m.select(key, F.lit(i).alias("_i"), "mu", "b", "tau", F.transform(normalised(F.col("pi")), lambda w: w / len(members)).alias("pi")) for i, m in enumerate(members)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    met = every.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "mu", "b", "tau", "pi"))).alias("_m")).filter(F.size("_m") == len(members))
    return met.select(key, *[F.flatten(F.col(f"_m.{c}")).alias(c) for c in ("mu", "b", "tau", "pi")])


def mixture_quantiles(df: DataFrame, levels: Sequence[float] = LEVELS, steps: int = 60) -> DataFrame:
    """Adds q: quantiles of the mixtures in columns mu, b, tau, pi, by bisection over whole Arrow batches."""
    lv = np.array(levels)

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                yield pdf.assign(q=[])
                continue
            mu, b, tau, pi = (np.array(pdf[c].tolist(), dtype=float)[:, None, :] for c in ("mu", "b", "tau", "pi"))
            far = 60 * b / np.minimum(tau, 1 - tau)
            low, high = (mu - far).min(2) + 0 * lv, (mu + far).max(2) + 0 * lv
            for _ in range(steps):
                mid = (low + high) / 2
                z = (mid[:, :, None] - mu) / b
                value = (pi * np.where(z < 0, tau * np.exp(np.minimum(0, (1 - tau) * z)), 1 - (1 - tau) * np.exp(-np.maximum(0, tau * z)))).sum(2)
                low, high = np.where(value < lv, mid, low), np.where(value < lv, high, mid)
            yield pdf.assign(q=list((low + high) / 2))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, q array<double>")


def conformal_fit(rows: DataFrame, val_end: str, coverage: float = 0.8, min_rows: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """By variable, lead bucket and class (and columns `by`): the k-th smallest score, k = ceil((n + 1) * coverage), or why there is none.

    Only rows whose target date is at most val_end may be given.
    """
    rows = rows.withColumn("_late", F.col("target_date") > F.lit(val_end).cast("date"))
    score = None
    for v, t in TRANSFORMS.items():
        y, lo, hi = (forward(F.col(c), t) for c in ("target", "p10", "p90"))
        score = F.when(F.col("variable") == v, F.greatest(lo - y, y - hi)).otherwise(score if score is not None else F.lit(None))
    cells = rows.filter("target is not null").groupBy(*by, "variable", bucket_of(F.col("horizon"), BUCKETS).alias("bucket"), obs_class(F.col("observable")).alias("obs_class"))
    out = cells.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(score)).alias("_s"), F.max("_late").alias("_late"))
    k = F.ceil((F.col("n") + 1) * F.lit(coverage)).cast("int")
    why = F.when(F.col("_late"), F.raise_error(F.lit("rows after the validation period"))).when(F.col("n") < min_rows, f"fewer than {min_rows} calibration rows").when(k > F.col("n"), "coverage unattainable with n rows")
    return out.withColumn("reason", why).withColumn("q_adjust", F.when(F.col("reason").isNull(), F.get("_s", k - 1))).drop("_s", "_late")


def conformal_apply(rows: DataFrame, fit: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lower quantiles down and upper ones up by the cell's adjustment in transformed space, then in order again."""
    keyed = rows.withColumns({"bucket": bucket_of(F.col("horizon"), BUCKETS), "obs_class": obs_class(F.col("observable"))}).join(fit.select(*by, "variable", "bucket", "obs_class", "q_adjust"), [*by, "variable", "bucket", "obs_class"], "left")
    moved: dict[str, Column] = {}
    for name in NAMES:
        sign = -1 if name in ("p05", "p10") else 1 if name in ("p90", "p95") else 0
        value = F.col(name)
        for v, t in TRANSFORMS.items():
            value = F.when((F.col("variable") == v) & F.col("q_adjust").isNotNull(), backward(forward(F.col(name), t) + sign * F.col("q_adjust"), t)).otherwise(value)
        moved[name] = value
    packed = F.array(*moved.values())
    out = keyed.withColumn("_q", F.array_sort(packed)).withColumn("quantiles_resorted", ~F.array_sort(packed).eqNullSafe(packed)).withColumn("conformal_adjusted", F.col("q_adjust").isNotNull())
    return out.withColumns({n: F.col("_q")[i] for i, n in enumerate(NAMES)}).drop("_q")


def residual(target: Column, middle: Column) -> Column:
    """Target less median, in the transformed space of the column `variable`."""
    r = None
    for v, t in TRANSFORMS.items():
        r = F.when(F.col("variable") == v, forward(target, t) - forward(middle, t)).otherwise(r if r is not None else F.lit(None))
    return r


def residuals(forecasts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """r0 of the shortest lead that has a target, by fold, variable, entity, date (and columns `by`), in transformed space."""
    r = residual(F.col("target"), F.col("p50"))
    return forecasts.filter("target is not null").groupBy(*by, "fold", "variable", "entity_id", F.col("target_date").alias("obs_date")).agg(F.min_by(r, F.struct("horizon", "issued_date")).alias("r0"))


def last_residual(forecasts: DataFrame, res: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """forecasts with r0 and obs_date of the last residual known at issue, within fold, variable, entity and columns `by`."""
    return asof_backward(forecasts, res, [*by, "fold", "variable", "entity_id"], "issued_date", "obs_date", ["r0"])


def assimilated(forecasts: DataFrame, res: DataFrame, tau: float | Mapping[str, float], max_age: int = 21) -> DataFrame:
    """Quantiles moved by r0 * exp(-age / tau) where the entity is observable and its last residual fresh; else why not."""
    by = F.lit(float(tau)) if not isinstance(tau, Mapping) else F.element_at(F.create_map(*[F.lit(x) for kv in tau.items() for x in kv]), F.col("variable"))
    return moved_by_residual(last_residual(forecasts, res), by, max_age)


def moved_by_residual(m: DataFrame, tau: Column, max_age: int = 21) -> DataFrame:
    """assimilated() for rows that have their last_residual; tau can differ by row."""
    seen = F.coalesce(F.col("observable"), F.lit(False))
    fresh = F.col("r0").isNotNull() & (F.datediff("issued_date", "obs_date") <= max_age)
    reason = F.when(~seen, "UNOBSERVABLE").when(F.col("r0").isNull(), "NO_OBS").when(~fresh, "STALE")
    m = m.withColumn("assim_reason", reason).withColumn("assim_shift", F.when(F.col("assim_reason").isNull(), F.col("r0") * F.exp(-F.datediff("target_date", "obs_date") / tau)).otherwise(0.0))
    out: dict[str, Column] = {}
    for name in NAMES:
        value = F.col(name)
        for v, t in TRANSFORMS.items():
            value = F.when((F.col("variable") == v) & F.col("assim_reason").isNull(), backward(forward(F.col(name), t) + F.col("assim_shift"), t)).otherwise(value)
        out[name] = value
    return m.withColumns(out)


def poisson_binomial(df: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """The distribution of the number of days that exceed, from each day's probability; null probabilities are left out."""

    def pmf(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(1)
        out[0] = 1
        for x in pdf[p].dropna():
            out = np.append(out * (1 - x), 0) + np.append(0, out * x)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(out) for k in keys}, "n_days": range(len(out)), "probability": out})

    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, p).groupBy(*keys).applyInPandas(pmf, f"{fields}, n_days long, probability double")


def pmf_interval(pmf: DataFrame, keys: Sequence[str], coverage: float = 0.8) -> DataFrame:
    """Smallest counts whose cumulated probability reaches the tails of a central interval, and the mean."""
    from pyspark.sql import Window

    tail = (1 - coverage) / 2
    w = Window.partitionBy(*keys).orderBy("n_days")
    c = pmf.withColumn("_c", F.sum("probability").over(w))
    return c.groupBy(*keys).agg(F.min(F.when(F.col("_c") >= tail - 1e-12, F.col("n_days"))).alias("low"), F.min(F.when(F.col("_c") >= 1 - tail - 1e-12, F.col("n_days"))).alias("high"), F.sum(F.col("n_days") * F.col("probability")).alias("mean_days"))


def conformal_by(rows: DataFrame, keys: Sequence[str], coverage: float = 0.8) -> DataFrame:
    """The k-th smallest conformity score by any keys that hold `variable`; cells whose k is over n are left out."""
    score = None
    for v, t in TRANSFORMS.items():
        y, lo, hi = (forward(F.col(c), t) for c in ("target", "p10", "p90"))
        score = F.when(F.col("variable") == v, F.greatest(lo - y, y - hi)).otherwise(score if score is not None else F.lit(None))
    out = rows.filter("target is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(score)).alias("_s"))
    k = F.ceil((F.col("n") + 1) * F.lit(coverage)).cast("int")
    return out.filter(k <= F.col("n")).withColumn("q_adjust", F.get("_s", k - 1)).drop("_s")


def apply_by_weather(rows: DataFrame, fits: DataFrame, variant: str = "A", fallback: str = "ORACLE") -> DataFrame:
    """Rows of the variant adjusted by the fit of their weather, with fit_weather; other variants as they are.

    Live weather takes the fit of weather as issued; a weather that has no fit takes the fallback's. fits: conformal_fit
    by "weather".
    """
    wanted = F.when(F.col("weather") == "LIVE", "ASISSUED").otherwise(F.col("weather"))
    known = fits.select(F.col("weather").alias("_want")).distinct().withColumn("_has", F.lit(True))
    keyed = rows.withColumn("_want", wanted).join(known, "_want", "left").withColumn("fit_weather", F.when(F.col("_has"), F.col("_want")).otherwise(fallback)).drop("_want", "_has")
    own = F.coalesce(F.col("variant") == variant, F.lit(False))
    moved = conformal_apply(keyed.filter(own), fits.withColumnRenamed("weather", "fit_weather"), by=["fit_weather"])
    return moved.unionByName(keyed.filter(~own).withColumn("fit_weather", F.lit(None).cast("string")), allowMissingColumns=True)

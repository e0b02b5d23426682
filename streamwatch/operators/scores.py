"""Scores of quantile forecasts, their baselines, and comparisons."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .climate import LEVELS, NAMES
from .graph import cut


def pinball(y: Column, q: Column, level: float) -> Column:
    return F.when(y >= q, F.lit(level) * (y - q)).otherwise(F.lit(1 - level) * (q - y))


def crps_weights(levels: Sequence[float] = LEVELS) -> list[float]:
    """Width of the part of (0, 1) that is nearest to each level."""
    edges = [0.0, *[(a + b) / 2 for a, b in zip(levels, levels[1:], strict=False)], 1.0]
    return [b - a for a, b in zip(edges, edges[1:], strict=False)]


def crps(y: Column, quantiles: Sequence[Column], levels: Sequence[float] = LEVELS) -> Column:
    total = F.lit(0.0)
    for q, l, w in zip(quantiles, levels, crps_weights(levels), strict=True):
        total = total + F.lit(2 * w) * pinball(y, q, l)
    return total


def point_scores(y: str = "target", prefix: str = "") -> list[Column]:
    """Aggregates over forecast rows."""
    q = {n: F.col(prefix + n) for n in NAMES}
    t = F.col(y)
    inside = lambda a, b: F.avg(t.between(q[a], q[b]).cast("double"))
    return [
        F.count(t).alias("n"), F.avg(F.abs(t - q["p50"])).alias("mae"), F.sqrt(F.avg((t - q["p50"]) * (t - q["p50"]))).alias("rmse"), F.avg(q["p50"] - t).alias("bias"),
        F.avg(crps(t, list(q.values()))).alias("crps"), inside("p10", "p90").alias("coverage_80"), inside("p05", "p95").alias("coverage_90"),
        *[F.avg(pinball(t, q[n], l)).alias(f"pinball_{n}") for n, l in zip(NAMES, LEVELS, strict=True)],
    ]


def skill(model: Column, base: Column) -> Column:
    return F.when(base > 0, 1 - model / base)


#: Scopes of the score cube, each within fold and variable.
SCOPES = (("horizon",), ("bucket",), (), ("obs_class",), ("entity_id",))
SKILLS = ("skill_mae_naive", "skill_mae_clim", "skill_crps_naive", "skill_crps_clim")


def score_cube(rows: DataFrame, within: Sequence[str] = ("fold", "variable"), scopes: Sequence[Sequence[str]] = SCOPES) -> DataFrame:
    """Scores of a forecast and two baselines in all scopes at once (grouping sets): NAMES, naive, and clim_<name>.

    n, mae_all, crps_all and coverage_80_all are over all rows with a target; what follows is over the rows on which all
    three have a value (n_common), so that like is compared with like. The CRPS of the naive forecast, a point, is its MAE;
    the climatology's is that of its own quantiles. A skill is 1 - score / baseline, null where the baseline isn't positive.
    """
    cols = list(dict.fromkeys(c for s in scopes for c in s))
    t = F.col("target")
    clim = [F.col(f"clim_{n}") for n in NAMES]
    common = F.col("naive").isNotNull() & clim[0].isNotNull()
    only = lambda c: F.when(common, c)
    inside = lambda low, high: F.avg(t.between(F.col(low), F.col(high)).cast("double"))
    inside_common = lambda low, high: F.avg(only(t.between(F.col(low), F.col(high)).cast("double")))
    own = crps(t, [F.col(n) for n in NAMES])
    known = rows.filter("target is not null and p50 is not null")
    cube = known.groupingSets([[F.col(c) for c in (*within, *s)] for s in scopes], *[F.col(c) for c in (*within, *cols)]).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n"), F.avg(F.abs(t - F.col("p50"))).alias("mae_all"), F.avg(own).alias("crps_all"), inside("p10", "p90").alias("coverage_80_all"),
        F.count_if(common).alias("n_common"), F.avg(only(F.abs(t - F.col("p50")))).alias("mae"), F.avg(only(own)).alias("crps"), inside_common("p10", "p90").alias("coverage_80"),
        F.avg(only(F.abs(t - F.col("naive")))).alias("mae_naive"), F.avg(only(F.abs(t - F.col("clim_p50")))).alias("mae_clim"), F.avg(only(crps(t, clim))).alias("crps_clim"), inside_common("clim_p10", "clim_p90").alias("coverage_80_clim"),
    )
    pairs = zip(SKILLS, ("mae", "mae", "crps", "crps"), ("mae_naive", "mae_clim", "mae_naive", "crps_clim"), strict=True)
    return cube.withColumns({name: skill(F.col(a), F.col(b)) for name, a, b in pairs})


def losses(cube: DataFrame) -> DataFrame:
    """Every scope, baseline and metric with negative skill: `comparison` names both, as in SKILLS."""
    ids = [c for c in cube.columns if c in ("fold", "variable", "variant", "weather", "horizon", "bucket", "obs_class", "entity_id", "gid")]
    return cube.unpivot(ids, list(SKILLS), "comparison", "skill").filter("skill < 0")


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Mean forecast and observed frequency by equal bins of probability; empty bins stay, the last bin is closed."""
    known = rows.filter("exceedance_prob is not null and event is not null")
    placed = known.withColumn("bin", F.least(F.floor(F.round("exceedance_prob", 9) * bins), F.lit(bins - 1)).cast("int"))
    table = placed.groupBy("bin").agg(F.count("*").alias("n"), F.avg("exceedance_prob").alias("mean_forecast"), F.avg(F.col("event").cast("double")).alias("observed_frequency"))
    all_ = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_.join(table, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def brier(rows: DataFrame, operating: float = 0.6) -> DataFrame:
    p, e, c = F.col("exceedance_prob"), F.col("event").cast("double"), F.col("clim_exceed_freq")
    flagged, event = p >= operating, F.col("event")
    out = rows.filter("exceedance_prob is not null and event is not null and clim_exceed_freq is not null").agg(
        F.count("*").alias("n"), F.avg((p - e) * (p - e)).alias("brier"), F.avg((c - e) * (c - e)).alias("brier_clim"), F.count_if(flagged & event).alias("hits"), F.count_if(flagged & ~event).alias("false_alarms"), F.count_if(~flagged & event).alias("misses")
    )
    ratio = lambda a, b: F.when(b > 0, a / b)
    return out.withColumns({"brier_skill": skill(F.col("brier"), F.col("brier_clim")), "far": ratio(F.col("false_alarms"), F.col("hits") + F.col("false_alarms")), "pod": ratio(F.col("hits"), F.col("hits") + F.col("misses"))})


def prf(det: DataFrame, ev: DataFrame, flag: str = "matched") -> DataFrame:
    """Precision, recall and F1 of one row; undefined ones are null."""
    p = det.agg(F.avg(F.col(flag).cast("double")).alias("precision"))
    r = ev.agg(F.avg(F.col(flag).cast("double")).alias("recall"))
    both = p.withColumn("_k", F.lit(0)).join(r.withColumn("_k", F.lit(0)), "_k").drop("_k")
    return both.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


#: Units whose draws one task makes at once, and replicates that it holds at once.
UNITS, BLOCK = 1024, 250


def resampled(units: DataFrame, keys: Sequence[str], sums: Sequence[str], replicates: int, seed: int, weight: str | None = None, per_bucket: int = UNITS) -> DataFrame:
    """r and the sums of units drawn with replacement, as many as there are, `replicates` times: exact multinomial draws.

    units: a row a unit, told apart by keys; one that stands for several equal ones has their number as weight. Units lie
    in hash buckets. How many draws fall into each bucket is drawn first; a bucket then draws among its own units, so that
    all draws together are one multinomial and no task holds all units. A null sum counts as 0; without units there is no row.
    """
    spark = units.sparkSession
    known = units.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in sums], (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    known = cut(known)  # read three times: what the units come from is computed once
    count = known.count()
    buckets = max(1, -(-count // per_bucket))
    known = known.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    sizes = {r["_b"]: r["n"] for r in known.groupBy("_b").agg(F.sum("_w").alias("n")).collect()}  # a row a bucket
    schema = "r int, " + ", ".join(f"{c} double" for c in sums)
    if not sizes:
        return spark.createDataFrame([], schema)
    order = sorted(sizes)
    n = sum(sizes.values())
    drawn = np.random.default_rng(seed).multinomial(n, np.array([sizes[b] for b in order]) / n, size=replicates)
    held = spark.sparkContext.broadcast({b: drawn[:, i] for i, b in enumerate(order)})  # replicates numbers a bucket

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["_b"].iloc[0])
        rows = rows.sort_values(list(keys))
        rng, values = np.random.default_rng([seed, bucket]), rows[list(sums)].to_numpy()
        p = rows["_w"].to_numpy() / rows["_w"].sum()
        draws = held.value[bucket]
        parts = [rng.multinomial(draws[i : i + BLOCK], p) @ values for i in range(0, len(draws), BLOCK)]
        return pd.DataFrame(np.concatenate(parts), columns=list(sums)).assign(r=np.arange(len(draws), dtype=np.int32))[["r", *sums]]

    return known.groupBy("_b").applyInPandas(draw, schema).groupBy("r").agg(*[F.sum(c).alias(c) for c in sums])


def _interval(c: str) -> list[Column]:
    return [F.percentile(c, F.lit(0.025)).alias(f"{c}_low"), F.percentile(c, F.lit(0.975)).alias(f"{c}_high")]


def bootstrap(stats: DataFrame, replicates: int = 2000, seed: int = 7) -> DataFrame:
    """95 % interval of sum(num) / sum(den) when entities are drawn with replacement."""
    each = resampled(stats, ["entity_id"], ["num", "den"], replicates, seed).select((F.col("num") / F.nullif(F.col("den"), F.lit(0.0))).alias("value"))
    return each.agg(F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"))


#: Detections and events of a unit, and how many of each are matched.
SUMS = ("d", "dh", "e", "eh")


def matched_units(det: DataFrame, ev: DataFrame, keys: Sequence[str] = ("entity_id",), flag: str = "matched") -> DataFrame:
    """A row a unit: its detections and events, and how many of each are matched."""
    hit = F.coalesce(F.col(flag), F.lit(False)).cast("int")
    zero = F.lit(0)
    rows = det.select(*keys, F.lit(1).alias("d"), hit.alias("dh"), zero.alias("e"), zero.alias("eh")).unionByName(ev.select(*keys, zero.alias("d"), zero.alias("dh"), F.lit(1).alias("e"), hit.alias("eh")))
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def ratios() -> list[Column]:
    """Precision, recall and F1 from SUMS; undefined ones are null."""
    p, r = (F.when(F.col(n) > 0, F.col(h) / F.col(n)) for h, n in (("dh", "d"), ("eh", "e")))
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).alias("f1")]


def bootstrap_prf(det: DataFrame, ev: DataFrame, replicates: int = 2000, seed: int = 7, flag: str = "matched") -> DataFrame:
    """95 % intervals of precision, recall and F1 when entities are drawn with replacement, all three from the same draws.

    det and ev: entity_id and whether each detection or event is matched. A draw where one is undefined doesn't count for it.
    """
    return bootstrap_units(matched_units(det, ev, flag=flag), replicates, seed)


def bootstrap_units(units: DataFrame, replicates: int = 2000, seed: int = 7) -> DataFrame:
    """The same from entity_id and SUMS."""
    each = resampled(units, ["entity_id"], SUMS, replicates, seed).select(*ratios())
    return each.agg(*[c for m in ("precision", "recall", "f1") for c in _interval(m)])


def mann_whitney(tally: DataFrame) -> DataFrame:
    """U of group a, with ties counting half, and the two-sided p of its normal approximation, corrected for ties and continuity.

    tally: v, na, nb, the distinct values with their numbers. Values lie in ranges; each range adds what lies below it, so
    none is ordered in one task. p is null where all values are equal.
    """
    ranges = int(tally.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(tally.approxQuantile("v", [i / ranges for i in range(1, ranges)], 0.1 / ranges))) if ranges > 1 else []
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col("v"))) if bounds else F.lit(0)
    placed = tally.withColumn("_at", at)
    totals = placed.groupBy("_at").agg(F.sum("nb").alias("_nb")).orderBy("_at").collect()  # a row a range
    below, before = {}, 0
    for r in totals:
        below[r["_at"]] = before
        before += r["_nb"]
    if not below:
        below = {0: 0}
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in below.items() for x in kv]), F.col("_at"))
    inside = Window.partitionBy("_at").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("_below", F.coalesce(F.sum("nb").over(inside), F.lit(0)) + offset)
    t = (F.col("na") + F.col("nb")).cast("double")
    u = ranked.agg(F.sum(F.col("na") * (F.col("_below") + F.col("nb") / 2)).alias("mann_whitney_u"), F.sum("na").cast("double").alias("_a"), F.sum("nb").cast("double").alias("_b"), F.sum(t * t * t - t).alias("_t"))
    n, middle = F.col("_a") + F.col("_b"), F.col("_a") * F.col("_b") / 2
    spread = F.sqrt(F.col("_a") * F.col("_b") / 12 * (n + 1 - F.col("_t") / (n * (n - 1))))

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda x: min(1.0, math.erfc(x / math.sqrt(2))), na_action="ignore")

    z = F.when((n > 1) & (spread > 0), (F.abs(F.col("mann_whitney_u") - middle) - 0.5) / spread)
    return u.select("mann_whitney_u", tail(z).alias("mann_whitney_p"))


def two_groups(rows: DataFrame, group: str, value: str, least: int = 5, replicates: int = 4000, seed: int = 0) -> DataFrame:
    """Whether groups a and b differ: means' and medians' difference, a bootstrap interval of the former, the effect in
    pooled standard deviations, Mann-Whitney U and p. One row; TOO_FEW where a side has fewer than `least` values, else SHIFT
    where the interval leaves out 0, or NO_DETECTABLE_SHIFT.
    """
    # read many times: what the rows come from is computed once
    rows = cut(rows.filter(F.col(value).isNotNull() & F.col(group).isin("a", "b")).select(group, value))
    side = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    mid = lambda c: F.percentile(c, F.lit(0.5))
    s = rows.agg(*[side(g, f).alias(f"{n}_{g}") for g in "ab" for n, f in (("n", F.count), ("mean", F.avg), ("median", mid), ("var", F.var_samp))]).first()
    few = min(s["n_a"], s["n_b"]) < least
    told = {"n_a": s["n_a"], "n_b": s["n_b"], "mean_difference": None, "median_difference": None, "effect": None, "low": None, "high": None, "mann_whitney_u": None, "mann_whitney_p": None, "status": "TOO_FEW"}
    if not few:
        tally = cut(rows.groupBy(F.col(value).cast("double").alias("v")).agg(F.count_if(F.col(group) == "a").alias("na"), F.count_if(F.col(group) == "b").alias("nb")))
        means = {}
        for k, g in enumerate("ab"):  # equal values are drawn as one, as often as they are
            own = tally.filter(F.col(f"n{g}") > 0).withColumn("s", F.col("v"))
            means[g] = resampled(own, ["v"], ["s"], replicates, 2 * seed + k, f"n{g}").select("r", (F.col("s") / s[f"n_{g}"]).alias(f"m{g}"))
        low, high = means["a"].join(means["b"], "r").select((F.col("ma") - F.col("mb")).alias("d")).agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))).first()[0]
        pooled = math.sqrt((s["var_a"] + s["var_b"]) / 2)
        u = mann_whitney(tally).first()
        told |= {"mean_difference": s["mean_a"] - s["mean_b"], "median_difference": s["median_a"] - s["median_b"], "effect": (s["mean_a"] - s["mean_b"]) / pooled if pooled > 0 else None}
        told |= {"low": low, "high": high, "mann_whitney_u": float(u[0]), "mann_whitney_p": u[1], "status": "SHIFT" if low > 0 or high < 0 else "NO_DETECTABLE_SHIFT"}
    return rows.sparkSession.createDataFrame([tuple(told.values())], "n_a long, n_b long, mean_difference double, median_difference double, effect double, low double, high double, mann_whitney_u double, mann_whitney_p double, status string")


def compared(rows: DataFrame, keys: Sequence[str], a: str, b: str, baseline: str, y: str = "target") -> DataFrame:
    """Two forecasters (prefixes a and b of quantile columns) and a baseline on the same rows: scores, coverage, skill of b.

    A skill is 1 - score / other score, null where the other is not positive.
    """
    t = F.col(y)
    quantiles = lambda p: [F.col(p + n) for n in NAMES]
    inside = lambda p: F.avg(t.between(F.col(p + "p10"), F.col(p + "p90")).cast("double"))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(crps(t, quantiles(a))).alias("crps_a"), F.avg(crps(t, quantiles(b))).alias("crps_b"), F.avg(F.abs(t - F.col(baseline))).alias("mae_clim"),
        inside(a).alias("coverage_a"), inside(b).alias("coverage_b"),
    )
    skill = lambda other: F.when(F.col(other) > 0, 1 - F.col("crps_b") / F.col(other))
    return out.withColumns({"skill_a": skill("crps_a"), "skill_clim": skill("mae_clim")})


def gate(scores: DataFrame, least_wins: int = 2) -> DataFrame:
    """Whether the challenger replaces the champion: CRPS wins in enough buckets and coverage no worse, for all variables."""
    s = scores.withColumn("_win", F.col("crps_b") < F.col("crps_a")).groupBy("variable").agg(F.count_if("_win").alias("wins"), F.avg(F.abs(F.col("coverage_b") - 0.8)).alias("_eb"), F.avg(F.abs(F.col("coverage_a") - 0.8)).alias("_ea"))
    return s.withColumn("passed", (F.col("wins") >= least_wins) & (F.col("_eb") <= F.col("_ea"))).drop("_ea", "_eb")


def attribute_selection(df: DataFrame, columns: Sequence[str], most_missing: float = 0.05) -> DataFrame:
    """attribute, dropped: why a static attribute can't be used, null where it can."""
    stats = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"m_{c}") for c in columns], *[F.count_distinct(c).alias(f"n_{c}") for c in columns])
    items = [F.struct(F.lit(c).alias("attribute"), F.when(F.col(f"m_{c}") > most_missing, "MISSING").when(F.col(f"n_{c}") <= 1, "CONSTANT").alias("dropped")) for c in columns]
    return stats.select(F.inline(F.array(*items)))

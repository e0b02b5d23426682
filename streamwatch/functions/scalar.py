"""Column functions. None of them turns a missing input into a number."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the turbidity index.
TURBIDITY_A, TURBIDITY_C = 366.14, 0.19563
SEASONS = {12: "DJF", 1: "DJF", 2: "DJF", 3: "MAM", 4: "MAM", 5: "MAM", 6: "JJA", 7: "JJA", 8: "JJA", 9: "SON", 10: "SON", 11: "SON"}
YEAR_DAYS = 365.25


def known(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c), c)


def turbidity(rho: Column, a: float = TURBIDITY_A, c: float = TURBIDITY_C) -> Column:
    """a * rho / (1 - rho / c) where 0 <= rho < 0.9 c, else null."""
    return F.when((rho >= 0) & (rho < 0.9 * c), F.lit(a) * rho / (1 - rho / c))


def classify_water(usable: Column, cloud: Column, water: Column, valid_share: Column, in_domain: Column, max_cloud: float = 0.2, min_water: int = 5, min_valid: float = 0.5) -> Column:
    """The first flag that applies."""
    return (
        F.when((usable <= 0) | (cloud > max_cloud), "CLOUD")
        .when(F.coalesce(water, F.lit(0)) < min_water, "NO_WATER_PIXELS")
        .when((valid_share >= min_valid) & in_domain, "OK")
        .otherwise("OUT_OF_RANGE")
    )


def classify_bank(land: Column, usable_share: Column, ndvi: Column, min_usable: float = 0.5) -> Column:
    return F.when(F.coalesce(land, F.lit(0)) <= 0, "NO_LAND_PIXELS").when(usable_share < min_usable, "CLOUD").when(ndvi.between(-1, 1), "OK").otherwise("OUT_OF_RANGE")


def season(date: Column, months: Mapping[int, str] = SEASONS) -> Column:
    if sorted(months) != list(range(1, 13)):
        raise ValueError("seasons must cover the months 1 to 12 once each")
    return F.element_at(F.array(*[F.lit(months[m]) for m in range(1, 13)]), F.month(date))


def harmonics(date: Column) -> tuple[Column, Column]:
    angle = F.dayofyear(date) * (2 * math.pi / YEAR_DAYS)
    return F.sin(angle), F.cos(angle)


def snap(value: Column, grid: float) -> Column:
    """Nearest multiple of grid, ties to even, to six digits."""
    return F.bround(F.bround(value / grid) * grid, 6)


def first_flush(dry_days: Column, peak_hour: Column) -> Column:
    return dry_days * peak_hour


def low_flow(temp: Column, api: Column, largest: Column) -> Column:
    """temp * (1 - api / largest), the ratio held in 0 to 1."""
    return F.when(api.isNotNull() & largest.isNotNull(), temp * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), api / largest))))


def bucket_of(horizon: Column, buckets: Mapping[str, Sequence[int]]) -> Column:
    out = F.lit(None).cast("string")
    for name, hs in buckets.items():
        out = F.when(horizon.isin(list(hs)), name).otherwise(out)
    return out


def obs_class(observable: Column) -> Column:
    return F.when(observable, "observable").when(~observable, "driver_only").otherwise("unassessed")


def forward(value: Column, transform: str) -> Column:
    return F.log1p(value) if transform == "log1p" else value


def backward(value: Column, transform: str) -> Column:
    return F.expm1(value) if transform == "log1p" else value


def rearranged(quantiles: Sequence[Column]) -> tuple[Column, Column]:
    """Quantiles in rising order, and whether they had crossed. A null among them leaves null."""
    packed = F.array(*quantiles)
    missing = F.exists(packed, lambda x: x.isNull())
    in_order = F.array_sort(packed)
    return F.when(~missing, in_order), F.when(~missing, ~in_order.eqNullSafe(packed))


def three_valued(c: Column) -> Column:
    """True, false, unknown as 1, 0, null."""
    return c.cast("double")


def triangular_quantile(p: Column, low: Column, mode: Column, high: Column) -> Column:
    width = high - low
    cut = (mode - low) / width
    rising = low + F.sqrt(p * width * (mode - low))
    falling = high - F.sqrt((1 - p) * width * (high - mode))
    return F.when(width <= 0, mode).when(p < cut, rising).otherwise(falling)


def call_weight(locations: Column, days: Column, variables: Column) -> Column:
    return locations * F.ceil(days / 14) * F.ceil(variables / 10)


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Interval of a share; null for no trials."""
    p, zz = k / n, z * z
    centre = (p + F.lit(zz) / (2 * n)) / (1 + F.lit(zz) / n)
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(zz) / (4 * n * n)) / (1 + F.lit(zz) / n)
    return F.when(n > 0, centre - half), F.when(n > 0, centre + half)


def centroid(ring: Column) -> tuple[Column, Column, Column]:
    """x, y and area of a polygon given as an array of (x, y), by the shoelace sums."""
    n = F.size(ring)
    pairs = F.zip_with(ring, F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1)), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    cross = lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"]
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda t, e: t + f(e))
    twice = total(cross)
    return total(lambda e: (e["ax"] + e["bx"]) * cross(e)) / (3 * twice), total(lambda e: (e["ay"] + e["by"]) * cross(e)) / (3 * twice), F.abs(twice) / 2

"""Registered queries: each is a function of (spark, sf_dir), with SQL of the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Added before rounding on both sides, so that a value half-way between two rounded ones goes up on both.
NUDGE = 1e-9


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            once = sql.replace(f" + {NUDGE}", "")
            ORACLES[f.__name__] = once.replace(", 6) + 0.0", f" + {NUDGE}, 6) + 0.0").replace(", 5) + 0.0", f" + {NUDGE}, 5) + 0.0")
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that another order of summing gives the same value; -0.0 becomes 0.0."""
    return df.select(*[(F.round(F.col(f"`{n}`") + NUDGE, digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])

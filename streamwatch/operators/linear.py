"""Lines as points in order: positions along them, and their cutting into pieces."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PieceRules:
    """A piece is about `target` long, at most `most`, and not under `least` unless its line is; `least` goes before `most`."""

    target: float = 350.0
    least: float = 200.0
    most: float = 500.0

    def __post_init__(self) -> None:
        if not 0 < self.least <= self.target <= self.most:
            raise ValueError(f"a target of {self.target} is not within {self.least} to {self.most}")


def steps(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """points (keys, pos, x, y) as steps x1, y1, x2, y2 with the line's length before and after them, from_m and to_m.

    Points without a coordinate are left out; steps of no length too.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    known = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    out = known.select(*keys, "pos", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    out = out.withColumn("_len", F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))).filter("_len > 0")
    out = out.withColumn("to_m", F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("from_m", F.coalesce(F.lag("to_m").over(w), F.lit(0.0))).drop("_len")


def piece_count(length: Column, rules: PieceRules) -> Column:
    """How many pieces a line of this length has."""
    n = F.greatest(F.lit(1.0), F.round(length / rules.target), F.ceil(length / rules.most).cast("double"))
    n = F.least(n, F.greatest(F.lit(1.0), F.floor(length / rules.least).cast("double")))
    return F.when(length <= rules.most, 1).otherwise(n.cast("int"))


def cut_lines(points: DataFrame, keys: Sequence[str], box: tuple[float, float, float, float], rules: PieceRules = PieceRules()) -> DataFrame:  # noqa: B008
    """Equal pieces of lines: keys, piece, n_pieces, length, line (its points in order), mid_x, mid_y, inside, flag.

    Cut points lie on the line, by its length. A piece belongs to the box (x low, y low, x high, y high) if its middle lies
    within; others are returned with inside false, so that what is dropped can be counted. SHORT_LINK flags a line under the
    least length, which stays whole. A line of fewer than two different points has no piece.
    A step goes to the pieces that it overlaps, so a piece is put together from its own steps and no line is held whole.
    """
    s = steps(points, keys)
    w = Window.partitionBy(*keys)
    s = s.withColumn("_all", F.max("to_m").over(w)).withColumn("n_pieces", piece_count(F.col("_all"), rules))
    size = F.col("_all") / F.col("n_pieces")
    at = lambda c: F.least(F.floor(F.col(c) / size).cast("int"), F.col("n_pieces") - 1)
    s = s.withColumn("piece", F.explode(F.sequence(at("from_m"), at("to_m"))))
    low, high = F.greatest(F.col("from_m"), size * F.col("piece")), F.least(F.col("to_m"), size * (F.col("piece") + 1))
    s = s.withColumns({"_low": low, "_high": high, "_mid": size * (F.col("piece") + 0.5)}).filter("_high > _low")
    part = lambda d: (d - F.col("from_m")) / (F.col("to_m") - F.col("from_m"))
    x = lambda d: F.col("x1") + (F.col("x2") - F.col("x1")) * part(d)
    y = lambda d: F.col("y1") + (F.col("y2") - F.col("y1")) * part(d)
    point = lambda d: F.struct(d.alias("m"), x(d).alias("x"), y(d).alias("y"))
    low, high, mid = F.col("_low"), F.col("_high"), F.col("_mid")
    middle = F.when((low <= mid) & (mid <= high), F.struct(x(mid).alias("x"), y(mid).alias("y")))
    out = s.groupBy(*keys, "piece", "n_pieces").agg(
        F.sum(high - low).alias("length"), F.array_sort(F.collect_list(point(low))).alias("_line"), F.max_by(point(high), high).alias("_end"), F.min_by(middle, F.when(middle.isNotNull(), low)).alias("_at"), F.max("_all").alias("_all"),
    )
    line = F.transform(F.concat("_line", F.array("_end")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    x0, y0, x1, y1 = box
    mx, my = F.col("_at.x"), F.col("_at.y")
    return out.select(*keys, "piece", "n_pieces", "length", line.alias("line"), mx.alias("mid_x"), my.alias("mid_y"), ((mx > x0) & (mx < x1) & (my > y0) & (my < y1)).alias("inside"), F.when(F.col("_all") < rules.least, "SHORT_LINK").alias("flag"))

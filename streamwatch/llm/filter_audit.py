"""Filter interaction audit: what each filter removes, over all orders in which the filters can be applied.

A row's failed filters are one mask, so rows are counted by part and mask first. The orders are numbered by their
Lehmer rank, and all orders that begin with the same filters have consecutive ranks. A mask's removal at a step
therefore covers a few intervals of ranks: its counts are added at an interval's begin, taken off at its end, and a
prefix sum over the ranks gives every order's counts at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"
#: Filters that one audit takes at most: 7! orders of 7 steps a part.
MOST_FILTERS = 7


def intervals(mask: int, filters: int) -> list[tuple[int, bool, int, int]]:
    """(step, first, begin, end): in the orders of ranks begin to end - 1 the filter at that step fails the mask, as the
    first one that does (first) or after another one (not first). Neighbouring intervals are one."""
    found: dict[tuple[int, bool], list[list[int]]] = {}

    def walk(left: list[int], step: int, base: int, removed: bool) -> None:
        size = math.factorial(len(left) - 1)
        for i, f in enumerate(left):
            begin = base + i * size
            fails = bool(mask >> f & 1)
            if fails:
                spans = found.setdefault((step, not removed), [])
                if spans and spans[-1][1] == begin:
                    spans[-1][1] = begin + size
                else:
                    spans.append([begin, begin + size])
            if len(left) > 1:
                walk(left[:i] + left[i + 1 :], step + 1, begin, removed or fails)

    walk(list(range(filters)), 1, 0, False)
    return sorted((step, first, *span) for (step, first), spans in found.items() for span in spans)


def edges(filters: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(mask, step, rank, removed, redundant): what a row of that mask adds to the difference arrays at that rank.

    What would lie past the last rank is left out.
    """
    last = math.factorial(filters)
    for mask in range(1, 1 << filters):
        for step, first, begin, end in intervals(mask, filters):
            for rank, sign in ((begin, 1), (end, -1)):
                if rank < last:
                    yield mask, step, rank, sign * first, sign * (not first)


def audit(rows: DataFrame, part: str, failed: Sequence[str], marks: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Counts of every part, order of the filters and step: a row each, zeros included.

    rows: `part` (null is the empty string), a boolean column a filter, true where a row fails it (null: it passes), in
    the order that names them A, B, ...; `marks`: boolean columns of rows whose loss counts on its own. A row counts
    `weight` times (a long column), once by default.

    Returns the part, filter_order, step, kept (rows after the step), removed (at the step), redundant (failing the
    step's filter, removed before), unique_fails (failing that filter only), a `<mark>_lost` a mark (removed here), and
    shapley (what the step's filter removes, summed over all orders). Without rows there are no parts. Other columns are
    left out. The rows are added up by part and mask before a shuffle; all that follows has 2**filters rows a part, or
    filters * filters! rows a part, the size of the result.
    """
    n = len(failed)
    if not 1 <= n <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {n}")
    spark, ranks = rows.sparkSession, math.factorial(n)
    once = F.col(weight) if weight else F.lit(1).cast("long")
    own = lambda c: F.coalesce(F.col(c), F.lit(False))
    mask = sum((F.when(own(c), 1 << i).otherwise(0) for i, c in enumerate(failed)), F.lit(0))
    kinds = {"_n": once} | {f"_m{i}": F.when(own(c), once).otherwise(F.lit(0).cast("long")) for i, c in enumerate(marks)}
    slim = rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"), mask.alias("_mask"), *[c.alias(k) for k, c in kinds.items()])
    by_mask = slim.groupBy("_part", "_mask").agg(*[F.sum(k).alias(k) for k in kinds])

    # what is told of a part: all its rows, and the rows that fail one filter only
    only = [F.sum(F.when(F.col("_mask") == 1 << i, F.col("_n")).otherwise(0)).alias(f"_u{i}") for i in range(n)]
    parts = by_mask.groupBy("_part").agg(F.sum("_n").alias("_all"), *only)

    # the difference arrays: a row for each place where some mask's interval begins or ends
    table = spark.createDataFrame(list(edges(n)), "_mask int, _step int, _rank int, _first int, _again int")
    ends = by_mask.join(F.broadcast(table), "_mask")  # at most 2**n * 2 * n! rows, by MOST_FILTERS
    deltas = ends.select("_part", "_step", "_rank", *[(F.col(k) * F.col("_first")).alias(f"{k}_d") for k in kinds], (F.col("_n") * F.col("_again")).alias("_r_d"))
    names = [f"{k}_d" for k in kinds] + ["_r_d"]
    places = parts.select("_part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_step"))
    places = places.select("_part", "_step", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))).alias("_rank"), *[F.lit(0).cast("long").alias(c) for c in names])
    arrays = deltas.unionByName(places).groupBy("_part", "_step", "_rank").agg(*[F.sum(c).alias(c) for c in names])

    # prefix sums over the ranks give every order's counts, and a running sum over the steps what is kept
    along = Window.partitionBy("_part", "_step").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = arrays.select("_part", "_step", "_rank", *[F.sum(c).over(along).alias(c) for c in names])
    orders = F.array(*[F.lit("".join(chr(65 + i) for i in p)) for p in permutations(range(n))])
    told = summed.join(parts, "_part").withColumn("_order", F.element_at(orders, F.col("_rank") + 1))
    told = told.withColumn("_f", F.ascii(F.substring("_order", F.col("_step"), F.lit(1))) - 65)
    through = Window.partitionBy("_part", "_rank").orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    return told.select(
        F.col("_part").alias("part"), F.col("_order").alias("filter_order"), F.col("_step").alias("step"),
        (F.col("_all") - F.sum("_n_d").over(through)).alias("kept"), F.col("_n_d").alias("removed"), F.col("_r_d").alias("redundant"),
        F.element_at(F.array(*[F.col(f"_u{i}") for i in range(n)]), F.col("_f") + 1).alias("unique_fails"),
        *[F.col(f"_m{i}_d").alias(f"{c}_lost") for i, c in enumerate(marks)],
        F.sum("_n_d").over(Window.partitionBy("_part", "_f")).alias("shapley"),
    )


def text_flags(text: Column) -> dict[str, Column]:
    """Whether a text fails: A fewer than 200 words, B fewer than half of its words distinct, C capitals A to Z more than
    2 in 100 code points, D a sign of #$%&*|. A null text is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, good, toxic and n: so many documents of that part fail these filters and bear these labels.

    E: the text equals that of any smaller doc_id in the table. A document of null id is never after another one and
    bears no label; documents of one id and text are equals. good and toxic: any label row of the id says 1.

    Texts are shuffled as SHA-256 digests. Neither the copies of a text nor the rows of an id meet in one task: rows are
    counted by id and text, and the first id of a text is joined on both.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(text.cast("binary"), 256)).alias("_text")
    slim = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), key, *[c.alias(k) for k, c in text_flags(F.col("text")).items()])
    counted = slim.groupBy("doc_id", "_text", "part", *LETTERS[:4]).agg(F.count("*").alias("n"))
    firsts = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", key).groupBy("_text").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    named = counted.filter(F.col("doc_id").isNotNull()).join(firsts, ["doc_id", "_text"], "left").join(marks, "doc_id", "left")
    named = named.withColumn("E", F.col("_first").isNull()).select("part", *LETTERS, "good", "toxic", "n")
    unnamed = counted.filter(F.col("doc_id").isNull()).select("part", *LETTERS[:4], F.lit(False).alias("E"), F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
    return named.unionByName(unnamed)


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of the five
    filters of `flagged` over all 120 orders, for every source."""
    return audit(flagged(docs, labels), "part", list(LETTERS), ["good", "toxic"], "n")

"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, digest, digits_for, running, words_of

SEED = "mix-1"
WEIGHTS = (5, 2, 1)
#: Words of the mix over words of the input, and how often a source may be repeated.
SHARE, MOST = 1.5, 2.0
#: Target words of a source are rounded to so many digits, that sums in another order give the same number.
DIGITS = 6
#: Mean characters a word (the space behind it included) of plain text.
WORD_LENGTH = (3.0, 10.0)


def quality(text: Column, size: Column) -> Column:
    """Weight of a document, 0.25 to 1: a quarter each for few runs of symbols, few digits and words of usual length.

    All three are measured on the whole text: symbol runs against words, digits against characters, and the mean number of
    characters a word, less the farther it is below or above WORD_LENGTH.
    """
    low, high = WORD_LENGTH
    chars = F.length(text).cast("double")
    marks = F.regexp_count(text, F.lit(r"[#$%&*!?~^|<>{}\[\]=_+]{2,}"))
    digits = F.regexp_count(text, F.lit(r"[0-9]"))
    clean = size / (size + 4 * marks + F.lit(1))
    worded = F.lit(1.0) - digits / (chars + 1)
    mean = chars / (size + F.lit(1))
    usual = F.when(mean < low, mean / low).when(mean > high, F.lit(high) / mean).otherwise(1.0)
    return F.lit(0.25) + F.lit(0.25) * clean + F.lit(0.25) * worded + F.lit(0.25) * usual


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds target to the sources (columns source, source_size): the share of all sizes split by weight, each target
    at most `most` times its source, the excess reshared by weight until none is above.

    Sources are taken by code point, null last, and weigh weights[0], weights[1], ..., again and again. The fixed point
    of the resharing is a water level: sources in rising order of cap over weight are capped while the level that the
    rest would get is above their own. The table has one row a source.
    """
    ordered = sizes.withColumn("_one", F.lit(0))
    by_name = Window.partitionBy("_one").orderBy(F.col("source").isNull(), "source")
    weighed = ordered.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))).withColumn("_cap", F.lit(most) * F.col("source_size"))
    all_ = Window.partitionBy("_one")
    by_ratio = all_.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(all_) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(all_) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    leveled = weighed.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("_w") < F.col("_cap"))
    final = F.min(F.when(F.col("_free"), F.struct("_cap_rank", "_level"))).over(all_)["_level"]
    leveled = leveled.withColumn("_cap_rank", F.row_number().over(by_ratio))
    return leveled.withColumn("_final", final).select("source", "source_size", F.round(F.coalesce(F.least(F.col("_cap"), F.col("_final") * F.col("_w")), F.col("_cap")), DIGITS).alias("target"))


def mix(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, whole: bool = False) -> DataFrame:
    """Adds source_size, target (in words, to DIGITS digits) and taken to rows with doc_id, source, size and weight.

    Each source first takes floor(target / size) complete epochs of all its documents. What is left of the target goes
    to the documents of smallest key -ln(u) / weight (u: a seeded hash of doc_id), in the order of their keys: whole ones
    while they fit. The one at the edge gives just the words that are left, or, if `whole`, all of its words when that
    ends nearer to the target, else none.
    """
    h = digest(seed, F.col("doc_id"))
    u = (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(16**12))
    key = -F.log(u) / F.col("weight")
    names = rows.columns
    # (1 - exp(-key)) rises with the key and spreads the rows of a source evenly enough over its buckets
    slim = cut(
        rows.withColumn("_g", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))))
        .withColumn("_h", h).withColumn("_key", key)
    )
    buckets = 16 ** digits_for(slim.count())
    slim = slim.withColumn("_b", F.least(F.floor((1 - F.exp(-F.col("_key"))) * buckets), F.lit(buckets - 1)).cast("long"))
    sizes = slim.groupBy("_g").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    goal = targets(sizes.select("source", "source_size"), weights, share, most)
    goal = goal.withColumn("_g", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))).drop("source")
    order = ["_key", "_h", *sorted(names)]
    placed = running(slim, ["_g"], "_b", order, {"_before": "size"}).join(goal, "_g")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round(F.col("target")).cast("long") - F.col("_epochs") * F.col("source_size")
    over = F.col("_rest") - F.col("_before")
    part = F.when(over * 2 >= F.col("size"), F.col("size")).otherwise(0) if whole else over
    chosen = F.when(over >= F.col("size"), F.col("size")).when(over > 0, part).otherwise(0)
    out = placed.withColumn("_epochs", epochs).withColumn("_rest", rest)
    return out.withColumn("taken", (F.col("_epochs") * F.col("size") + chosen).cast("long")).select(*names, "source_size", "target", "taken")


def weighed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and weight of every document."""
    sized = docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), F.coalesce("text", F.lit("")).alias("_t"))
    return sized.select("doc_id", "source", "size", quality(F.col("_t"), F.col("size")).alias("weight"))


def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document (see mix), and its source and weight.

    A null text has size 0 and is never taken; a null source is a source of its own, the last. Null ids share one u.
    Repeated rows count each; among rows equal in every column it doesn't matter which is at the edge. An empty table
    gives no rows; where all texts are empty, all targets are 0.
    """
    return mix(weighed(docs), weights, share, most, seed).select("doc_id", "size", "source_size", "target", "taken", "source", "weight")


def mixed_corpus(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as the mix takes it whole (see mix with whole=True), columns as given."""
    names = docs.columns
    text = F.coalesce("text", F.lit(""))
    size = words_of(F.col("text"))
    # numbered once and written, so that each row keeps its number; equal rows are rows of their own
    rows = cut(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), "doc_id", "source", size.alias("size"), quality(text, size).alias("weight"), F.monotonically_increasing_id().alias("_row")))
    taken = mix(rows.drop("_doc"), weights, share, most, seed, whole=True).filter(F.col("taken") > 0)
    copies = rows.select("_doc", "_row").join(taken.select("_row", F.expr("int(taken div size)").alias("_times")), "_row")
    return copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_doc.*")

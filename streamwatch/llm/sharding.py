"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, digest, digits_for, hex_bucket, running

SEED = "shards-1"


def interleaved(rows: DataFrame, strata: str, key: Column, shards: int = 16, seed: str = SEED) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (gapless from 0 in each shard) to rows.

    Rows are shuffled by a seeded hash of key within each stratum, ranked, sorted over all strata by their fractional
    rank (rank + 1/2) / size, and cut into shards of equal counts (at most one apart): each shard holds every stratum in
    proportion. A null stratum is one of its own. Repeated rows take places of their own; the order among rows equal in
    every column doesn't matter. No stratum is sorted in one task: ranks are summed up over hash buckets.
    """
    names = rows.columns
    slim = cut(rows.withColumn("_h", digest(seed, key)).withColumn("_g", F.when(F.col(strata).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(strata)))))
    digits = digits_for(slim.count())
    slim = slim.withColumn("_b", hex_bucket(F.col("_h"), digits))
    order = ["_h", *sorted(names)]
    ranked = running(slim, ["_g"], "_b", order, {}, "_rank")
    sizes = slim.groupBy("_g").agg(F.count("*").alias("_n"))
    part = cut(
        ranked.join(sizes, "_g")
        .withColumn("_f", (F.col("_rank").cast("double") + F.lit(0.5)) / F.col("_n"))
        .withColumn("_b", F.floor(F.col("_f") * 16**digits).cast("long"))
        .withColumn("_all", F.lit(0))
        .drop("_rank", "_n")
    )
    placed = running(part, ["_all"], "_b", ["_f", "_g", *order], {}, "_at")
    total = part.groupBy("_all").agg(F.count("*").alias("_total"))
    shard = F.expr(f"(_at * {shards}L) div _total")
    first = F.expr(f"(shard * _total + {shards - 1}L) div {shards}L")
    return placed.join(total, "_all").withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_at") - first).cast("long")).select(*names, "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = 16, seed: str = SEED) -> DataFrame:
    """Every document with its shard under the law `rows` (shard counts at most one apart).

    Returns doc_id, size (UTF-8 bytes plus 1; null text: 1), text_crc32, law, shard, slot, grown_shard (null under this
    law) and source. Null ids, null sources and repeated rows are placed like any other; extra columns are left out.
    An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = interleaved(rows, "source", F.col("doc_id"), shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")

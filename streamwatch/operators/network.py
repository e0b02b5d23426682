"""Chains, topology and outlet snapping of line networks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut


def chains(topology: DataFrame) -> DataFrame:
    """entity_id, chain_id, place: entities with one way in and one way out belong to the chain of the entity before.

    Found by pointer doubling towards the head; a ring without a head keeps its smallest id as the chain.
    """
    out = topology.groupBy(F.col("upstream_id").alias("id")).agg(F.count("*").alias("n_out"))
    into = topology.groupBy(F.col("downstream_id").alias("id")).agg(F.count("*").alias("n_in"), F.min("upstream_id").alias("before"))
    nodes = topology.select(F.col("upstream_id").alias("id")).union(topology.select("downstream_id")).distinct()
    plain = nodes.join(into, "id", "left").join(out, "id", "left").withColumn("plain", (F.coalesce("n_in", F.lit(0)) == 1) & (F.coalesce("n_out", F.lit(0)) <= 1))
    single = plain.join(out.select(F.col("id").alias("before"), F.col("n_out").alias("b_out")), "before", "left")
    at = cut(single.select("id", F.when(F.col("plain") & (F.col("b_out") == 1), F.col("before")).otherwise(F.col("id")).alias("to")).withColumn("steps", (F.col("id") != F.col("to")).cast("long")).withColumn("least", F.least("id", "to")))
    for _ in range(max(1, at.count()).bit_length() + 1):  # by then every walk is longer than any chain or ring
        nxt = at.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_s"), F.col("least").alias("_l"))
        new = cut(at.join(nxt, "to").select("id", F.col("_to").alias("to"), (F.col("steps") + F.col("_s")).alias("steps"), F.least("least", "_l").alias("least")))
        done = new.join(at.select("id", F.col("to").alias("old")), "id").filter("old <> to").isEmpty()
        at = new
        if done:
            break
    head = at.select(F.col("id").alias("to"), (F.col("steps") == 0).alias("is_head"))
    got = at.join(head, "to", "left")
    return got.select(F.col("id").alias("entity_id"), F.when(F.col("is_head"), F.col("to")).otherwise(F.col("least")).alias("chain_id"), F.when(F.col("is_head"), F.col("steps")).alias("place"))


def topology(pieces: DataFrame) -> DataFrame:
    """Edges between consecutive pieces of a line, and from a piece's tail node to pieces of other lines that begin there."""
    a = pieces.select(*[F.col(c).alias(f"up_{c}") for c in ("line", "piece", "tail")])
    b = pieces.select(*[F.col(c).alias(f"down_{c}") for c in ("line", "piece", "head")])
    along = a.join(b, (F.col("up_line") == F.col("down_line")) & (F.col("down_piece") == F.col("up_piece") + 1))
    across = a.join(b, F.col("up_tail") == F.col("down_head")).filter("up_line <> down_line")
    keep = ["up_line", "up_piece", "down_line", "down_piece"]
    return along.select(*keep).union(across.select(*keep)).distinct()


def snapped(outlets: DataFrame, window: int, least: int, accumulation: Callable[[Column], Column], low: int, high: int) -> DataFrame:
    """The nearest cell of enough accumulation within the window of an outlet: the larger one, then the smaller cell, on ties."""
    cells = outlets.withColumn("cell", F.explode(F.sequence(F.greatest(F.lit(low), F.col("at") - window), F.least(F.lit(high), F.col("at") + window))))
    cells = cells.withColumns({"acc": accumulation(F.col("cell")), "distance": F.abs(F.col("cell") - F.col("at"))}).filter(F.col("acc") >= least)
    return cells.groupBy("outlet_id").agg(F.min_by("cell", F.struct("distance", -F.col("acc"), "cell")).alias("cell"), F.min("distance").alias("distance"))

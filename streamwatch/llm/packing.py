"""Packing tokenised documents into sequences by cutting-stock column generation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import balanced, cut, digest, digits_for, giving_back, hex_bucket, running
from .token_counts import ID_BYTES, ByteEncoder, loaded

CAPACITY = 1024
#: Lengths are priced in units of so many ids, rounded up: the program stays small, a piece wastes less than a unit.
UNIT = 8
END = b"\0\0\0\0"
#: The linear program ends within this share of the best value, or after so many columns.
GAP, COLUMNS = 1e-3, 4000


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of lengths (1 to capacity) of greatest price that fits; prices[l] is that of length l."""
    best = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        values = best[c - 1 :: -1][:c] + prices[1 : c + 1]  # take length l, then the best of c - l
        l = int(np.argmax(values))
        best[c], take[c] = (values[l], l + 1) if values[l] > best[c - 1] else (best[c - 1], 0)
    used, c = np.zeros(capacity + 1, dtype=np.int64), capacity
    while c > 0:
        if take[c]:
            used[take[c]] += 1
            c -= take[c]
        else:
            c -= 1
    return float(best[capacity]), used


def solve(counts: np.ndarray, capacity: int, gap: float = GAP, columns: int = COLUMNS) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces of each length) with repeats that cover counts[l] pieces of length l exactly.

    The master program min sum x, A x = counts, x >= 0 is solved by revised simplex steps; each new column is the
    knapsack optimum under the dual prices. Solutions are rounded down; what is left is packed best-fit, longest first.
    """
    lengths = np.flatnonzero(counts)
    need = counts[lengths].astype(float)
    m = len(lengths)
    left = counts.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    if m:
        per = capacity // lengths
        patterns = [np.zeros(m, dtype=np.int64) for _ in range(m)]
        for i in range(m):
            patterns[i][i] = per[i]
        inverse = np.diag(1.0 / per)
        x = need / per
        for step in range(columns):
            duals = inverse.sum(0)
            prices = np.zeros(capacity + 1)
            prices[lengths] = np.maximum(duals, 0)
            value, used = knapsack(prices, capacity)
            if value <= 1 + gap:  # the bound sum(x) / value is as near
                break
            column = used[lengths].astype(float)
            move = inverse @ column
            ratios = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
            row = int(np.argmin(ratios))
            if not np.isfinite(ratios[row]):
                break
            step_by = ratios[row]
            x = np.maximum(x - step_by * move, 0)
            x[row] = step_by
            patterns[row] = used[lengths].astype(np.int64)
            pivot = inverse[row] / move[row]
            inverse -= np.outer(move, pivot)
            inverse[row] = pivot
            if step % 200 == 199:
                inverse = inverse @ (2 * np.eye(m) - np.array(patterns, dtype=float).T @ inverse)  # mends what rounding has added up
                x = np.maximum(inverse @ need, 0)
        for pattern, amount in zip(patterns, x, strict=True):
            times = int(amount + 1e-9)
            if pattern.any() and times:
                times = min(times, int((left[lengths][pattern > 0] // pattern[pattern > 0]).min()))
            if pattern.any() and times > 0:
                full = np.zeros(capacity + 1, dtype=np.int64)
                full[lengths] = pattern
                left -= full * times
                out.append((full, times))
    while left.any():  # few pieces: less than one pattern's worth for each length
        full, room = np.zeros(capacity + 1, dtype=np.int64), capacity
        for l in np.flatnonzero(left)[::-1].tolist():
            if l <= room:
                n = min(int(left[l]), room // l)
                full[l] += n
                room -= n * l
        times = int((left[full > 0] // full[full > 0]).min())
        left -= full * times
        out.append((full, times))
    return out


class Plan:
    """For each length, the runs of ranks that each pattern takes, and the sequences they go to."""

    def __init__(self, patterns: list[tuple[np.ndarray, int]]):
        rows, self.sequences, given = [], 0, {}
        for full, times in patterns:
            order = 0
            for l in np.flatnonzero(full)[::-1].tolist():
                rows.append((l, given.get(l, 0), int(full[l]), self.sequences, order))
                given[l] = given.get(l, 0) + int(full[l]) * times
                order += int(full[l])
            self.sequences += times
        table = sorted(rows)
        self.by = {l: np.array([r[1:] for r in table if r[0] == l], dtype=np.int64) for l in {r[0] for r in table}}

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and order in it of pieces by length and rank within their length; length 0: -1 - rank, 0."""
        sequence, order = -1 - ranks.astype(np.int64), np.zeros(len(lengths), dtype=np.int64)
        for l in np.unique(lengths[lengths > 0]).tolist():
            own = np.flatnonzero(lengths == l)
            runs = self.by[l]
            at = np.searchsorted(runs[:, 0], ranks[own], side="right") - 1
            inside = ranks[own] - runs[at, 0]
            sequence[own] = runs[at, 2] + inside // runs[at, 1]
            order[own] = runs[at, 3] + inside % runs[at, 1]
        return sequence, order


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, doc_tokens and the CRC-32 of each piece of at most `capacity` ids, the last id 0 with them; no texts."""

    @giving_back
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = loaded(ByteEncoder, path), 4 * capacity
        for batch in balanced(batches, "text", ID_BYTES):
            ids = [x + END for x in encoder.batch([t or "" for t in batch.column("text").to_pylist()])]
            crcs = [[zlib.crc32(x[i : i + width]) for i in range(0, len(x), width)] for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "crcs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, doc_tokens long, crcs array<long>")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, unit: int = UNIT, seed: str = "pack-1") -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and id 0, so a null or empty text is one piece of length 1. Full pieces fill sequences of
    their own; the rest of each document (shorter than capacity) is packed. Only the histogram of rest lengths in units,
    at most capacity / unit counts, comes to the driver; documents are ranked within their length over hash buckets. Repeated rows
    are packed each; rows equal in every column may change places. An empty table gives no rows.
    """
    h = digest(seed, F.col("doc_id"))
    rest = {"_rest": F.expr(f"int(doc_tokens % {capacity})"), "_full": F.expr(f"doc_tokens div {capacity}"), "_bin": F.expr(f"int((doc_tokens % {capacity} + {unit - 1}) div {unit})")}
    slim = cut(tokenised(docs, path, capacity).withColumns(rest | {"_h": h, "_all": F.lit(0)}))
    slim = slim.withColumn("_b", hex_bucket(F.col("_h"), digits_for(slim.count())))
    counts = np.zeros(capacity // unit + 1, dtype=np.int64)
    for row in slim.filter("_bin > 0").groupBy("_bin").count().collect():  # capacity / unit rows at most
        counts[row["_bin"]] = row["count"]
    plan = Plan(solve(counts, capacity // unit))
    packed = docs.sparkSession.sparkContext.broadcast(plan)
    order = ["_h", "doc_id", "doc_tokens", "crcs"]
    ranked = running(cut(running(slim, ["_all"], "_b", order, {"_before": "_full"})), ["_bin"], "_b", order, {}, "_rank")

    @F.pandas_udf("struct<sequence: long, order: long>")
    def place(bins: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        sequence, order = packed.value.place(bins.to_numpy(), ranks.to_numpy())
        return pd.DataFrame({"sequence": sequence, "order": order})

    inside = Window.partitionBy("_to.sequence").orderBy("_to.order").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.withColumn("_to", place("_bin", "_rank")).withColumn("_offset", F.coalesce(F.sum("_rest").over(inside), F.lit(0)))
    k, last = F.col("k").cast("long"), F.col("k") == F.col("_full")
    return placed.select("*", F.posexplode("crcs").alias("k", "ids_crc32")).select(
        "doc_id", (k * capacity).alias("start"), F.when(last, F.col("_rest")).otherwise(capacity).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        F.when(last, F.col("_to.sequence")).otherwise(plan.sequences + F.col("_before") + k).alias("sequence_id"), F.when(last, F.col("_offset")).otherwise(0).cast("long").alias("offset"),
    )

"""Exact top-k inner-product search: a KD-tree in each shard, searched best-first under a bound that is passed on.

Shards are the leaves of a coarse KD split, so their boxes are tight; every shard's tree is built once. Queries first meet
the boxes of shards, then go in rounds to the trees of the shards whose bound reaches their kth score: the likeliest shard
first, then a few more, then the rest, and each round hands its kth score on to the next.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SCALE = 256
SHARD_ROWS = 4096
QUERY_ROWS = 8192
LEAF_ROWS = 128
#: Boxes of shards that a query meets at once, vectors that the coarse split is fitted on, and shards a query visits by round.
BOXES, SAMPLE, VISITS = 1024, 20_000, (1, 4)
#: Sums of products below this are exact in doubles.
EXACT = 2.0**53
SCHEMA = "query_id long, query_row long, vec_id long, score long"


def quantised(embedding: Column) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))


def usable(embedding: Column) -> Column:
    """False for null vectors and those with null, NaN or infinite components."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True))


class Tree:
    """Median splits on the widest dimension; every node keeps the tight box of its own points."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF_ROWS, rows: np.ndarray | None = None):
        """rows: numbers of the rows, by which a query leaves itself out; the ids, if not given."""
        order = np.argsort(ids, kind="stable")
        self.ids, points = ids[order], points[order]
        self.own = self.ids if rows is None else rows[order]
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.child: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        stack = [(np.arange(len(points)), -1, 0)]
        while stack:
            rows, parent, side = stack.pop()
            own = points[rows]
            node = len(self.low)
            self.low.append(own.min(0))
            self.high.append(own.max(0))
            self.child.append(None)
            self.rows.append(rows)
            if parent >= 0:
                pair = list(self.child[parent] or (0, 0))
                pair[side] = node
                self.child[parent] = (pair[0], pair[1])
            if len(rows) > leaf and points.shape[1]:
                axis = int(np.argmax(self.high[node] - self.low[node]))
                part = np.argpartition(own[:, axis], len(rows) // 2)
                stack += [(np.sort(rows[part[: len(rows) // 2]]), node, 0), (np.sort(rows[part[len(rows) // 2 :]]), node, 1)]
                self.rows[node] = rows[:0]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.points = [points[r] for r in self.rows]

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query its k best (score, id) at or over the kth score known from elsewhere; ties to smaller ids.

        own: each query's row, which it never meets.
        """
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        found = []
        for q, query in enumerate(queries):
            best: list[tuple[int, int]] = []  # (score, -id), the worst on top
            bound, floor = bounds[q].tolist(), kth[q]
            heap = [(-bound[0], 0)]
            while heap:
                value, node = heapq.heappop(heap)
                if -value < floor:
                    break  # what is left can't even tie
                if (pair := self.child[node]) is not None:
                    for x in pair:
                        if bound[x] >= floor:
                            heapq.heappush(heap, (-bound[x], x))
                    continue
                scores = self.points[node] @ query
                ids, rows = self.ids[self.rows[node]], self.own[self.rows[node]]
                for i in np.flatnonzero((scores >= floor) & (rows != own[q])).tolist():
                    item = (int(scores[i]), -int(ids[i]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                if len(best) == k:
                    floor = max(floor, best[0][0])
            found.append(sorted(best, reverse=True))
        return found


def _matrix(column: pd.Series) -> np.ndarray:
    """Doubles where every inner product is exact in them, else Python integers."""
    rows = np.array(column.tolist(), dtype=np.int64).reshape(len(column), -1)
    most = float(np.abs(rows.astype(float)).max(initial=0))
    return rows.astype(float) if most * most * max(1, rows.shape[1]) < EXACT else rows.astype(object)


def _pair(tree_points: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if tree_points.dtype != queries.dtype:
        return tree_points.astype(np.int64).astype(object), queries.astype(np.int64).astype(object)
    if tree_points.dtype != object and float(np.abs(tree_points).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1]) >= EXACT:
        return tree_points.astype(np.int64).astype(object), queries.astype(np.int64).astype(object)
    return tree_points, queries


def _rows(queries: pd.DataFrame, found: list[list[tuple[int, int]]]) -> pd.DataFrame:
    flat = [(int(q), int(r), -i, s) for q, r, best in zip(queries["query_id"], queries["query_row"], found, strict=True) for s, i in best]
    return pd.DataFrame(flat, columns=["query_id", "query_row", "vec_id", "score"]).astype("int64")


class Split:
    """Coarse shards of vectors of one length: medians of a sample on its widest dimension, level by level."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis, self.at = [], []
        parts = [sample]
        for _ in range(max(0, leaves - 1).bit_length()):
            axes = [int(np.argmax(p.max(0) - p.min(0))) if len(p) and p.shape[1] else 0 for p in parts]
            at = [float(np.median(p[:, a])) if len(p) and p.shape[1] else 0.0 for p, a in zip(parts, axes, strict=True)]
            self.axis.append(np.array(axes))
            self.at.append(np.array(at))
            parts = [q for p, a, m in zip(parts, axes, at, strict=True) for q in ((p[p[:, a] < m], p[p[:, a] >= m]) if p.shape[1] else (p, p[:0]))]

    def leaf(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), dtype=np.int64)
        for axis, at in zip(self.axis, self.at, strict=True):
            side = points[np.arange(len(points)), axis[out]] >= at[out] if points.shape[1] else np.zeros(len(points), dtype=bool)
            out = 2 * out + side
        return out


def _bounds(low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> np.ndarray:
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def top_k(vectors: DataFrame, asked: Column | str, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, boxes: int = BOXES) -> DataFrame:
    """The k other rows of largest integer inner product for each row where `asked`: query_id, rank, vec_id, score.

    Null ids and unusable vectors take no part. Rows count each, also those of the same id or the same vector; a query
    leaves just its own row out. Vectors of different lengths are never compared. Ties go to smaller ids. Extra columns
    are left out; empty tables give no rows.

    A leaf of the coarse split with more rows than a shard holds (copies, say) is dealt to several shards by a hash of the
    row. The split is fitted on SAMPLE vectors at most; any split gives the same rows. Of the shards only row counts come
    to the driver, a number for each. Queries meet the shards' boxes in blocks of `boxes`.
    """
    spark = vectors.sparkSession
    kept = vectors.filter(F.col(vec_id).isNotNull() & usable(F.col(embedding)))
    base = kept.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(embedding)).alias("v"), F.coalesce(F.expr(asked) if isinstance(asked, str) else asked, F.lit(False)).alias("asked"))
    base = cut(base.withColumns({"dim": F.size("v"), "row": F.monotonically_increasing_id()}))
    per_dim = {r["dim"]: r["n"] for r in base.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    few = base.orderBy(F.xxhash64("row"), "row").select("dim", "v").limit(SAMPLE).toPandas()
    splits = {d: Split(_matrix(few["v"][few["dim"] == d]).astype(float) if (few["dim"] == d).any() else np.zeros((0, d)), -(-n // shard_rows)) for d, n in per_dim.items()}
    fitted = spark.sparkContext.broadcast(splits)  # at most 2 numbers a shard, and shards by SAMPLE's own splits

    @F.pandas_udf("long")
    def leaf_of(dim: pd.Series, v: pd.Series) -> pd.Series:
        out = np.zeros(len(dim), dtype=np.int64)
        for d in dim.unique().tolist():
            at = np.flatnonzero((dim == d).to_numpy())
            out[at] = fitted.value[d].leaf(_matrix(v.iloc[at]).astype(float))
        return pd.Series(out)

    placed = cut(base.withColumn("leaf", leaf_of("dim", "v")))
    sizes = placed.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    sharded = placed.join(sizes, ["dim", "leaf"]).withColumn("part", part)

    def plant(key, df: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(df["vec_id"].to_numpy(), _matrix(df["v"]), rows=df["row"].to_numpy())
        low, high = ([int(x) for x in side[0]] for side in (tree.low, tree.high))
        return pd.DataFrame([(*key, pickle.dumps(tree), low, high)], columns=["dim", "leaf", "part", "tree", "low", "high"])

    trees = cut(sharded.groupBy("dim", "leaf", "part").applyInPandas(plant, "dim int, leaf long, part int, tree binary, low array<long>, high array<long>"))
    n_shards = trees.count()
    shard_of = F.xxhash64("dim", "leaf", "part")
    trees = trees.withColumn("shard", shard_of)
    blocks = max(1, -(-n_shards // boxes))
    shards = trees.select("dim", "shard", "low", "high", F.pmod(F.xxhash64("shard", F.lit(3)), F.lit(blocks)).cast("int").alias("block"))
    queries = base.filter("asked").select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), "v", "dim")
    parts = max(1, -(-max(1, queries.count()) // query_rows))
    queries = cut(queries.withColumn("part", F.pmod(F.xxhash64("query_row", F.lit(7)), F.lit(parts)).cast("int")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    found = spark.createDataFrame([], SCHEMA)
    ranked = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    seen = 0
    for visits in (*VISITS, None):
        if seen >= n_shards:
            break
        best = found.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("low"))
        asks = queries.join(best, "query_row", "left").select("query_id", "query_row", "v", "dim", "part", F.when(F.col("n") >= k, F.col("low")).alias("kth"))

        top = None if visits is None else seen + visits

        def reached(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            """Shards whose bound reaches the kth score, the likeliest of the block if only some are asked for."""
            out = {"query_row": [], "shard": [], "bound": []}
            if len(left) and len(right):
                qs = _matrix(right["v"]).astype(float)
                low, high, order = _matrix(left["low"]).astype(float), _matrix(left["high"]).astype(float), left["shard"].to_numpy()
                widest = np.maximum(np.abs(low), np.abs(high)).max(0, initial=0)
                for q, kth in enumerate(right["kth"].astype("float64").fillna(-np.inf)):
                    # in doubles, rounded up: a bound is never under the true one
                    b = _bounds(low, high, qs[q : q + 1])[0] + 1e-12 * (np.abs(qs[q]) @ widest)
                    hit = np.flatnonzero(b >= kth)
                    if top is not None and len(hit) > top:
                        hit = hit[np.lexsort((order[hit], -b[hit]))[:top]]
                    out["query_row"] += [int(right["query_row"].iloc[q])] * len(hit)
                    out["shard"] += order[hit].tolist()
                    out["bound"] += b[hit].tolist()
            return pd.DataFrame(out).astype({"query_row": "int64", "shard": "int64", "bound": "float64"})

        met = shards.withColumn("part", every(parts)).groupBy("dim", "block", "part").cogroup(asks.withColumn("block", every(blocks)).groupBy("dim", "block", "part"))
        goes = met.applyInPandas(reached, "query_row long, shard long, bound double")
        if seen:  # but where it has been
            goes = goes.join(been, ["query_row", "shard"], "left_anti")
        if visits is not None:
            likeliest = Window.partitionBy("query_row").orderBy(F.desc("bound"), "shard")
            goes = goes.withColumn("_n", F.row_number().over(likeliest)).filter(F.col("_n") <= visits)
        goes = cut(goes.select("query_row", "shard"))
        been = goes if not seen else been.unionByName(goes)
        seen += visits or n_shards
        asking = goes.groupBy("shard").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("parts"))
        sent = asks.drop("part").join(goes.join(asking, "shard").withColumn("part", F.pmod(F.xxhash64("query_row", F.lit(9)), F.col("parts")).cast("int")), "query_row")

        def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return _rows(right.iloc[:0], [])
            tree = pickle.loads(left["tree"].iloc[0])
            own, qs = right["query_row"].to_numpy(), _matrix(right["v"])
            kth = right["kth"].astype("float64").fillna(-np.inf).to_numpy()
            points = tree.points
            _, qs = _pair(np.concatenate(points), qs)
            if qs.dtype == object:
                tree.points = [p.astype(np.int64).astype(object) for p in points]
                tree.low, tree.high = (x.astype(np.int64).astype(object) for x in (tree.low, tree.high))
            return _rows(right, tree.search(own, qs, k, kth))

        held = trees.select("shard", "tree").join(asking, "shard").select("shard", "tree", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        new = held.groupBy("shard", "part").cogroup(sent.groupBy("shard", "part")).applyInPandas(search, SCHEMA)
        found = cut(found.unionByName(new).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).drop("rank"))
    return found.withColumn("rank", F.row_number().over(ranked)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

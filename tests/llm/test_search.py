import math

import numpy as np
import pytest
from oracle import same

from streamwatch.llm import kdtree
from streamwatch.llm.queries import ORACLES, QUERIES


def test_query_equals_its_sql(spark, sf):
    same(QUERIES["op1_kd_tree_search"](spark, sf), sf, ORACLES["op1_kd_tree_search"])


def brute(rows, k):
    out = []
    for n, (q, v) in enumerate(rows):
        if q % 50 == 0:
            best = sorted(((-int(np.dot(v, c)), i) for m, (i, c) in enumerate(rows) if m != n))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


ASKED = "vec_id % 50 = 0"


@pytest.mark.parametrize("boxes", [3, 1024])
def test_ties_copies_and_many_shards(spark, boxes):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-3, 3, 4).tolist()) for i in range(400)] + [(i, [1, 1, 1, 1]) for i in range(400, 700)]
    df = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = kdtree.top_k(df, ASKED, 5, shard_rows=40, query_rows=3, boxes=boxes)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)


def test_bad_vectors_few_rows_large_values_and_extra_columns(spark):
    big = 1e13
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [float("nan"), 1.0]), (2, None), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (5, [big, -big]), (6, [big, -big]), (None, [1.0, 1.0]), (50, [0.0, 0.0]), (7, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int")
    got = kdtree.top_k(df, ASKED, 5).collect()
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (5, [big, -big]), (6, [big, -big]), (50, [0.0, 0.0])]]
    assert sorted(map(tuple, got)) == brute(kept, 5)
    assert kdtree.top_k(df.limit(0), ASKED).count() == 0


def test_coarse_shards_are_apart_and_hold_every_row():
    rng = np.random.default_rng(3)
    points = rng.normal(0, 50, (5000, 6)).round()
    split = kdtree.Split(points[:1000], 10)
    leaf = split.leaf(points)
    assert set(leaf) == set(range(16)) and np.bincount(leaf).max() < 600
    copies = kdtree.Split(np.ones((50, 3)), 8).leaf(np.ones((20, 3)))
    assert len(set(copies)) == 1 and (kdtree.Split(np.zeros((0, 2)), 4).leaf(points[:, :2]) < 4).all()


def test_tree_prunes_and_keeps_ties():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.1, (200, 3)) for c in (-50, 0, 50)]).round()
    ids = rng.permutation(600)
    tree = kdtree.Tree(ids, points, leaf=16)
    qs = rng.normal(0, 20, (20, 3)).round()
    for q, found in zip(qs, tree.search(np.full(20, -1), qs, 7, np.full(20, -np.inf)), strict=True):
        s = points @ q
        assert found == [(int(s[j]), -int(ids[j])) for j in np.lexsort((ids, -s))[:7]]
    assert all(len(r) <= 16 for r in tree.rows)

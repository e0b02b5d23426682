"""Stream order and contributing sums by tree contraction, against settling level by level."""

import random

from pyspark.sql import functions as F

from streamwatch.operators import graph


def by_level(edges, amounts):
    ids = set(amounts) | {x for e in edges for x in e}
    into = {i: [u for u, d in edges if d == i] for i in ids}
    sums, orders, left = {}, {}, set(ids)
    while ready := [i for i in left if all(u in sums for u in into[i])]:
        for i in ready:
            sums[i] = amounts.get(i, 0) + sum(sums[u] for u in into[i])
            above = [orders[u] for u in set(into[i])]
            orders[i] = max(above) + (above.count(max(above)) > 1) if above else 1
        left -= set(ready)
    return ids, sums, orders


def test_networks_with_bifurcations_repeated_edges_and_cycles(spark):
    rnd = random.Random(3)
    edges = [(i, rnd.randrange(max(1, i - 9), i)) for i in range(2, 150)] + [(i, rnd.randrange(1, i)) for i in range(50, 80)]
    edges += [edges[5], (500, 501), (501, 502), (502, 500), (502, 503), (503, 504), (7, 504), (600, 600)]
    amounts = {i: i % 7 for e in edges for i in e}
    topology = spark.createDataFrame([*edges, (3, None), (None, 3)], "upstream_id long, downstream_id long")
    nodes = spark.createDataFrame([*amounts.items(), (None, 1)], "entity_id long, a long")
    ids, sums, orders = by_level(edges, amounts)
    assert {r.entity_id: r.contributing for r in graph.contributing(topology, nodes, "a").collect()} == {i: sums.get(i) for i in ids}
    got = {r.entity_id: (r.strahler_order, r.cycle_broken) for r in graph.strahler(topology, nodes).collect()}
    assert got == {i: (orders.get(i, 1), i not in orders) for i in ids} and max(orders.values()) > 3


def test_a_chain_far_deeper_than_a_loop_over_levels_could_go(spark):
    n = 3000
    topology = spark.range(1, n).selectExpr("id as upstream_id", "id + 1 as downstream_id")
    out = graph.contributing(topology, spark.range(1, n + 1).selectExpr("id as entity_id", "1L as a"), "a")
    assert out.agg(F.count("*"), F.count_if(F.col("contributing") == F.col("entity_id"))).first()[:] == (n, n)


def test_no_network_and_no_nodes(spark):
    none, nodes = spark.createDataFrame([], "upstream_id long, downstream_id long"), spark.createDataFrame([(1, 2.0), (1, 3.0), (2, None)], "entity_id long, a double")
    assert {tuple(r) for r in graph.contributing(none, nodes, "a").collect()} == {(1, 5.0), (2, None)}
    assert {tuple(r) for r in graph.strahler(none, nodes).collect()} == {(1, 1, False), (2, 1, False)}
    assert graph.contributing(none, nodes.limit(0), "a").count() == 0 and graph.strahler(none, nodes.limit(0)).count() == 0

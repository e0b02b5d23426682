import random
from itertools import permutations

import duckdb
import pytest
from oracle import rows_of, same

from streamwatch.llm import filter_audit as fa
from streamwatch.llm.queries import ORACLES, QUERIES


def by_hand(rows, filters, marks=0):
    """rows: (part, failed filters as a set, marks, weight)."""
    out = []
    letters = [chr(65 + i) for i in range(filters)]
    for part in {r[0] or "" for r in rows}:
        mine = [r for r in rows if (r[0] or "") == part]
        shapley, told = dict.fromkeys(letters, 0), []
        for order in permutations(letters):
            alive = list(mine)
            for step, letter in enumerate(order, 1):
                gone = [r for r in alive if letter in r[1]]
                alive = [r for r in alive if letter not in r[1]]
                again = [r for r in mine if letter in r[1] and r not in gone and r not in alive and set(order[: step - 1]) & r[1]]
                lost = [sum(r[3] for r in gone if r[2][k]) for k in range(marks)]
                shapley[letter] += sum(r[3] for r in gone)
                told.append(("".join(order), step, sum(r[3] for r in alive), sum(r[3] for r in gone), sum(r[3] for r in again), sum(r[3] for r in mine if r[1] == {letter}), *lost))
        out += [(part, *t, shapley[t[0][t[1] - 1]]) for t in told]
    return sorted(out)


@pytest.mark.parametrize("filters", [1, 3, 5])
def test_interval_edges_give_each_order_its_removals(filters):
    orders = list(permutations(range(filters)))
    for mask in range(1 << filters):
        expected = set()
        for rank, order in enumerate(orders):
            failing = [s for s, f in enumerate(order, 1) if mask >> f & 1]
            expected |= {(rank, s, k == 0) for k, s in enumerate(failing)}
        got = [(rank, step, first) for step, first, begin, end in fa.intervals(mask, filters) for rank in range(begin, end)]
        assert len(got) == len(set(got)) and set(got) == expected


@pytest.mark.parametrize("filters", [1, 2, 5])
def test_audit_equals_applying_every_order(spark, filters):
    rng = random.Random(filters)
    rows = []
    for i in range(60):
        rows.append((rng.choice(["a", "b", "", None]), {chr(65 + k) for k in range(filters) if rng.random() < 0.35}, (rng.random() < 0.5, False), i + 1))
    names = [f"f{k}" for k in range(filters)]
    table = [(p, *[(chr(65 + k) in s) if k or i % 2 else (True if chr(65 + k) in s else None) for k in range(filters)], *m, w, "x", 1) for i, (p, s, m, w) in enumerate(rows)]
    schema = "p string, " + "".join(f"{c} boolean, " for c in names) + "bad boolean, good boolean, w long, part string, _mask int"
    got = fa.audit(spark.createDataFrame(table, schema), "p", names, ["bad", "good"], "w")
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "bad_lost", "good_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == by_hand(rows, filters, 2)


def test_too_many_filters_are_refused(spark):
    with pytest.raises(ValueError):
        fa.audit(spark.createDataFrame([("a", *[True] * 8)], ["p", *"abcdefgh"]), "p", list("abcdefgh"))


def test_query_equals_its_sql(spark, sf):
    same(QUERIES["op11_filter_audit"](spark, sf), sf, ORACLES["op11_filter_audit"])


def test_documents_of_every_kind(spark, odd):
    """Nulls, repeated rows and ids, null ids with copies, edges of the conditions, several label rows an id, other columns."""
    words = " ".join(f"w{i}" for i in range(200))
    more = [
        (20, words, "s"), (21, words, "s"), (20, words, "s"), (20, words, None), (None, words, "s"), (None, words, "s"), (19, words + " |", "s"),
        (22, " ".join([words] * 2), "s"), (23, " ".join([words] * 2) + " w1", "s"), (24, "ABé" + "x" * 97, "s"), (25, "ABÉC" + "x" * 96, "s"), (26, "a b\x1fc", "s"), (27, None, ""), (28, "", None),
    ]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"), allowMissingColumns=True).withColumn("_text", docs_column()).withColumn("n", docs_column())
    labels = spark.createDataFrame([(20, 1, 0, "x"), (20, 0, 1, "x"), (21, None, 1, "x"), (None, 1, 1, "x"), (99, 1, 1, "x"), (5, 1, None, "x")], "doc_id long, quality int, toxic int, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", labels.toPandas().astype({"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}))
    con.execute("create or replace temp table d2 as select cast(doc_id as bigint) doc_id, text, source from documents")
    con.unregister("documents")
    con.execute("create view documents as select * from d2")
    c = con.execute(ORACLES["op11_filter_audit"])
    names = [x[0] for x in c.description]
    got = fa.audit_documents(docs, labels)
    assert rows_of([tuple(r) for r in got.collect()], got.columns) == rows_of(c.fetchall(), names)


def docs_column():
    from pyspark.sql import functions as F

    return F.lit("other")


def test_empty_tables(spark, none, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit_documents(none, labels).count() == 0
    rows = fa.audit_documents(odd, labels).collect()
    assert len(rows) == 600 * 4 and all(r.good_lost == r.toxic_lost == 0 for r in rows)

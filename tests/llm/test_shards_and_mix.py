import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from streamwatch.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_shards(request, table):
    df = request.getfixturevalue(table)
    rows = sharding.shard_documents(df).collect()
    src = df.select("doc_id", "text").collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in src)
    counts = Counter(r.shard for r in rows)
    assert set(counts) <= set(range(16)) and max(counts.values()) - min([*counts.values()] + ([0] if len(counts) < 16 else [])) <= 1
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    n = Counter(r.source for r in rows)
    each = Counter((r.source, r.shard) for r in rows)
    assert all(abs(each[s, k] - n[s] / 16) < 2 for s in n for k in range(16))


def brute_shards(rows, shards=16):
    """(doc_id, source, size, crc) in the order of seeded MD5 within each source, then by fractional rank, cut evenly."""
    low = lambda v: (v is not None, v if v is not None else 0)
    by = defaultdict(list)
    for d, s, n, c in rows:
        h = hashlib.md5(f"shards-1:{'' if d is None else d}".encode()).hexdigest()
        by["n" if s is None else "s" + s].append((h, low(d), n, low(s) if s is None else (True, s), c, (d, s, n, c)))
    line = sorted(((k + 0.5) / len(g), name, r[:5], r[5]) for name, g in by.items() for k, r in enumerate(sorted(g, key=lambda r: r[:5])))
    out, used = [], Counter()
    for at, (*_, row) in enumerate(line):
        shard = at * shards // len(line)
        out.append((*row, shard, used[shard]))
        used[shard] += 1
    return Counter(out)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_shards_against_brute_force(request, table):
    df = request.getfixturevalue(table)
    rows = [(r.doc_id, r.source, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.select("doc_id", "source", "text").collect()]
    got = Counter((r.doc_id, r.source, r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.shard_documents(df).collect())
    assert got == brute_shards(rows)


def test_shards_agree_in_any_partitioning(docs, none):
    key = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(df).collect())
    assert key(docs) == key(docs.repartition(5)) and sharding.shard_documents(none).count() == 0


def expected_targets(sizes):
    order = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, free, level = 1.5 * sum(sizes.values()), set(sizes), 0.0
    while free:
        level = (budget - sum(2 * sizes[s] for s in sizes if s not in free)) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            break
        free -= over
    return {s: level * w[s] if s in free else 2 * sizes[s] for s in sizes}


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_mix(request, table):
    df = request.getfixturevalue(table)
    rows = mixing.mix_documents(df).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((r.doc_id, size(r.text)) for r in df.select("doc_id", "text").collect())
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    goal = expected_targets(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-5
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)
    again = mixing.mix_documents(df.repartition(7)).collect()
    assert Counter((r.doc_id, r.taken) for r in rows) == Counter((r.doc_id, r.taken) for r in again)


def test_heavier_documents_are_taken_more_often(spark):
    from pyspark.sql import functions as F

    rows = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("size"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.5).alias("weight"))
    got = mixing.mix(rows, share=0.3).groupBy("weight").agg(F.avg((F.col("taken") > 0).cast("double")).alias("p")).collect()
    p = {r.weight: r.p for r in got}
    # the least key t with half of the documents at each rate: 0.3 = 1 - (exp(-t) + exp(-t / 2)) / 2
    assert abs((p[1.0] + p[0.5]) / 2 - 0.3) < 0.001 and abs(p[1.0] - 0.39) < 0.03


def test_mixed_corpus_repeats_whole_documents(docs, odd, none):
    out = Counter(r.doc_id for r in mixing.mixed_corpus(docs).select("doc_id").collect())
    assert max(out.values()) == 2 and mixing.mixed_corpus(docs).columns == docs.columns
    odd_out = mixing.mixed_corpus(odd).collect()
    assert odd_out and all(r.text for r in odd_out) and mixing.mixed_corpus(none).count() == 0


def test_equal_rows_share_the_mix(spark):
    rows = [(1, "a b c", "s", 5.0)] * 30 + [(None, "d e f", "s", 5.0)] * 30 + [(k, "g h i", "t", 5.0) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size double")
    out = Counter((r.doc_id, r.source) for r in mixing.mixed_corpus(df).collect())
    mixed = Counter()
    for r in mixing.mix_documents(df).collect():
        mixed[r.doc_id, r.source] += r.taken // 3
    assert mixing.mixed_corpus(df).columns == df.columns and abs(sum(out.values()) - 1.5 * 260) <= 2
    assert all(abs(out[k] - mixed[k]) <= 1 for k in mixed) and max(out.values()) <= 60


def test_mix_equals_its_sql(spark, sf):
    from oracle import same

    from streamwatch.llm.queries import ORACLES, QUERIES

    same(QUERIES["op5_source_mix"](spark, sf), sf, ORACLES["op5_source_mix"])

from collections import Counter

import corpus_pipeline
from corpus_pipeline import STAGES, run

from streamwatch.llm import pii

from test_join import brute


def test_stages_keep_what_they_should(spark, sf, docs):
    at = docs
    seen = []
    for name, stage in STAGES[:-1]:
        new = stage(spark, at, sf)
        assert new.columns == docs.columns
        new = new.cache()
        seen.append((name, at, new))
        at = new
    by = {n: (a, b) for n, a, b in seen}
    a, b = by["toxicity"]
    assert 0 <= a.count() - b.count() < 0.3 * a.count()
    a, b = by["n-gram Jaccard join"]
    ids = [r.doc_id for r in b.collect()]
    assert len(ids) == len(set(ids)) and b.select("text").distinct().count() == b.count()
    assert {i: n for i, n in Counter((r.doc_id, t) for r in b.collect() for t in [r.text]).items() if n > 1} == {}
    linked = brute([(r.doc_id, r.text) for r in a.collect()])
    assert sorted(ids) == sorted({c for _, c, _ in linked})
    a, b = by["PII"]
    assert a.count() == b.count() and pii.scan_documents(b).filter("n_email + n_card + n_phone > 0").count() == 0
    last = STAGES[-1][1](spark, at, sf).toPandas()
    assert set(last["doc_id"]) == {r.doc_id for r in at.select("doc_id").collect()}
    whole = run(spark, sf).toPandas()
    order = ["doc_id", "start", "length", "ids_crc32"]
    assert last[order].sort_values(order).values.tolist() == whole[order].sort_values(order).values.tolist()
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_nothing(spark, sf, none):
    for name, stage in STAGES:
        assert stage(spark, none.select("doc_id", "text", "lang", "source", "n_chars"), sf).count() == 0, name


def test_stages_on_odd_rows(spark, sf, odd):
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    by = dict(STAGES)
    given = odd.select("doc_id", "text", "lang", "source", "n_chars")
    assert rows(by["toxicity"](spark, given, sf)) == rows(given)
    # 4 and the two rows of 5 are one class; rows without words and of a null id all stay
    kept = by["n-gram Jaccard join"](spark, given, sf)
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([1, 2, 3, 4, None, 6, 7, 8, 9], key=str)
    masked = by["PII"](spark, given, sf)
    assert sorted([r.doc_id for r in masked.collect()], key=str) == sorted([r.doc_id for r in given.collect()], key=str)
    assert {r.text for r in masked.collect() if r.doc_id == 8} == {"Mail me: [EMAIL] or [PHONE], card [CARD], ip [IP]."}
    mixed = by["mixing sources"](spark, given, sf).collect()
    assert all(r.text and r.text.split() for r in mixed) and {r.doc_id for r in mixed} <= {r.doc_id for r in given.collect()}
    packed = by["packing"](spark, given, sf)
    assert packed.filter("start = 0").count() == given.count()


def test_unlike_texts_of_one_id_and_clashing_names_stay(spark, sf):
    a, b = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(60))
    docs = spark.createDataFrame([(1, a, "s", 7.0), (1, b, "s", 7.0), (2, a, "s", 8.0)], "doc_id long, text string, source string, score double")
    by = dict(STAGES)
    assert sorted(map(tuple, by["toxicity"](spark, docs, sf).collect())) == sorted(map(tuple, docs.collect()))
    assert sorted(map(tuple, by["n-gram Jaccard join"](spark, docs, sf).collect())) == [(1, a, "s", 7.0), (1, b, "s", 7.0)]


INTERNAL = (
    "_id _row _doc _h _k _key _p _to _pii_text _pii_row _pii_k _pii_m_email _pii_p_email _toxicity _w _d _b _n _v _s id row a b k h key label score share size weight words text_ copies class_id "
    "class_set copy_id n_links epochs before target taken source_size bucket spans start length sequence_id offset"
).split()


def test_stages_with_columns_of_every_internal_name_and_one_id_of_many_rows(spark, sf):
    """Each row's other columns come through unchanged, and a hundred thousand rows of one id are one document."""
    from pyspark.sql import functions as F

    text = lambda seed: " ".join(f"{seed}{i % 37}" for i in range(60))
    few = spark.createDataFrame([(i, text(chr(97 + i)) + f" mail me{i}@b.example now") for i in range(8)], "doc_id long, text string")
    many = spark.range(100_000, numPartitions=4).select(F.lit(900).cast("long").alias("doc_id"), F.lit(text("z")).alias("text"))
    docs = few.unionByName(many).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *[F.lit(f"own {c}").alias(c) for c in INTERNAL])
    for name, stage in STAGES[:-1]:
        new = stage(spark, docs, sf)
        assert new.columns == docs.columns, name
        new = new.cache()
        assert {r.doc_id for r in new.select("doc_id").distinct().collect()} == {*range(8), 900}, name
        assert new.filter(" or ".join(f"`{c}` <> 'own {c}' or `{c}` is null" for c in INTERNAL)).count() == 0, name
        docs = new
    assert docs.filter("text like '%@%'").count() == 0
    assert {r.doc_id for r in STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().collect()} == {*range(8), 900}

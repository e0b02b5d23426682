import random
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from streamwatch.llm import toxicity

CLEAN = [a + b for a in ("ban", "kel", "mor", "tis", "vun", "dol", "par") for b in ("ta", "lo", "rim", "sek", "nu", "ge")]
BAD = ["zgrakk", "xorfud", "qwimpel", "jyxxer"]


def corpus(n, rng, bad=BAD):
    out = []
    for i in range(n):
        w = [rng.choice(CLEAN) for _ in range(rng.randint(20, 200))]
        if i % 4 == 0:
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        out.append((i, " ".join(w), int(i % 4 == 0)))
    return out


def frames(spark, rows):
    d = spark.createDataFrame([(i, t, "en", "s", 0, 0.5) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")
    return d, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_unseen_misspellings(spark):
    rows = corpus(800, random.Random(1))
    docs, labels = frames(spark, rows)
    out = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    for i, _, y in rows:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= out[i].score <= 1 and out[i].predicted == int(out[i].score >= 0.5)
    held = [(y, out[i].predicted) for i, _, y in rows if out[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    model = toxicity.fit(docs, labels)
    spelled = model.scores([" ".join([*CLEAN[:10], w, *CLEAN[10:20]]) for w in ("zgrakkk", "xorfudd", "qwimpell")] + [" ".join(CLEAN[:20])], {})
    assert (spelled[:3] > 0.5).all() and spelled[3] < 0.5


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = frames(spark, corpus(200, random.Random(2)))
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    a, b = ({r.doc_id: r.score for r in toxicity.score_documents(docs, l).collect()} for l in (labels, other))
    assert a == b


def test_odd_rows_and_missing_labels(spark, odd, none):
    docs, labels = frames(spark, corpus(100, random.Random(3)))
    out = toxicity.scored(odd.select("doc_id", "text"), toxicity.fit(docs, labels)).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score_documents(none, labels).count() == 0
    assert {r.score for r in toxicity.score_documents(odd, labels.limit(0)).collect()} == {0.0}


def test_benchmarked_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    r = toxicity.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")).alias("right"), F.count_if((F.col("predicted") == 1) & (F.col("toxic") == 1)).alias("hits"), F.sum("predicted").alias("flagged")).first()
    assert r.right > 0.98 and r.hits > 0.93 * r.flagged


def test_sample_holds_long_texts_and_many_clean_ones(spark):
    rows = [(i, "word " * (6000 if i % 10 == 0 else 3), int(i % 2 == 0)) for i in range(6000)]
    docs, labels = frames(spark, rows)
    got, _ = toxicity.sample(docs.filter("doc_id % 10 = 0 or doc_id % 2 = 1"), labels)
    free = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % toxicity.FOLDS and (i % 10 == 0 or i % 2 == 1)]
    assert set(got["doc_id"]) == {i for i, _ in free}


def test_held_out_toxic_documents_are_caught_in_query_and_stage(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    bad = labels.filter((F.col("toxic") == 1) & (toxicity.fold(F.col("doc_id")) == 0)).select("doc_id")
    held = docs.join(bad, "doc_id")
    caught = toxicity.score_documents(docs, labels).join(bad, "doc_id").agg(F.avg("predicted")).first()[0]
    left = corpus_pipeline.drop_toxic(spark, docs, d).join(bad, "doc_id").count() / held.count()
    assert caught >= 0.9 and abs(caught - (1 - left)) < 1e-9


def test_scores_against_brute_force():
    rng = random.Random(5)
    rows = corpus(240, rng)
    model = toxicity.train([t for _, t, _ in rows], np.array([y for *_, y in rows]), toxicity.Settings(steps=60))
    s = model.settings

    def brute(text):
        values, before = [], None
        for word in toxicity.WORD.findall(text.lower()):
            marked = f"<{word}>"
            pieces = [marked] + [marked[i : i + k] for k in range(s.low, s.high + 1) for i in range(len(marked) - k + 1)]
            value = sum(float(model.difference[zlib.crc32(p.encode()) % s.buckets]) for p in pieces) / len(pieces)
            assert abs(value - known[word]) < 1e-6 * max(1, abs(value))
            value = known[word]  # so that a word at a limit lies on the same side of it
            if value != before:
                values.append(value)
            before = value
        n = max(len(values), s.window)
        values = values or [0.0]
        top = lambda k: max(sum(values[i : i + k]) for i in range(max(1, len(values) - k + 1))) / k
        best = sorted(set(values), reverse=True)
        best += [min(best[-1], 0.0)] * 5
        x = [top(s.window), top(toxicity.WIDE), sum(values) / n, best[1], best[2], best[4]]
        for limit in model.limits:
            k = sum(v > limit for v in values)
            x += [np.log1p(k), np.log((k + 0.5) / (n + 50))]
        x = (np.array([*x, np.log(n)]) - model.mean) / model.spread
        return 1 / (1 + np.exp(-(x @ model.weights[:-1] + model.weights[-1])))

    own = ["", "one", "Zgrakk zgrakk", "é ü ñ straße", *[t for _, t, _ in rows[:40]], "word " * 200_000, " ".join(t for _, t, _ in rows)]
    known = {}
    got = model.scores(own, known)
    assert np.abs(got - [brute(t) for t in own]).max() < 1e-6
    assert (model.scores(own, {}) == got).all() and (model.scores(own * 2, known)[len(own) :] == got).all()


def test_the_driver_gives_back_what_the_fit_took(monkeypatch):
    done = []
    monkeypatch.setattr(toxicity, "sample", lambda *_: (pd.DataFrame({"doc_id": [1, 2], "text": ["a", "b"], "label": [0, 1]}), 0.5))
    monkeypatch.setattr(toxicity, "train", lambda *_: done.append("train") or "model")
    monkeypatch.setattr(toxicity, "give_back", lambda: done.append("give back"), raising=False)
    assert toxicity.fit(None, None) == "model" and done == ["train", "give back"]

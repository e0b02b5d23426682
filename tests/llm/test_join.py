import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from streamwatch.llm import chosen_path


def grams(text, k=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, least=0.8):
    sets = [grams(t) for _, t in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    links, parent = Counter(), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in where[g] if j > i)
        for j, n in shared.items():
            if rows[i][0] is not None and rows[j][0] is not None and n >= least * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    group = defaultdict(list)
    for i in range(len(rows)):
        group[root(i)].append(rows[i][0])
    return Counter((rows[i][0], min([x for x in group[root(i)] if x is not None], default=None), links[i]) for i in range(len(rows)))


def joined(df, **kw):
    return Counter((r.doc_id, r.class_id, r.n_links) for r in chosen_path.join_documents(df, **kw).collect())


def test_documents_against_brute_force(docs, texts):
    assert joined(docs) == brute(list(texts.items()))


def test_odd_rows(odd, none):
    assert joined(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert chosen_path.join_documents(none).count() == 0


def variants(rng, n, words, changes):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("kw", [{}, {"bucket": 8, "block": 16}])
def test_large_groups_chains_and_common_passages(spark, kw):
    rng = random.Random(4)
    texts = variants(rng, 120, 90, 3) + variants(rng, 40, 60, 4) + ["same text for many of the rows here"] * 50
    common = " ".join(f"c{i}" for i in range(60))
    texts += [f"{common} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(80)) for _ in range(80)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert joined(spark.createDataFrame(rows, "doc_id long, text string"), **kw) == brute(rows)


def test_one_id_with_two_texts(spark):
    a, b = " ".join(map(str, range(60))), " ".join(map(str, range(100, 160)))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (3, b + " y")]
    got = {(r.doc_id, r.n_links) for r in chosen_path.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (3, 2)}


def test_shingles_are_those_of_the_definition():
    texts = ["a b c d e f", "", None, "a b", "  A\tB\nc d e  ", "é ü ñ x y z é"]
    h, start = chosen_path.shingles(pa.array(texts))
    assert np.diff(start).tolist() == [2, 0, 0, 1, 1, 3] and len(set(h[[0, 3]].tolist())) == 1


def test_recall_of_a_run_is_as_planned():
    assert 0.3 < chosen_path.chance(4) < 0.32 and 1 - (1 - chosen_path.chance(4)) ** chosen_path.runs_for(0.9999, 4) >= 0.9999


@pytest.mark.parametrize("chunk", [1, 2, 7, 64])
def test_chunks_change_no_gram(texts, chunk):
    rng = random.Random(6)
    own = ["", None, "one", "x" * 300, "\xa0a\xa0b c\u3000d e f", " lead and trail \n", *list(texts.values())[:8]]
    own += [" ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    whole, parts = chosen_path.shingles(pa.array(own)), chosen_path.shingles(pa.array(own), chunk=chunk)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    alone = [chosen_path.shingles(pa.array([t], pa.string()), chunk=chunk)[0].tolist() for t in own]
    assert [x for a in alone for x in a] == whole[0].tolist()


def test_recall_of_planted_pairs_near_the_threshold(spark):
    """Of 1,500 pairs of similarity 0.80 to 0.85, how many the runs alone bring together, before the exact check."""
    rng = random.Random(8)
    rows, planted = [], []
    while len(planted) < 1500:
        w = [f"w{rng.randrange(10**7)}" for _ in range(rng.randint(80, 200))]
        v = list(w)
        for at in rng.sample(range(len(w)), max(1, len(w) // rng.randint(45, 55))):
            v[at] = f"v{rng.randrange(10**7)}"
        a, b = grams(" ".join(w)), grams(" ".join(v))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            planted.append((2 * len(planted), 2 * len(planted) + 1))
            rows += [(planted[-1][0], " ".join(w)), (planted[-1][1], " ".join(v))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = chosen_path.signature_rows(docs).withColumnRenamed("a", "id").drop("b", "row")
    ids = {r.doc_id: r.id for r in sets.select("doc_id", "id").collect()}
    met = {frozenset((r.a, r.b)) for r in chosen_path.candidates(sets.drop("doc_id")).collect()}
    found = sum(frozenset((ids[a], ids[b])) in met for a, b in planted) / len(planted)
    assert found >= 0.998, found
    got = {r.doc_id: r.class_id for r in chosen_path.join_documents(docs).collect()}
    assert sum(got[a] == got[b] for a, b in planted) / len(planted) >= 0.998


def test_one_row_of_each_class_stays(spark):
    a, b = " ".join(map(str, range(60))), " ".join(map(str, range(100, 160)))
    rows = [(1, a, "s", 7.0), (1, b, "s", 7.0), (2, a + " x", "s", 1.0), (3, b, "t", 2.0), (1, a, "s", 7.0), (1, a, "t", 7.0), (4, " ", "s", 3.0), (4, " ", "s", 3.0), (None, a, "s", 4.0), (5, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    got = sorted(map(tuple, chosen_path.one_of_each(docs).collect()), key=str)
    assert [r for r in got if r[1] == b] == [(1, b, "s", 7.0)] and len([r for r in got if r[0] == 1 and r[1] == a]) == 1
    assert len(got) == 6 and (None, a, "s", 4.0) in got and (5, None, None, None) in got and got.count((4, " ", "s", 3.0)) == 2

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest

from streamwatch.llm import periodic_runs as pr
from streamwatch.llm.queries import QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(words):
    """(start, length, period) of every run, from all places that equal those a period later."""
    out = {}
    numbers = np.unique(np.array(words, dtype=object if words and isinstance(words[0], str) else None), return_inverse=True)[1] if words else np.zeros(0, dtype=int)
    for q in range(1, len(words) // 4 + 1):
        edge = np.diff(np.concatenate([[0], (numbers[:-q] == numbers[q:]).astype(int), [0]]))
        for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def slow_row(doc_id, text):
    words = WORDS.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = slow_runs(words)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_the_cover_has_every_difference():
    assert {(a - b) % pr.SPAN for a in pr.COVER for b in pr.COVER} == set(range(pr.SPAN))


@pytest.mark.parametrize("letters", [1, 2, 3, 50])
def test_common_extensions_equal_comparing_words(letters):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 30, 31, 32, 300, 700):
        words = rng.integers(0, letters, n)
        words[n // 2 :] = words[: n - n // 2]  # long repeats
        held = pr.Extensions(words)
        a, b = rng.integers(0, n, 400), rng.integers(0, n, 400)
        a, b = a[a != b], b[a != b]
        if not len(a):
            continue
        for x, y, got in zip(a.tolist(), b.tolist(), held.common(a, b).tolist(), strict=True):
            k = 0
            while max(x, y) + k < n and words[x + k] == words[y + k]:
                k += 1
            assert got == k


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        words = []
        while len(words) < rng.choice([0, 3, 6, 20, 90, 200]):
            unit = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(1, 9))]
            words += (unit * rng.randrange(1, 9))[: rng.randrange(1, 50)]
        texts.append(words)
    text, start, length, period = pr.runs([np.array(t, dtype=np.int64) for t in texts])
    for i, words in enumerate(texts):
        of = text == i
        assert list(zip(start[of].tolist(), length[of].tolist(), period[of].tolist(), strict=True)) == slow_runs(words)


def test_two_runs_of_one_period_side_by_side():
    """The place that breaks the period lies between two multiples of it: both runs are found."""
    unit = list(range(100, 110))
    words = (unit * 5)[:44] + [7] + (unit[4:] + unit[:4]) * 5
    assert len(slow_runs(words)) == 2
    _, start, length, period = pr.runs([np.array(words)])
    assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == slow_runs(words)


def test_a_very_long_text():
    words = np.concatenate([np.tile(np.arange(7), 30_000), np.zeros(200_000, dtype=np.int64), np.arange(50_000)])
    _, start, length, period = pr.runs([words])
    assert (0, 210_001, 7) in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)
    assert (210_000, 200_001, 1) in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)


def test_query_equals_brute_force(spark, sf, texts):
    got = QUERIES["op13_periodic_runs"](spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes[1:6]] == ["bigint"] * 5
    assert rows(got) == sorted((slow_row(i, t) for i, t in texts.items()), key=str)


def test_texts_of_every_kind(spark, odd):
    more = [(i, " ".join(random.Random(i).choices("ab", k=i % 60)), None) for i in range(100, 300)] + [(None, "x y " * 9, None), (None, None, None), (400, "é\x1fé \x85 é" * 9 + "  a\x0ba\x0ca\ta\ra\na", None)]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"), allowMissingColumns=True)
    assert rows(pr.digest_documents(docs)) == sorted((slow_row(r.doc_id, r.text) for r in docs.collect()), key=str)


def test_runs_as_arrays(spark, odd, none):
    docs = spark.createDataFrame([(1, "x a b a b a b a b y"), (2, None), (3, "q " * 6)], "doc_id long, text string")
    assert rows(pr.document_runs(docs)) == [(1, [1], [8], [2], "x a b y"), (2, [], [], [], ""), (3, [0], [6], [1], "q")]
    assert pr.digest_documents(none).count() == 0 and pr.document_runs(none).count() == 0

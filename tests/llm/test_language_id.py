import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from streamwatch.llm import language_id as li
from streamwatch.llm.queries import QUERIES

ORDERS = (1, 2, 3, 4)


def slow_grams(text, orders=ORDERS):
    """All n-grams of a text's words as strings; | marks a word's ends."""
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            marked = f"|{word}|"
            out += [marked[i : i + k] for k in orders for i in range(len(marked) - k + 1) if marked[i : i + k].strip("|")]
            word = ""
    return out


HARD = ["", "a", "ß1é_x", "The cat, the CAT!", "\n\nab\n", "İstanbul ÉTÉ ²x½ \U0001f600 日本語テキスト", "  two  spaces ", "x" * 50, "don't"]


@pytest.mark.parametrize("orders", [ORDERS, (3,), (2, 5)])
def test_hashes_stand_for_the_grams_of_words(orders):
    """Equal n-grams have equal hashes and unlike ones have unlike ones, each text having its own."""
    names = {}
    got = [Counter() for _ in HARD]
    for parts, of in li.pieces(HARD):
        for order, hashes, part in li.gram_hashes(parts, orders):
            for h, p in zip(hashes.tolist(), part.tolist(), strict=True):
                got[of[p]][order, h] += 1
    for text, found in zip(HARD, got, strict=True):
        grams = Counter(slow_grams(text, orders))
        assert sorted(grams.values()) == sorted(found.values())
        for k in orders:
            assert sum(n for (order, _), n in found.items() if order == k) == sum(n for g, n in grams.items() if len(g) == k)
    for text in HARD:  # one by one, so that each hash has a name
        for parts, _ in li.pieces([text]):
            made = [(h, order) for order, hashes, _ in li.gram_hashes(parts, orders) for h in hashes.tolist()]
            expected = [g for k in orders for g in in_order(text, k)]
            assert len(made) == len(expected)
            for (h, _), g in zip(made, expected, strict=True):
                assert names.setdefault(h, g) == g
    assert len(set(names.values())) == len(names)


def in_order(text, k):
    spaced = "|".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    spaced = f"|{spaced}|" if spaced else ""
    return [spaced[i : i + k] for i in range(len(spaced) - k + 1) if "|" not in spaced[i + 1 : i + k - 1] and spaced[i : i + k].strip("|")]


def test_long_texts_are_parted_between_words():
    text = " ".join(random.Random(1).choices(["the", "cat", "sat", "über", "été"], k=60_000))
    parts = [p for ps, _ in li.pieces([text]) for p in ps]
    assert len(parts) > 3 and "".join(parts) == text.lower()
    whole = Counter(slow_grams(text))
    assert sum(whole.values()) == sum(len(h) for p in parts for _, h, _ in li.gram_hashes([p], ORDERS))
    assert "".join(p for ps, _ in li.pieces(["x" * 200_000]) for p in ps) == "x" * 200_000


def test_counts_equal_counting_words(spark):
    texts = [("a", "the cat sat"), ("a", "the hat"), ("b", "le chat, le CHAT"), ("b", None), ("b", "")]
    got = li.gram_counts(spark.createDataFrame(texts, "lang string, text string"), ORDERS).collect()
    for lang in "ab":
        expected = Counter(g for n, t in texts if n == lang for g in slow_grams(t or ""))
        assert sorted((r.n, r.total) for r in got if r.lang == lang) == sorted((len(g), n) for g, n in expected.items())


def held(i):
    return crc32(str(i).encode()) % 4 == 2


def corpus(spark, languages, rows=400, words=12, seed=3):
    rng = random.Random(seed)
    vocabulary = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéüñ", k=rng.randrange(2, 7))) for _ in range(60)] for _ in range(languages)]
    data = [(i, f"l{i % languages}", " ".join(rng.choices(vocabulary[i % languages], k=words))) for i in range(rows)]
    return spark.createDataFrame(data, "doc_id long, lang string, text string"), {i: lang for i, lang, _ in data}


def test_filters_claim_what_languages_hold_and_little_else(spark):
    """Against exact sets: no n-gram of a language is missed, and false claims are as few as the correction says."""
    docs, _ = corpus(spark, 3)
    s = li.Settings(least=1e-3, slots=1 << 12, hashes=2)
    model = li.fit(docs, s)
    rows = docs.collect()
    sets = {}
    for k, lang in enumerate(model.languages):
        counts = Counter(g for r in rows if r.lang == lang and not held(r.doc_id) for g in slow_grams(r.text))
        sets[k] = counts, {n: sum(c for g, c in counts.items() if len(g) == n) for n in ORDERS}
    share = lambda k, g: sets[k][0][g] / sets[k][1][len(g)]
    holds = [{g for g in sets[k][0] if share(k, g) >= s.least and share(k, g) * s.contrast >= max(share(j, g) for j in sets if share(j, g) >= s.least)} for k in sets]
    texts = [r.text for r in rows if held(r.doc_id)]
    counts, grams = li.claims(model, texts)
    true = np.array([[sum(g in holds[k] for g in slow_grams(t)) for k in sets] for t in texts])
    assert (counts >= true).all() and grams.tolist() == [len(slow_grams(t)) for t in texts]
    false = (counts - true).sum(axis=0) / (grams[:, None] - true).sum(axis=0)
    assert (model.false > 0.005).all() and (abs(false - model.false) < 0.5 * model.false + 0.02).all()


def test_more_languages_than_one_word_has_bits(spark):
    docs, langs = corpus(spark, 70, rows=2100)
    model = li.fit(docs)
    assert model.table.shape[1] == 2 and len(model.languages) == 70
    out = li.identify_documents(docs).collect()
    own = [langs[r.doc_id] == r.lang_pred for r in out if r.held_out]
    assert len(own) > 400 and sum(own) / len(own) > 0.95
    with pytest.raises(ValueError):
        li.fit(docs, li.Settings(most_languages=69))


@pytest.mark.parametrize("where", ["sf0.01", "sf0.1"])
def test_held_out_accuracy(spark, where):
    docs = spark.read.parquet(f"/root/testdata/{where}/documents.parquet")
    got = QUERIES["op12_language_filters"](spark, f"/root/testdata/{where}")
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows) and {r.held_out for r in rows if held(r.doc_id)} == {True}
    own = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(own) / len(own) >= 0.995


def test_nothing_of_the_held_out_rows_is_learnt(spark):
    docs, langs = corpus(spark, 3)
    swapped = spark.createDataFrame([(r.doc_id, "other" if held(r.doc_id) else r.lang, r.text) for r in docs.collect()], docs.schema)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(li.identify_documents(docs)) == key(li.identify_documents(swapped))


def test_texts_of_every_kind(spark, odd, none):
    out = li.identify_documents(odd).collect()
    assert len(out) == odd.count()
    for r in out:
        assert r.lang_pred in ("en", "de", "fr", "und") and 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in out}
    assert by_id[1].lang_pred == by_id[2].lang_pred == by_id[7].lang_pred == "und" and by_id[1].score == 0.0
    assert by_id[3].lang_pred != "und" and by_id[None].held_out is False
    assert li.identify_documents(none).count() == 0
    unlabelled = odd.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in li.identify_documents(unlabelled).collect()} == {"und"}

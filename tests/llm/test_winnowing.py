import hashlib
import random

import numpy as np
import pytest

from streamwatch.llm import winnowing


def brute(text, gram, window):
    kept = [(i, c.lower() if c.isascii() else c) for i, c in enumerate(text) if not c.isspace() and not "\x1c" <= c <= "\x1f"]
    if not kept:
        return []
    gram = min(gram, len(kept))
    codes = np.array([ord(c) for _, c in kept], dtype=np.uint32)
    h = [int(winnowing.gram_hashes(codes[i : i + gram], gram)[0]) for i in range(len(kept) - gram + 1)]
    window = min(window, len(h))
    chosen = {max(range(s, s + window), key=lambda j: (-h[j], j)) for s in range(len(h) - window + 1)}
    return [(h[j], kept[j][0]) for j in sorted(chosen)]


@pytest.mark.parametrize("gram, window", [(5, 4), (3, 8), (24, 60)])
def test_against_brute_force(texts, gram, window):
    rng = random.Random(1)
    own = ["", " ", "a", "ab " * 40, " é" * 30, "aaaa" * 50] + ["".join(rng.choice("ab C\n") for _ in range(rng.randint(0, 90))) for _ in range(150)] + [t[:600] for t in list(texts.values())[:10]]
    for t in own:
        assert list(zip(*(x.tolist() for x in winnowing.winnow(t, gram, window)), strict=True)) == brute(t, gram, window)


def test_blocks_of_a_long_text_meet(monkeypatch):
    text = "".join(random.Random(2).choice("abcdefgh") for _ in range(5000))
    whole = winnowing.winnow(text, 6, 10)
    monkeypatch.setattr(winnowing, "BLOCK", 97)
    parts = winnowing.winnow(text, 6, 10)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_shared_passages_leave_a_common_hash():
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdefghij klm") for _ in range(n))
    for _ in range(50):
        passage = "".join(rng.choice("abcdefghijklm") for _ in range(winnowing.GRAM + winnowing.WINDOW - 1))
        a, b = (set(winnowing.winnow(make(200) + passage + make(150))[0].tolist()) for _ in range(2))
        assert a & b


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_query(request, table):
    df = request.getfixturevalue(table)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect()))
    got = sorted(winnowing.fingerprint_documents(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert len(got) == len(rows)
    for i, (g, (_, _, t)) in enumerate(zip(got, rows, strict=True)):
        following = rows[(i + 1) % len(rows)][2]
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        assert g.n_chars == len(t) and g.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert g.fingerprint == winnowing.written(*winnowing.winnow(t)) and g.edited_fingerprint == winnowing.written(*winnowing.winnow(new))
        a, b = (set(winnowing.winnow(x)[0].tolist()) for x in (t, following))
        assert g.near_next == (len(a & b) / len(a | b) if a | b else 1.0)


def test_of_nothing(none):
    assert winnowing.fingerprint_documents(none).count() == 0

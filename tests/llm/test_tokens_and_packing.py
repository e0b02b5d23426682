import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer

from streamwatch.llm import packing, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", " ", "  ", "a  b", " lead", "trail ", "new\nline \n x", "tab\t y", "é nbsp 　wide", "<s> </s> <unk> <|endoftext|> x<|endoftext|>", "don't we'll", "\U0001f600 emoji ​ zero", "x" * 5000, "a " * 5000, "\r\n\r\n", "  sep", "▁ mark ▁▁"]
MARKS = ["▁", " ", "  ", "a", "1", "ﷺ", "é", "\u3000", "\u200b", "\U0001f600", "x▁", "▁▁", "<s>", "\ufeff", "\u0301", "ﬁ", "\t", "\n", "\xa0", "word", "\x1c", "\xad", "<|endoftext|>", "'s", "\r\n"]


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_counts(request, table):
    df = request.getfixturevalue(table)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = Counter(map(tuple, token_counts.token_counts(df, PIECES).collect()))
    rows = df.select("doc_id", "text").collect()
    n = [len(x) for x in sp.encode([r.text or "" for r in rows])]
    assert got == Counter((r.doc_id, len((r.text or "").encode()), k, k > 4096) for r, k in zip(rows, n, strict=True))


def test_counts_of_hard_texts(none):
    rng = random.Random(2)
    texts = HARD + ["".join(rng.choice(HARD) for _ in range(4)) for _ in range(300)]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts += ["".join(rng.choice(MARKS) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    texts += [f"{a}{chr(c)}{b}" for c in [*range(0x3400), *range(0xFB00, 0x10000)] for a, b in (("a", " b"), ("a ", "b"))]
    for chars in (1, token_counts.PART_CHARS):
        counter = token_counts.PieceCounter(PIECES, chars)
        assert counter.splits and counter.counts(texts) == [len(x) for x in sp.encode(texts)]
    assert len(token_counts.long_parts("ab cd  ef▁ gh ij", 1)) == 3 and token_counts.long_parts("x" * 100, 5) == ["x" * 100]
    assert token_counts.token_counts(none, PIECES).count() == 0


def test_parts_give_the_ids_of_whole_texts(texts):
    rng = random.Random(3)
    whole, parts = Tokenizer.from_file(BYTES), token_counts.ByteEncoder(BYTES)
    own = HARD + ["".join(rng.choice(HARD) for _ in range(4)) for _ in range(300)] + list(texts.values())
    own += ["".join(chr(rng.randrange(b, b + 64)) for _ in range(200)) for b in range(0, 0x3000, 64)]
    own += ["".join(rng.choice(MARKS) for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    for t, got, e in zip(own, parts.batch(own), whole.encode_batch(own, add_special_tokens=False), strict=True):
        assert got == np.array(e.ids, dtype="<u4").tobytes(), t


def test_very_long_runs_of_white_space():
    whole, parts = Tokenizer.from_file(BYTES), token_counts.ByteEncoder(BYTES)
    long = [a + c * 10_001 + z for c in (" ", "\n", " \n", "\u3000", "\xa0", "\r\n") for a in ("", "a", "<|endoftext|>") for z in ("", "b", "!", "\x1c", "<|endoftext|>", "\ufeff b")]
    for t in [*long, "a" + " " * 2_000_000 + "b", "\n" * 2_000_000, "x" + "\n" * 20_000 + "y" + " " * 20_000 + " z "]:
        assert parts.ids(t) == np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_pack(request, table):
    df = request.getfixturevalue(table)
    json_form = Tokenizer.from_file(BYTES)
    pieces = packing.pack(df, BYTES).toPandas().sort_values(["sequence_id", "offset"])
    ends = pieces.groupby("sequence_id")["length"].cumsum()
    assert (pieces["offset"] == ends - pieces["length"]).all() and ends.max() <= 1024
    expected = Counter()
    for r in df.select("doc_id", "text").collect():
        ids = np.array([*json_form.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for at in range(0, len(ids), 1024):
            part = ids[at : at + 1024]
            expected[(r.doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    got = Counter((None if np.isnan(d) else int(d), *rest) for d, *rest in pieces[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False, name=None))
    assert got == expected
    if table == "docs":
        assert 1 - pieces["length"].sum() / (1024 * pieces["sequence_id"].nunique()) < 0.03


def test_pack_of_nothing(none):
    assert packing.pack(none, BYTES).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_patterns_cover_all_pieces(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(rng.integers(1, 65, 5000), minlength=65)
    patterns = packing.solve(counts, 64)
    assert (sum(f * n for f, n in patterns) == counts).all() and all((f * np.arange(65)).sum() <= 64 for f, _ in patterns)
    assert sum(n for _, n in patterns) <= 1.02 * (counts * np.arange(65)).sum() / 64 + 2


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(0)
    prices = np.concatenate([[0], rng.random(12)])
    best = [0.0] * 13
    for c in range(1, 13):
        best[c] = max([best[c - 1]] + [best[c - l] + prices[l] for l in range(1, c + 1)])
    value, used = packing.knapsack(prices, 12)
    assert abs(value - best[12]) < 1e-12 and abs((used * prices).sum() - value) < 1e-12 and (used * np.arange(13)).sum() <= 12


def test_words_of_letters_have_the_ids_of_the_library(monkeypatch):
    """op7: such words go to the library's model as pieces, and forgetting others changes no id."""
    import random

    import numpy as np

    from streamwatch.llm import token_counts
    from streamwatch.llm.queries import PACK_MODEL, tokenizer_path

    encoder = token_counts.ByteEncoder(tokenizer_path(PACK_MODEL))
    chars = [c for c in map(chr, range(0x250)) if token_counts.LETTERS.fullmatch(c)]
    assert encoder.direct and all(c.isalpha() for c in chars) and {"z", "É", "ÿ", "ɏ"} <= set(chars) and not {"ª", "×", "÷", "_"} & set(chars)
    rng = random.Random(5)
    words = [*chars, "don't", "a1", "x,", "ªa", "a×b", "ʼn", "ɐa", "中文", *("".join(rng.choices(chars, k=rng.randint(2, 9))) for _ in range(600))]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 80))).replace(" a", "\na") for _ in range(300)]
    monkeypatch.setattr(token_counts, "REMEMBERED", 500)
    expected = [np.array(e.ids, dtype="<u4").tobytes() for e in encoder.model.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x for i in range(0, 300, 20) for x in encoder.batch(texts[i : i + 20])] == expected and encoder.before


def test_words_with_marks_skip_the_library_split(monkeypatch):
    """op7: only words that may fall apart otherwise take the library's own split, each once while it is remembered."""
    encoder = token_counts.ByteEncoder(BYTES)
    taken: list[str] = []
    lines = encoder._lines
    monkeypatch.setattr(encoder, "_lines", lambda words: taken.extend(words) or lines(words))
    rng = random.Random(7)
    chars = "abcÉñßz0189.,;:!?$%&*#@_-+/\\|~^`\"()[]{}=>"
    words = ["".join(rng.choices(chars, k=rng.randint(1, 12))) for _ in range(3000)]
    odd = ["don't", "it's.", "'s", "<|endoftext|>", "a<|endoftext|>b", "e<b", "x\0y", "a\x01", "Ā", "ā", "Ġ", "Ċ", "中文", "é", "a\tb", "½", "٣", "​"]
    plain = [" ".join(rng.choices(words, k=rng.randint(1, 60))).replace(" a", "\na") for _ in range(400)]
    expected = [np.array(e.ids, dtype="<u4").tobytes() for e in encoder.model.encode_batch_fast(plain, add_special_tokens=False)]
    assert encoder.batch(plain) == expected and not taken
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    mixed = [" ".join(rng.choices(words + odd * 50, k=rng.randint(1, 60))).replace(" a", "\na").replace(" '", "\n'") for _ in range(400)] + ["", " a", "a  b"]
    expected = [np.array(e.ids, dtype="<u4").tobytes() for e in encoder.model.encode_batch_fast(mixed, add_special_tokens=False)]
    assert [x for i in range(0, len(mixed), 31) for x in encoder.batch(mixed[i : i + 31])] == expected
    assert {" don't", " 中文", " e<b"} <= set(taken) and len(encoder.before) <= 50
    assert encoder.batch([]) == [] and encoder.batch([""]) == [b""]


class Caught:
    """Documents that hand back the function of a task."""

    schema = StructType([StructField("doc_id", LongType())])

    def select(self, *columns):
        return self

    def mapInArrow(self, task, schema):
        return task


def test_a_task_gives_back_its_memory():
    own = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
    task, rng = packing.tokenised(Caught(), BYTES), random.Random(5)

    def batches(n, rows):
        for _ in range(n):
            texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(1000)) for _ in range(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(range(rows)), pa.array(texts)], ["doc_id", "text"])

    assert sum(len(b) for b in task(batches(1, 1))) == 1
    before = own()
    assert sum(len(b) for b in task(batches(3, 600))) == 1800
    assert own() - before < 60


def test_texts_with_white_space_go_to_the_library_in_bounded_calls(monkeypatch):
    encoder, calls, given = token_counts.ByteEncoder(BYTES), [], token_counts.ByteEncoder._encode
    monkeypatch.setattr(token_counts, "CALL", 50)
    monkeypatch.setattr(token_counts.ByteEncoder, "_encode", lambda self, parts: calls.append(len(parts)) or given(self, parts))
    texts = ["two  spaces" + " and a word" * 100, " ", "\n\n" + "x y " * 60]
    expected = [np.array(e.ids, dtype="<u4").tobytes() for e in encoder.model.encode_batch_fast(texts, add_special_tokens=False)]
    assert encoder.batch(texts) == expected
    assert len(calls) > 3 and max(calls) <= 50

"""Language identification by language-bitmask filters of n-grams.

Learning counts the n-grams of letters of all labelled texts, language by language, as Spark groups of 64-bit hashes. A
language holds the n-grams that make up a least share of its own, and are not far more usual in another language. They go
into one bit-sliced Bloom filter: a slot is a bitmask with a bit a language, and an n-gram sets its languages' bits in
HASHES slots. The AND of an n-gram's slots gives all languages that hold it at once. A text's count a language (a
popcount of its bit over the text's n-grams) is corrected for the filter's false positives, of which a language has as
many as its share of set bits tells; the language of the highest corrected count is the text's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import balanced, cut

UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2
#: Bytes of text whose n-grams are hashed, or counted, at once.
SLICE_BYTES, COUNT_BYTES = 1 << 20, 8 << 20
#: Characters of a text that are hashed at once; a longer text is parted where no letter stands.
BLOCK = 1 << 16
BITS = 64


@dataclass(frozen=True)
class Settings:
    """orders: lengths of n-grams, the marks at a word's ends counted as letters.
    least: the share of a language's n-grams of that length that an n-gram must have, so that a language holds at most
    1/least n-grams a length, however much text there is. contrast: how many times the share may be lower than in the
    language where it is highest. slots (a power of two) and hashes: size of the filter and slots an n-gram.
    most_languages: more labels than that are refused, for a slot has a bit a language."""

    orders: tuple[int, ...] = (1, 2, 3, 4)
    least: float = 5e-5
    contrast: float = 3.0
    slots: int = 1 << 20
    hashes: int = 3
    most_languages: int = 1024


@dataclass(frozen=True)
class Model:
    """languages by falling number of texts; table[slot, word]: bitmasks of the languages, 64 each where there are more;
    false: the chance that a language claims an n-gram it doesn't hold."""

    languages: tuple[str, ...]
    table: np.ndarray
    false: np.ndarray
    settings: Settings


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = np.uint64(0x9E3779B97F4A7C15)
#: What a code point is: 0 not looked up yet, 1 a letter, 2 none.
_KIND = np.zeros(0x110000, dtype=np.uint8)


def letters(codes: np.ndarray) -> np.ndarray:
    kinds = _KIND[codes]
    if not kinds.all():
        for c in np.unique(codes[kinds == 0]).tolist():
            _KIND[c] = 1 if chr(c).isalpha() else 2
        kinds = _KIND[codes]
    return kinds == 1


def pieces(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """The texts in lower case, about BLOCK characters at once, and of which text each piece is.

    A text is parted at a place without a letter, or within a word of more than 1,000 letters."""
    held: list[str] = []
    of: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        text = text.lower()
        begin = 0
        while begin < len(text):
            end = min(len(text), begin + BLOCK)
            if end < len(text):
                end += next((k for k in range(1000) if not text[end + k : end + k + 1].isalpha()), 0)
            held.append(text[begin:end])
            of.append(i)
            size += end - begin
            begin = end
            if size >= BLOCK:
                yield held, of
                held, of, size = [], [], 0
    if held:
        yield held, of


def gram_hashes(parts: list[str], orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, hashes, part) of all n-grams of the words of the parts. A word is a longest sequence of letters; a mark
    stands before and after it, at an n-gram's ends only, and none is made of marks alone."""
    codes = np.frombuffer(("\n" + "\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    part = np.repeat(np.arange(len(parts)), [len(p) + 1 for p in parts])
    part = np.concatenate([[0], part])
    letter = letters(codes)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # one mark after each word is also the one before the next
    kept[0] = True
    codes, part, mark = np.where(letter, codes + np.uint32(1), np.uint32(0))[kept], part[kept], ~letter[kept]
    value = mixed(codes.astype(np.uint64) + np.uint64(1))
    running, inside = value, ~mark  # inside: no mark but at the ends
    for order in range(1, max(orders) + 1):
        if order == 2:
            inside = ~(mark[:-1] & mark[1:])
        elif order > 2:
            inside = inside[:-1] & ~mark[order - 2 : -1] if order > 3 else ~mark[1:-1]
        if order > 1:
            running = running[:-1] * _STEP + value[order - 1 :]
        if order in orders:
            at = np.flatnonzero(inside)
            yield order, mixed(running[at] ^ np.uint64(order * 0x632BE59BD9B4E019 % 2**64)), part[at + mark[at]]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def gram_counts(texts: DataFrame, orders: tuple[int, ...]) -> DataFrame:
    """lang, n (the length), gram (its hash) and total of all n-grams of the texts' words; texts: lang, text,
    rows without either left out.

    A task adds up COUNT_BYTES of text before its rows reach Spark, which adds them up again before the shuffle: a
    language of most rows is no large group.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, "text", COUNT_BYTES):
            table = pa.table([batch.column("lang"), batch.column("text")], ["lang", "text"])
            for lang in pc.unique(table["lang"]).to_pylist():
                own = table.filter(pc.equal(table["lang"], lang))["text"].to_pylist()
                for parts, _ in pieces(own):
                    for order, hashes, _ in gram_hashes(parts, orders):
                        found = pa.array(hashes.view(np.int64)).value_counts()
                        n = len(found)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, order, dtype=np.int32)), found.field("values"), found.field("counts")], ["lang", "n", "gram", "total"])

    full = texts.select("lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = full.mapInArrow(count, "lang string, n int, gram long, total long")
    return counted.groupBy("lang", "n", "gram").agg(F.sum("total").alias("total"))


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model | None:  # noqa: B008
    """Learns from text and lang of all documents that aren't held out; None without such a document.

    Rows of a null id, text or lang don't take part. What comes to the driver: the languages, at most `most_languages`,
    and the filter, a row a slot and 64 languages at most.
    """
    s = settings
    known = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), "text")
    ranked = known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(s.most_languages + 1).collect()
    languages = [r["lang"] for r in ranked]
    if len(languages) > s.most_languages:
        raise ValueError(f"more than {s.most_languages} languages")
    if not languages:
        return None
    bits = s.slots.bit_length() - 1
    if 1 << bits != s.slots or bits * s.hashes > 64:
        raise ValueError("slots must be a power of two, and the slots of an n-gram take 64 bits at most")
    counts = cut(gram_counts(known, s.orders))
    totals = counts.groupBy("lang", "n").agg(F.sum("total").alias("all"))
    numbers = docs.sparkSession.createDataFrame(list(enumerate(languages)), "number int, lang string")
    sizes = F.broadcast(totals.join(F.broadcast(numbers), "lang"))  # a row a language and length
    usual = counts.join(sizes, ["lang", "n"]).withColumn("share", F.col("total") / F.col("all")).filter(F.col("share") >= s.least)
    most = usual.groupBy("n", "gram").agg(F.max("share").alias("most"))
    held = usual.join(most, ["n", "gram"]).filter(F.col("share") * s.contrast >= F.col("most"))
    slot = F.explode(F.array(*[F.shiftrightunsigned("gram", bits * k).bitwiseAND(s.slots - 1) for k in range(s.hashes)])).alias("slot")
    masks = held.select(slot, F.floor(F.col("number") / BITS).cast("int").alias("word"), F.expr(f"shiftleft(1L, number % {BITS})").alias("bit"))
    rows = masks.groupBy("slot", "word").agg(F.bit_or("bit").alias("mask")).toArrow()
    table = np.zeros((s.slots, -(-len(languages) // BITS)), dtype=np.uint64)
    table[rows["slot"].to_numpy(), rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    if len(languages) <= BITS:  # bitmasks as narrow as they can be
        table = table.astype(np.min_scalar_type((1 << len(languages)) - 1))
    filled = np.array([(table[:, k // BITS] >> table.dtype.type(k % BITS) & table.dtype.type(1)).mean() for k in range(len(languages))])
    return Model(tuple(languages), table, filled**s.hashes, s)


def claims(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of each text that each language claims to hold, [text, language], and all n-grams of each text."""
    s, n = model.settings, len(texts)
    bits = s.slots.bit_length() - 1
    counts, grams = np.zeros((n, len(model.languages)), dtype=np.int64), np.zeros(n, dtype=np.int64)
    width = model.table.dtype.itemsize * 8
    for parts, of in pieces(texts):
        for _, hashes, part in gram_hashes(parts, s.orders):
            text = np.asarray(of)[part]
            cuts = np.searchsorted(text, np.arange(n + 1))  # texts lie one after the other
            grams += np.diff(cuts)
            slots = [((hashes >> np.uint64(bits * k)) & np.uint64(s.slots - 1)).astype(np.int64) for k in range(s.hashes)]
            for word in range(model.table.shape[1]):
                masks = model.table[slots[0], word]
                for at in slots[1:]:
                    masks &= model.table[at, word]
                for k in range(word * width, min(len(model.languages), (word + 1) * width)):
                    has = np.cumsum((masks >> masks.dtype.type(k % width)) & masks.dtype.type(1), dtype=np.int64)
                    counts[:, k] += np.diff(np.concatenate([[0], has])[cuts])
    return counts, grams


def decide(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The language of each text, and its share of all languages' corrected counts (0 where no n-gram is known)."""
    counts, grams = claims(model, texts)
    true = np.maximum(0, (counts - grams[:, None] * model.false) / np.maximum(1e-9, 1 - model.false))
    best = true.argmax(axis=1)  # ties: the language of more texts
    score = true[np.arange(len(texts)), best] / np.maximum(true.sum(axis=1), 1e-300)
    lettered = [g > 0 or any(c.isalpha() for c in t) for g, t in zip(grams.tolist(), texts, strict=True)]
    return [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), lettered, strict=True)], np.where(lettered, score, 0.0)


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every whole text. Null texts and those without a letter are `und` with score 0, and
    so is every text where nothing was learnt."""
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # slots * languages / 8 bytes

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, "text", SLICE_BYTES):
            found, score = decide(shared.value, [t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(identify, f"doc_id {kind}, lang_pred string, score double")


def identify_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """doc_id, held_out, lang_pred, score of every whole text; only the text is an input of a prediction.

    Null ids are judged, not held out, and not learnt from. Repeated rows get equal results; an empty table gives no
    rows; extra columns are left out.
    """
    out = identified(docs, fit(docs, settings))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

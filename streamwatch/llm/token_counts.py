"""Token counts and token ids by public tokenizers, batch by batch in Arrow functions.

Counts: the rows of a task are dealt to batches of about equal bytes, each of which is one call of the library; only a
text that is longer than a part is split, where no token can cross. Ids: words between safe spaces have the same ids
wherever they stand, so the library meets each distinct word of a batch once, and not at all while it is remembered;
what is remembered is bounded, and forgetting changes no result. Splitting, telling words apart and putting their ids
together are Arrow calls on the whole batch.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import balanced, giving_back

LIMIT = 4096
#: Bytes of text in a batch of counts and of ids, characters of a part of a long text.
SLICE_BYTES, ID_BYTES, PART_CHARS = 4 << 20, 4 << 20, 1 << 18
#: Words that a worker remembers, bytes of the longest of them, and words in a call of the library, which holds much for each.
REMEMBERED, SHORT, CALL = 400_000, 48, 4096
#: Long-known letters: with or without a space in front, a run of them is one piece of a byte-level vocabulary.
LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
LETTERS = re.compile(f"[{LETTER}]+")
#: A single space between characters that aren't white space: no piece of a byte-level vocabulary crosses it.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Neighbouring white space: texts without it have a safe space or line feed wherever they have one.
DOUBLE = re.compile(r"\s\s")
#: A safe space for sentencepiece: neither neighbour is white space or the mark that stands for a space: the model has pieces of several marks.
SAFE_PIECE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


def spaced(text: str) -> list[str]:
    """The parts between safe spaces, each but the first with its space in front."""
    first, *rest = SAFE.split(text)
    return [first, *(" " + p for p in rest)]


def long_parts(text: str, chars: int) -> list[str]:
    """A text as parts of at least so many characters (but the last), cut at safe spaces; whole where it has none."""
    out, at = [], 0
    while len(text) - at > chars and (m := SAFE_PIECE.search(text, at + chars)):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


def byte_letters() -> list[str]:
    """The character that a byte-level vocabulary writes for each byte: its own where that is printable in Latin-1."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def lists(lengths: Sequence[int] | np.ndarray, ids: np.ndarray) -> pa.Array:
    """Lists of so many ids each."""
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.uint32()))


class PieceCounter:
    """Counts of sentencepiece tokens. A part behind a space gets the same leading mark that the first part gets."""

    def __init__(self, path: str, chars: int = PART_CHARS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        inside = any("▁" in p.lstrip("▁") for p in pieces)
        #: Parts are independent only if no piece has a mark behind another character, and the text is taken as it is.
        self.splits = not inside and self.model.encode("a b") == self.model.encode("a") + self.model.encode("b")
        self.chars = chars

    def counts(self, texts: list[str]) -> list[int]:
        parts = [long_parts(t, self.chars) if self.splits and len(t) > self.chars else [t] for t in texts]
        n = np.fromiter(map(len, self.model.encode([p for ps in parts for p in ps], num_threads=1)), dtype=np.int64)
        ends = np.cumsum([len(ps) for ps in parts])
        return np.diff(np.concatenate([[0], np.cumsum(n)])[ends], prepend=0).tolist()


class ByteEncoder:
    """Ids of a byte-level vocabulary in its JSON form, as little-endian unsigned 32-bit numbers.

    Special strings inside texts become their own ids, as is the library's default. Tests hold the ids of whole texts
    against those of the library alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its core only
        self.model = Tokenizer.from_file(path)
        self.line_feed = self._encode(["\n"])[0].tobytes()
        self.letters = np.array([ord(c) for c in byte_letters()], dtype="<u2")
        #: Characters that may begin what isn't a run of one class: a shortened word, or a special string.
        begin = {"'", *(t.content[0] for t in self.model.get_added_tokens_decoder().values())}
        marks = "".join(re.escape(c) for c in string.punctuation if c not in begin)
        #: A word of letters, digits and marks falls into runs of each; line feed and end of word are pieces of their own.
        self.simple = rf"\A\n?[{LETTER}0-9{marks}]+\z"
        self.run = re.compile(rf" ?(?:[{LETTER}]+|[0-9]+|[{marks}]+)|[\n\0]")
        #: The library's model takes pieces as they are where nothing but a byte-level split comes before it.
        pieces = self.model.pre_tokenizer and [p for p, _ in self.model.pre_tokenizer.pre_tokenize_str("ab cdé12.;")]
        self.direct = self.model.normalizer is None and pieces == ["ab", "ĠcdÃ©", "12", ".;"] and not any(c.isalnum() for c in begin)
        #: The same model behind a split at the letter of byte 1, and the id that ends a word: that of byte 0.
        self.cut = Tokenizer(self.model.model)
        self.cut.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(chr(self.letters[1]))
        self.end = self.model.token_to_id(chr(self.letters[0]))
        #: Words that were met before, latest first, and their ids. A line's first word has its line feed in front, others a space.
        self.before = pa.array([], pa.large_string())
        self.held = pa.array([], pa.list_(pa.uint32()))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, lines: list[str]) -> list[bytes]:
        """Ids of strings without line feeds and without white space at their ends (but one space in front).

        They go in as lines of one text: a line feed there is one id of its own.
        """
        if not lines:
            return []
        ids = self._encode(["\n".join(lines)])[0]
        ends = np.append(np.flatnonzero(ids == np.frombuffer(self.line_feed, dtype="<u4")[0]), len(ids)) * 4
        data = ids.tobytes()
        return [data[s:e] for s, e in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist(), strict=True)]

    def _simple(self, words: list[str]) -> pa.Array:
        """Ids of words of letters, digits and marks: their runs go to the library's model as the pieces they are."""
        text = self.run.sub("\\g<0>\1", (" " + "\0 ".join(words) + "\0").replace(" \n", "\n"))
        pieces = self.letters[np.frombuffer(text.encode(), dtype="u1")].tobytes().decode("utf-16-le")
        ids = np.array(self.cut.encode_batch_fast([pieces], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(ids == self.end)
        return lists(np.diff(ends, prepend=-1) - 1, np.delete(ids, ends))

    def _others(self, words: list[str]) -> pa.Array:
        """Ids of any words, through the library's own split."""
        heads = iter(self._lines([w[1:] for w in words if w[0] == "\n"]))
        rest = iter(self._lines([" " + w for w in words if w[0] != "\n"]))
        ids = [self.line_feed + next(heads) if w[0] == "\n" else next(rest) for w in words]
        return lists([len(x) // 4 for x in ids], np.frombuffer(b"".join(ids), dtype="<u4"))

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words; those not met before go to the library."""
        known = pc.index_in(words, self.before)
        new = words.filter(pc.is_null(known))
        runs = pc.match_substring_regex(new, self.simple) if self.direct else pa.array(np.zeros(len(new), dtype=bool))
        simple, other = new.filter(runs), new.filter(pc.invert(runs))
        met = [f(part[i : i + CALL].to_pylist()) for f, part in ((self._simple, simple), (self._others, other)) for i in range(0, len(part), CALL)]
        held = pa.concat_arrays([self.held, *met])
        own = pc.fill_null(known, -1).to_numpy().astype(np.int64)
        unused = np.ones(len(self.before), dtype=bool)
        unused[own[own >= 0]] = False
        own[np.flatnonzero(own < 0)[np.argsort(~runs.to_numpy(zero_copy_only=False), kind="stable")]] = len(self.before) + np.arange(len(new))
        short = own[pc.less_equal(pc.binary_length(words), SHORT).to_numpy(zero_copy_only=False)]
        stay = np.concatenate([short, np.flatnonzero(unused)])[:REMEMBERED]
        self.before, self.held = pa.concat_arrays([self.before, simple, other]).take(stay), held.take(stay)
        return held.take(own)

    def ids(self, text: str) -> bytes:
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[bytes]:
        clean = [bool(t) and not (t[0].isspace() or t[-1].isspace() or DOUBLE.search(t)) for t in texts]
        own = [("\n" + t).replace("\n", " \n")[1:] for t, c in zip(texts, clean, strict=True) if c]
        split = pc.split_pattern(pa.array(own, pa.large_string()), " ")
        words = split.values.dictionary_encode()
        ids = self._words(words.dictionary).take(words.indices)
        ends = ids.offsets.to_numpy()[split.offsets.to_numpy()].astype(np.int64) * 4
        data = memoryview(ids.values.to_numpy()).cast("B")
        parts = iter([bytes(data[a + 4 : b]) for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)])  # without the line feed in front
        return [next(parts) if c else self._parts(spaced(t)) for t, c in zip(texts, clean, strict=True)]

    def _parts(self, parts: list[str]) -> bytes:
        """Ids of a text's parts, one behind the other."""
        return b"".join(np.concatenate(self._encode(parts[i : i + CALL])).tobytes() for i in range(0, len(parts), CALL))


_LOADED: dict = {}


def loaded(kind: type, path: str):
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text; only lengths leave the Arrow function.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and null ids are counted row by row; other columns are
    left out; an empty table gives no rows. path names the sentencepiece model on every machine.
    """

    @giving_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(PieceCounter, path)
        for batch in balanced(batches, "text", SLICE_BYTES):
            n = pa.array(counter.counts([t or "" for t in batch.column("text").to_pylist()]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

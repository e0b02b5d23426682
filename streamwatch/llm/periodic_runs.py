"""Periodic runs of words: stretches that repeat with a smallest period, found through longest common extensions.

Many texts' words lie in one array, a word of its own after each text, so that no repetition crosses two texts. Only the
suffixes whose place falls into a difference cover are sorted. The common extension of two places compares the few words
up to the next places that are both in the cover, and takes the rest as a least value over the sorted suffixes' common
prefixes (sparse table). Runs are enumerated on a harmonic grid: a run of period q that holds 3q places equal to those q
later meets three multiples of q, so N/q grid places are looked at a period, N log N in all, and each stretch that goes on
there is two common extensions, one forward and one backward.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import balanced

#: Every difference modulo SPAN is one of two members of COVER (a perfect difference set).
SPAN, COVER = 31, (1, 5, 11, 24, 25, 27)
#: A run is so many words long at least, and so many of its periods.
LEAST, TIMES = 6, 4
SLICE_BYTES = 2 << 20


def _offsets() -> np.ndarray:
    """For two residues, the least step that brings both into the cover."""
    inside = np.zeros(SPAN, dtype=bool)
    inside[list(COVER)] = True
    out = np.full((SPAN, SPAN), -1, dtype=np.int64)
    r = np.arange(SPAN)
    for step in reversed(range(SPAN)):
        both = inside[(r + step) % SPAN][:, None] & inside[(r + step) % SPAN][None, :]
        out[both] = step
    return out


_OFFSETS = _offsets()


class Extensions:
    """Longest common extensions of places of an array of word numbers (0 and more) in constant time each."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        top = int(words.max(initial=-1)) + 1
        # words of their own end every suffix; blocks of SPAN words can be read at any cover place up to n + SPAN
        self.words = np.concatenate([words, np.arange(top, top + 2 * SPAN)]).astype(np.int64)
        places = np.arange(n + SPAN)
        at = places[np.isin(places % SPAN, COVER)]
        self.number = np.full(n + SPAN, -1, dtype=np.int64)
        self.number[at] = np.arange(len(at))
        levels = [self._blocks(at)]
        length = SPAN
        while levels[-1].max(initial=-1) + 1 < len(at):  # ranks by twice as many words, until all differ
            further = at + length
            held = further < n + SPAN
            later = np.zeros(len(at), dtype=np.int64)
            later[held] = levels[-1][self.number[further[held]]] + 1
            levels.append(np.unique(levels[-1] * (len(at) + 1) + later, return_inverse=True)[1].reshape(-1))
            length *= 2
        self.rank = levels[-1]
        self.table = self._sparse(at, levels)

    def _blocks(self, at: np.ndarray) -> np.ndarray:
        """Ranks of the cover places by their first SPAN words."""
        blocks = np.lib.stride_tricks.sliding_window_view(self.words, SPAN)[at].astype(">u4")
        return np.unique(np.ascontiguousarray(blocks).view(f"V{4 * SPAN}").reshape(-1), return_inverse=True)[1].reshape(-1)

    def _sparse(self, at: np.ndarray, levels: list[np.ndarray]) -> list[np.ndarray]:
        """Common prefixes of neighbours in the order of suffixes, and their least values over 2, 4, 8, ... neighbours."""
        order = np.empty(len(at), dtype=np.int64)
        order[self.rank] = np.arange(len(at))
        a, b = at[order[:-1]].copy(), at[order[1:]].copy()
        common = np.zeros(len(a), dtype=np.int64)
        for level in reversed(range(len(levels))):
            held = (a < len(self.number)) & (b < len(self.number))
            same = np.flatnonzero(held)
            same = same[levels[level][self.number[a[same]]] == levels[level][self.number[b[same]]]]
            step = SPAN << level
            a[same] += step
            b[same] += step
            common[same] += step
        common += self._compared(a, b, np.full(len(a), SPAN))
        table = [common]
        while 2 << (len(table) - 1) <= len(common):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        return table

    def _compared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many of the next `most` words are equal from the first on."""
        out = np.zeros(len(a), dtype=np.int64)
        live = np.flatnonzero(most > 0)
        for k in range(SPAN):
            live = live[self.words[a[live] + k] == self.words[b[live] + k]]
            out[live] = k + 1
            live = live[most[live] > k + 1]
            if not len(live):
                break
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of different places, the number of words from them on that are equal."""
        step = _OFFSETS[a % SPAN, b % SPAN]
        out = self._compared(a, b, step)
        rest = np.flatnonzero(out == step)
        if len(rest):
            x, y = (self.rank[self.number[p[rest] + step[rest]]] for p in (a, b))
            low, high = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp(high - low)[1] - 1
            least = np.empty(len(rest), dtype=np.int64)
            for k in np.unique(level):
                of = np.flatnonzero(level == k)
                least[of] = np.minimum(self.table[k][low[of]], self.table[k][high[of] - (1 << int(k))])
            out[rest] += least
        return out


def chains(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, period) of chains of grid places, where runs of TIMES periods or more may lie.

    A run holds TIMES - 1 multiples of its period in a row whose words are equal to those a period later. A chain is a
    sequence of neighbouring multiples that each begin such a row; it may hold several runs.
    """
    firsts, lasts, periods = [], [], []
    for q in range(1, longest // TIMES + 1):
        grid = words[::q]
        same = grid[:-1] == grid[1:]
        row = same[: len(same) - TIMES + 2]
        for k in range(1, TIMES - 1):
            row = row & same[k : len(same) - TIMES + 2 + k]
        at = np.flatnonzero(row)
        if len(at):
            apart = np.flatnonzero(np.diff(at) > 1)
            firsts.append(at[np.concatenate([[0], apart + 1])] * q)
            lasts.append(at[np.concatenate([apart, [len(at) - 1]])] * q)
            periods.append(np.full(len(apart) + 1, q))
    return tuple(np.concatenate([*parts, np.zeros(0, dtype=np.int64)]).astype(np.int64) for parts in (firsts, lasts, periods))


def stretches(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the longest stretches around the grid places of all chains that keep the period."""
    g, last, q = chains(words, longest)
    if not len(g):
        return g, g, g
    ahead, behind, end = Extensions(words), Extensions(words[::-1]), len(words) - 1
    found = []
    while len(g):  # go on from the first grid place that a stretch doesn't reach
        forward = ahead.common(g, g + q)
        backward = np.zeros(len(g), dtype=np.int64)
        inner = np.flatnonzero(g > 0)
        backward[inner] = behind.common(end - (g[inner] - 1), end - (g[inner] + q[inner] - 1))
        found.append((g - backward, forward + backward + q, q))
        g = ((g + forward) // q + 1) * q
        more = g <= last
        g, last, q = g[more], last[more], q[more]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def runs(texts: list[np.ndarray], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run in texts of word numbers, by text, start and period.

    A run is a stretch with smallest period q, of max(least, TIMES * q) words or more, which no neighbour extends.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    top = max((int(t.max()) for t in texts if len(t)), default=-1) + 1
    words = np.full(int((sizes + 1).sum()), -1, dtype=np.int64)
    ends = begins + sizes
    words[ends] = np.arange(top, top + len(texts))
    if sizes.sum():
        words[words < 0] = np.concatenate(texts)
    start, length, q = stretches(words, int(sizes.max(initial=0)))
    kept = length >= np.maximum(least, TIMES * q)
    start, length, q = start[kept], length[kept], q[kept]
    # a stretch found again by a multiple of its period is the same stretch: the smallest period stays
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (np.diff(start) != 0) | (np.diff(length) != 0)
    start, length, q = start[first], length[first], q[first]
    text = np.searchsorted(begins, start, side="right") - 1
    order = np.lexsort((q, start))
    return text[order], (start - begins[text])[order], length[order], q[order]


def looped(words: list, doc_id: int | None) -> list:
    """The words with the loop that the id asks for: every tenth hash makes the words from some place on periodic."""
    if doc_id is None or not words:
        return words
    h = crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *[words[a + i % p] for i in range(n - a)]]


def collapsed(words: list, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list:
    """The words without those that lie in any run after its first period."""
    if not len(start):
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    keep = np.cumsum(edge[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def find_runs(docs: DataFrame, columns: dict[str, pa.DataType], row, prepare=None) -> DataFrame:
    """doc_id and `columns` of every text: what `row` makes of its words and of the starts, lengths and periods of its runs.

    Words are what ASCII white space parts, as UTF-8; `prepare` may change a text's words, given its doc_id. A null text
    has no words. Texts are read whole, where they lie: no shuffle. A batch holds about SLICE_BYTES of text, or one text.
    """
    names = ["doc_id", *columns]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in balanced(batches, "text", SLICE_BYTES):
            numbers: dict[bytes, int] = {}
            ids, lists, arrays = batch.column("doc_id").to_pylist(), [], []
            for doc_id, text in zip(ids, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = (text or b"").split()
                words = prepare(words, doc_id) if prepare else words
                lists.append(words)
                arrays.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words)))
            text, start, length, period = runs(arrays)
            cuts = np.searchsorted(text, np.arange(len(lists) + 1)).tolist()
            rows = [row(w, start[a:b], length[a:b], period[a:b]) for w, a, b in zip(lists, cuts, cuts[1:], strict=False)]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names)

    sql = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int64()): "array<long>"}
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, ", ".join([f"doc_id {kind}", *[f"{n} {sql[t]}" for n, t in columns.items()]]))


def document_runs(docs: DataFrame) -> DataFrame:
    """doc_id and its runs as equally long arrays start, length, period (word numbers from 0), by start, then period; and
    `collapsed`: the text of the words that no run repeats, joined by single spaces. Null and empty texts have none."""

    def row(words, start, length, period):
        return start.tolist(), length.tolist(), period.tolist(), b" ".join(collapsed(words, start, length, period)).decode()

    longs = pa.list_(pa.int64())
    return find_runs(docs, {"start": longs, "length": longs, "period": longs, "collapsed": pa.string()}, row)


def digest_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every whole text, words
    looped as `looped` says.

    start to exponent_milli are those of the longest run (the first, then of the smallest period, on ties), null without
    runs. A null text is empty; a null id has no loop; repeated rows have a row each; an empty table gives no rows;
    extra columns are left out.
    """

    def row(words, start, length, period):
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
        kept = b" ".join(collapsed(words, start, length, period))
        best = [None] * 4
        if len(start):
            i = int(np.argmax(length))  # runs are by start, then period: the first of the longest
            best = [int(start[i]), int(length[i]), int(period[i]), 1000 * int(length[i]) // int(period[i])]
        return len(start), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()

    longs = dict.fromkeys(["n_runs", "start", "length", "period", "exponent_milli"], pa.int64())
    return find_runs(docs, longs | {"runs_sha256": pa.string(), "collapsed_sha256": pa.string()}, row, looped)

"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of itself and its character n-grams (hashed to buckets), a bag of words the mean of
its words, and a softmax layer over that mean gives the classes. As all of it is linear up to the softmax, scoring
needs one number per bucket: the difference of the two classes, and a word's value is the mean over its buckets. The
vectors are trained on windows of words. A whole text is judged by what its words' values show: its average, its most
toxic windows, its most toxic words, and how many words lie above the values that few words reach, against its length
(one such word may be chance in a long text; several in a short one aren't). A logistic layer over these, fitted on
labelled documents that weren't used for the vectors, gives the probability.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, giving_back

WORD = re.compile(r"\w+")
#: Bound of the training sample: so many documents of label 0 and of label 1, none longer than so many characters.
SAMPLE, SAMPLE_CHARS = (3000, 1500), 40_000
#: Words that a task remembers, and documents that are split into words at once.
REMEMBERED, SLICE_ROWS = 250_000, 128
FOLDS = 5


@dataclass(frozen=True)
class Settings:
    """lean: what a document of label 1 weighs in the last layer, over its share where the labels come from; of that, what
    goes beyond 1 counts in full with many such documents, and half with `few`."""

    buckets: int = 1 << 18
    dim: int = 8
    low: int = 3
    high: int = 6
    window: int = 8
    lean: float = 3.5
    few: int = 40
    refresh: int = 25
    steps: int = 600
    rate: float = 0.2
    batch: int = 128
    seed: int = 1


def grams(word: str, s: Settings) -> list[int]:
    """Buckets of a word and its n-grams; < and > mark its ends."""
    marked = f"<{word}>"
    n, b = len(marked), s.buckets
    if marked.isascii():
        raw = marked.encode()
        return [crc32(raw) % b, *[crc32(raw[i : i + k]) % b for k in range(s.low, s.high + 1) for i in range(n - k + 1)]]
    code = lambda x: crc32(x.encode("utf-8", "surrogatepass")) % b
    return [code(marked), *[code(marked[i : i + k]) for k in range(s.low, s.high + 1) for i in range(n - k + 1)]]


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bags(words_: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of all words in a row, and how many each word has; a few words at once, for a bounded working set."""
    flat, size = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
    for at in range(0, len(words_), 5000):
        each = [grams(w, s) for w in words_[at : at + 5000]]
        flat.append(np.fromiter(chain.from_iterable(each), dtype=np.int32))
        size.append(np.fromiter(map(len, each), dtype=np.int64, count=len(each)))
    return np.concatenate(flat), np.concatenate(size)


def unrepeated(x: np.ndarray) -> np.ndarray:
    """x without what equals its predecessor: a word that follows itself counts once."""
    return x[np.flatnonzero(np.diff(x, prepend=np.nan))] if len(x) else x


#: Shares of the training words' values below the three limits that words are counted against, and the longer window.
LIMITS, WIDE = (0.99, 0.995, 0.998), 64


def top_window(values: np.ndarray, window: int) -> float:
    """Largest mean over all windows of so many words; a shorter text is one window, filled up with zeros."""
    if len(values) <= window:
        return float(values.sum() / window)
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return float((sums[window:] - sums[:-window]).max() / window)


def shown(values: np.ndarray, limits: np.ndarray, window: int) -> list[float]:
    """What the values of a text's words show; a text without words is one word of value 0."""
    n = max(len(values), window)
    if not len(values):
        values = np.zeros(1)
    best = np.unique(values)[::-1]
    best = np.concatenate([best, np.full(5, min(best[-1], 0.0))])
    out = [top_window(values, window), top_window(values, WIDE), float(values.sum()) / n, best[1], best[2], best[4]]
    for limit in limits:
        k = int((values > limit).sum())
        out += [math.log1p(k), math.log((k + 0.5) / (n + 50))]
    return [*out, math.log(n)]


@dataclass(frozen=True)
class Model:
    """difference: per bucket, class 1 less class 0. weights: of the standardised parts of `shown`, and a constant."""

    difference: np.ndarray
    limits: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    settings: Settings

    def scores(self, texts: list[str], known: dict[str, float]) -> np.ndarray:
        """known: values of words, kept between calls and forgotten at its bound."""
        split = [words(t) for t in texts]
        new = list({w for ws in split for w in ws if w not in known})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list({w for ws in split for w in ws})
        for at in range(0, len(new), 5000):
            part = new[at : at + 5000]
            flat, size = bags(part, self.settings)
            known.update(zip(part, (np.add.reduceat(self.difference[flat], np.cumsum(size) - size) / size).tolist(), strict=True))
        values = [unrepeated(np.fromiter(map(known.__getitem__, ws), dtype=float, count=len(ws))) for ws in split]
        x = np.array([shown(v, self.limits, self.settings.window) for v in values]).reshape(len(texts), -1)
        # summed row by row: a text's score doesn't depend on its neighbours
        z = ((x - self.mean) / self.spread * self.weights[:-1]).sum(1) + self.weights[-1] if len(x) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(texts: list[str], labels: np.ndarray, s: Settings = Settings(), toxic_share: float | None = None) -> Model:  # noqa: B008
    """A fourth of the documents only fits the last layer.

    toxic_share: share of label 1 where the texts were sampled from; the sample's own, if not given.
    """
    rng = np.random.default_rng(s.seed)
    vocabulary: dict[str, int] = {}
    docs = [unrepeated(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(t)], dtype=np.int32)) for t in texts]
    flat, size = bags(list(vocabulary), s)
    start = np.concatenate([[0], np.cumsum(size)])
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    layer = np.zeros((s.dim, 2), dtype=np.float32)
    layer[:, 1] = rng.normal(0, 0.1, s.dim)
    # Adagrad: one sum of squared gradients a bucket
    square, layer_square = np.full(s.buckets, 1e-10, dtype=np.float32), np.full((s.dim, 2), 1e-10, dtype=np.float32)
    fits = np.arange(len(docs)) % 4 != 3

    def word_scores() -> np.ndarray:
        if not len(size):
            return np.zeros(0)
        per = vectors @ (layer[:, 1] - layer[:, 0])
        return np.add.reduceat(per[flat], start[:-1]) / size

    def windows(epoch: int, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows of word numbers, filled up with -1. First spread over the texts, then the ones of highest value."""
        rows, ys = [], []
        for d in np.flatnonzero(fits).tolist():
            x = docs[d]
            if not len(x):
                continue
            if len(x) <= s.window:
                picks = [0]
            elif epoch == 0:
                picks = rng.integers(0, len(x) - s.window + 1, min(8, 1 + len(x) // s.window)).tolist()
            else:
                sums = np.concatenate([[0.0], np.cumsum(value[x])])
                means = sums[s.window :] - sums[: -s.window]
                picks = [int(np.argmax(means)), int(rng.integers(0, len(means)))] if labels[d] == 0 else [int(np.argmax(means))]
            for p in picks:
                row = np.full(s.window, -1, dtype=np.int32)
                part = x[p : p + s.window]
                row[: len(part)] = part
                rows.append(row)
                ys.append(labels[d])
        return np.array(rows).reshape(-1, s.window), np.array(ys, dtype=np.int64)

    epoch, steps, fresh = 0, 0, -s.refresh
    while steps < s.steps and fits.any():
        if steps - fresh >= s.refresh:  # the values that windows are picked by may be a few steps old
            value, fresh = word_scores(), steps
        rows, ys = windows(epoch, value)
        epoch += 1
        if not len(rows):
            break
        order = rng.permutation(len(rows))
        share = np.bincount(ys, minlength=2) / max(1, len(ys))
        for b in range(0, len(order), s.batch):
            pick = order[b : b + s.batch]
            steps += 1
            words_, y = rows[pick], ys[pick]
            at, slot = np.nonzero(words_ >= 0)
            w = words_[at, slot]
            n = size[w]
            own = np.repeat(at, n)
            g = flat[np.repeat(start[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            weight = np.repeat(1 / (n * s.window), n).astype(np.float32)
            bag = np.zeros((len(pick), s.dim), dtype=np.float32)
            gathered = vectors[g] * weight[:, None]
            cuts = np.flatnonzero(np.diff(own, prepend=-1))
            bag[own[cuts]] = np.add.reduceat(gathered, cuts, axis=0)
            logits = bag @ layer
            prob = np.exp(logits - logits.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            error = prob
            error[np.arange(len(y)), y] -= 1
            error *= (0.5 / np.maximum(share[y], 1e-3))[:, None] / len(y)
            back = error @ layer.T
            step = bag.T @ error
            layer_square += step * step
            layer -= s.rate * step / np.sqrt(layer_square)
            change = back[own] * weight[:, None]
            order_g = np.argsort(g, kind="stable")
            sorted_g = g[order_g]
            cuts = np.flatnonzero(np.diff(sorted_g, prepend=-1))
            step, hit = np.add.reduceat(change[order_g], cuts, axis=0), sorted_g[cuts]
            square[hit] += (step * step).mean(1)
            vectors[hit] -= s.rate * step / np.sqrt(square[hit])[:, None]
    value = word_scores().astype(np.float64)
    every = np.concatenate([value[x] for x in docs if len(x)] + [np.zeros(1)])
    limits = np.quantile(every, LIMITS)
    parts = np.array([shown(value[x], limits, s.window) for x in docs])
    judged = ~fits if len(set(labels[~fits].tolist())) == 2 else np.full(len(docs), True)
    toxic = int((labels[judged] == 1).sum())
    lean = 1 + (s.lean - 1) * toxic / (toxic + s.few)
    mean, spread = parts[judged].mean(0), parts[judged].std(0) + 1e-9
    weights = _logistic((parts[judged] - mean) / spread, labels[judged], labels.mean() if toxic_share is None else toxic_share, lean)
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), limits, mean, spread, weights, s)


def _logistic(x: np.ndarray, y: np.ndarray, share: float, lean: float) -> np.ndarray:
    """Weights and a constant by Newton steps with a ridge on the weights; label 1 weighs lean * share."""
    z = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, lean * share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(z.shape[1])
    ridge = np.append(np.ones(x.shape[1]), 1e-6)
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + ridge * w
        hessian = (z * (weight * p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge)
        step = np.clip(np.linalg.solve(hessian, gradient), -2, 2)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold(doc_id) -> F.Column:
    return (F.crc32(doc_id.cast("string").cast("binary")) % FOLDS).cast("int")


def sample(docs: DataFrame, labels: DataFrame, per_label: tuple[int, int] = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[pd.DataFrame, float]:
    """Labelled documents outside the held-out fold, at most so many of either label, smallest hashes of doc_id first;
    and the share of label 1 among all such documents."""
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    short = docs.filter((F.length("text") <= chars) & F.col("doc_id").isNotNull())
    ids = short.select("doc_id").join(marked, "doc_id").dropDuplicates(["doc_id"]).withColumn("h", F.xxhash64("doc_id"))
    few = [ids.filter(F.col("label") == y).orderBy("h", "doc_id").limit(per_label[y]) for y in (0, 1)]
    chosen = F.broadcast(few[0].unionByName(few[1]).select("doc_id", "label"))  # at most sum(per_label) ids
    share = marked.agg(F.avg("label")).first()[0]
    # an id of many rows brings its least text only
    rows = short.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return rows.toPandas().sort_values("doc_id")[["doc_id", "text", "label"]], share


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), per_label: tuple[int, int] = SAMPLE) -> Model | None:  # noqa: B008
    """None where one of the labels has no document to learn from."""
    rows, share = sample(docs, labels, per_label)
    if rows["label"].nunique() < 2:
        return None
    rows = rows.sample(frac=1, random_state=settings.seed)
    model = train(rows["text"].tolist(), rows["label"].to_numpy(), settings, share)
    del rows
    give_back()  # the driver goes on with other stages
    return model


def scored(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """Adds the score (0 to 1) to docs as column `name`. A null text counts as empty; without a model all scores are 0."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    held = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket

    @F.pandas_udf("double")
    @giving_back
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for texts in parts:
            out = [held.value.scores(texts[i : i + SLICE_ROWS].tolist(), known) for i in range(0, len(texts), SLICE_ROWS)]
            yield pd.Series(np.concatenate([*out, np.zeros(0)]))

    return docs.withColumn(name, score(F.coalesce(F.col("text"), F.lit(""))))


def score_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """doc_id, held_out, score, predicted of every whole text; labels come from the rows that aren't held out.

    Only the text is an input of the score. Null and empty texts get the score of a text without words. Null ids are
    scored, and not held out. Repeated rows get equal scores; an empty table gives no rows; extra columns are left out.
    """
    out = scored(docs.select("doc_id", "text"), fit(docs, labels, settings))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

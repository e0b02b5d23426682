"""Document fingerprints by winnowing: the least rolling k-gram hash of every window, rightmost on ties, with positions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Any passage of GRAM + WINDOW - 1 characters (white space and ASCII case aside) that two texts share leaves a common hash.
GRAM, WINDOW = 24, 60
#: Characters that are hashed at once; positions inside take POSITION_BITS, hashes the rest of 64 bits.
BLOCK, POSITION_BITS = 1 << 18, 20
HASH_BITS = 64 - POSITION_BITS
FLUSH_CHARS = 1 << 20
KEYS_PER_TASK = 4
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_PRIME, BLOCK + 4096), _powers(_INVERSE, BLOCK + 4096)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Rolling hashes of all grams of at most BLOCK + 4096 codes, HASH_BITS bits each."""
    n = len(codes)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=sums[1:])
    return _mixed((sums[gram:] - sums[:-gram]) * _DOWN[: n - gram + 1]) >> np.uint64(POSITION_BITS)


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes without white space, ASCII letters in lower case, and where each stood."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = (codes <= 32) & (codes >= 9) & ((codes <= 13) | (codes == 32))
    if len(codes) and codes.max() > 127:
        space |= np.isin(codes, _SPACES)
    at = np.flatnonzero(~space)
    kept = codes[at]
    return np.where((kept >= 65) & (kept <= 90), kept + np.uint32(32), kept), at


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions (code points of the text) of the chosen grams; a text of fewer characters is one gram."""
    codes, at = normalised(text)
    if not len(codes):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    gram = min(gram, len(codes))
    grams = len(codes) - gram + 1
    window = min(window, grams)
    hashes, places = [], []
    for begin in range(0, grams - window + 1, BLOCK - window):  # windows that start at begin and after
        end = min(grams, begin + BLOCK - 1)
        h = gram_hashes(codes[begin : end + gram - 1], gram)
        key = (h << np.uint64(POSITION_BITS)) | (np.uint64((1 << POSITION_BITS) - 1) - np.arange(len(h), dtype=np.uint64))
        span = 1
        while span * 2 <= window:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < window:
            key = np.minimum(key[: -(window - span)], key[window - span :])
        key = key[np.flatnonzero(np.diff(key, prepend=~key[:1]))]
        hashes.append(key >> np.uint64(POSITION_BITS))
        places.append(begin + ((1 << POSITION_BITS) - 1 - (key & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)))
    h, p = np.concatenate(hashes), np.concatenate(places)
    p, first = np.unique(p, return_index=True)
    return h[first], at[p]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two hash sets; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def written(hashes: np.ndarray, places: np.ndarray) -> str:
    return ",".join([f"{h:011x}:{p}" for h, p in zip(hashes.tolist(), places.tolist(), strict=True)])


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every whole text.

    Documents are in order of doc_id, null first, then of their text's hash; the next of the last is the first. Null
    texts count as empty: no hashes, an empty fingerprint. Each text is shuffled once, to the range of ids and text
    hashes it lies in, so that an id of many rows is many ranges; the first document of a range also goes to the range
    before. Rows equal in id and text follow each other in one range and are computed once. Extra columns are left out;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    tasks = partitions(spark)
    ranges = tasks * KEYS_PER_TASK
    lowest = F.lit(-(2**63)).cast("long")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), lowest).alias("_k"), F.xxhash64(text).alias("_h"))
    least = keyed.select("_k", "_h").repartitionByRange(ranges, "_k", "_h").groupBy(F.spark_partition_id()).agg(F.min(F.struct("_k", "_h")).alias("m"))
    firsts = sorted(tuple(r["m"]) for r in least.collect())  # a row a range
    low_k, low_h = (F.lit([f[i] for f in firsts]) if firsts else F.array().cast("array<long>") for i in (0, 1))
    reached = lambda i: (F.get(low_k, i) < F.col("_k")) | ((F.get(low_k, i) == F.col("_k")) & (F.get(low_h, i) <= F.col("_h")))
    halves = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, len(firsts)).bit_length()))])
    keyed = keyed.withColumn("_p", F.aggregate(halves, F.lit(0), lambda at, step: F.when(reached(at + step), at + step).otherwise(at)))
    heads = (F.get(low_k, F.col("_p")) == F.col("_k")) & (F.get(low_h, F.col("_p")) == F.col("_h"))
    own = F.struct(F.col("_p").alias("p"), F.lit(0).alias("role"))
    again = F.struct(F.pmod(F.col("_p") - 1, F.lit(max(1, len(firsts)))).cast("int").alias("p"), F.lit(1).alias("role"))
    dealt = keyed.withColumn("_to", F.explode(F.when(heads, F.array(own, again)).otherwise(F.array(own))))
    dealt = dealt.select(F.col("_to.p").alias("p"), F.col("_to.role").alias("role"), "_k", F.col("_h").alias("h"), "doc_id", "text")
    dealt = dealt.repartitionById(tasks, F.col("p") % tasks).sortWithinPartitions("p", "role", "_k", "h")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, last = 0, None  # the document before, with its range and fingerprint
        alike: tuple | None = None  # a text that follows itself, with its row

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for i in range(batch.num_rows):
                p, role = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if role and (last is None or last[0] != p):
                    continue
                doc, text = batch.column(4)[i].as_py(), batch.column(5)[i].as_py()
                again = last is not None and last[2] == text
                hashes, places = last[3:] if again else winnow(text, gram, window)
                if last is not None and last[0] == p:
                    _, before_id, before_text, h, at_ = last
                    if not (again and alike is not None and alike[0] == text):
                        new = edited(before_text, text)
                        eh, ep = winnow(new, gram, window)
                        made = (len(before_text), hashlib.sha256(new.encode()).hexdigest(), written(h, at_), written(eh, ep), likeness(h, eh), likeness(h, hashes))
                        alike = (text, made) if again else None
                    rows.append((before_id, *(alike[1] if again else made)))
                    held += len(before_text)
                last = None if role else (p, doc, text, hashes, places)
                if held > FLUSH_CHARS:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    return dealt.mapInArrow(compute, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

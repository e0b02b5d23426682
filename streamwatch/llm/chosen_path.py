"""N-gram Jaccard join by chosen paths.

Each text is the set of its word 5-grams, and each set is embedded as `TOKENS` minhash values, its tokens. In every run
all sets start in one bucket. A bucket is split by tokens that a hash of its path samples, so that two sets of the
wanted similarity share one child on average; only buckets of two sets or more go on, small ones end, large ones are
split again, and what is still large at the greatest depth is compared in blocks. Sets of a bucket that look alike by
their tokens are linked. Runs are repeated until a pair at the threshold is met with the target recall. The exact check
then computes the Jaccard similarity of all pairs within each group of linked sets, so a pair that the runs missed is
still found if other texts link its ends.

Equal texts (after lower-casing and splitting on white space) are one set from the start, and only counted again at the
end. No pair leaves a task but as one of a group's spanning links; no list of documents comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, giving_back, partitions, slices

GRAM, SIMILARITY = 5, 0.8
TOKENS, DEPTH, RECALL = 64, 4, 0.9999
#: Sets of a bucket that are compared at once; buckets up to it end.
BUCKET = 2048
#: Bits of the filter that keeps documents without a link out of the exact check's shuffle; its size is fixed.
FILTER_BITS = 1 << 24
#: Share of equal tokens from which two sets are linked for the exact check: 4 standard deviations below the threshold.
SLACK = 4.0
#: Sets of a group that are compared exactly at once, and columns of the incidence matrix.
BLOCK, COLUMNS = 384, 8192
SLICE_BYTES, CHUNK = 2 << 20, 1 << 20
ROUNDS = 60
_P = 0x9E3779B97F4A7C15
_I = pow(_P, -1, 1 << 64)
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_TABLE = mixed(np.arange(1, 257, dtype=np.uint64))
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_P, CHUNK), _powers(_I, CHUNK)


def word_hashes(data: np.ndarray, ends: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts that end at `ends` in the bytes of data; number of words up to each end.

    The bytes are taken in chunks for a bounded working set. The sums that hashes are made of go on over their edges, so
    chunks may end anywhere and change no hash.
    """
    n = len(data)
    ends = ends.astype(np.int64)
    firsts, lasts, before, after = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.uint64)]
    down = [np.zeros(0, dtype=np.uint64)]
    at, up_at, down_at = np.zeros(1, dtype=np.uint64), np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)  # as arrays, so that they wrap
    for begin in range(0, n, chunk):
        stop = min(n, begin + chunk)
        part = data[begin:stop]
        word = ~_WHITE[part]
        begins, stops = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        stops[:-1] &= ~word[1:]
        if begin:
            begins[0] &= bool(_WHITE[data[begin - 1]])
        if stop < n:
            stops[-1] &= bool(_WHITE[data[stop]])
        edges = ends[np.searchsorted(ends, begin) : np.searchsorted(ends, stop)] - begin
        begins[edges] = word[edges]
        edges = ends[np.searchsorted(ends, begin, "right") : np.searchsorted(ends, stop, "right")] - begin - 1
        stops[edges] = word[edges]
        sums = np.concatenate([at, at + np.cumsum(_TABLE[part] * _UP[: len(part)] * up_at)])
        first, last = np.flatnonzero(begins), np.flatnonzero(stops)
        firsts.append(first + begin)
        lasts.append(last + begin)
        before.append(sums[first])
        after.append(sums[last + 1])
        down.append(_DOWN[first] * down_at)
        at, up_at, down_at = sums[-1:], up_at * _UP[len(part)], down_at * _DOWN[len(part)]
    first, last = np.concatenate(firsts), np.concatenate(lasts)
    hashes = mixed((np.concatenate(after) - np.concatenate(before)) * np.concatenate(down) + (last - first + 1).astype(np.uint64))
    return hashes, np.searchsorted(first, ends, side="left")


def shingles(texts: pa.Array, gram: int = GRAM, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word grams of each text, repeats included, and where each text's begin (one more entry: the end).

    A text of fewer words is one gram of them all; one without words has none.
    """
    low = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    offsets = np.frombuffer(low.buffers()[1], dtype=np.int64)[low.offset : low.offset + len(low) + 1] if len(low) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(low.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, dtype=np.uint8)
    w, upto = word_hashes(data, offsets[1:] - offsets[0], chunk)
    n_words = np.diff(upto, prepend=0)
    n = np.where(n_words >= gram, n_words - gram + 1, (n_words > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(n)])
    base = np.repeat(upto - n_words, n) + np.arange(start[-1]) - np.repeat(start[:-1], n)
    long = np.repeat(n_words >= gram, n)
    out = np.zeros(start[-1], dtype=np.uint64)
    stop = np.repeat(upto, n)
    for k in range(gram):
        at = base + k
        inside = long | (at < stop)
        value = w[np.minimum(at, max(0, len(w) - 1))] if len(w) else out
        out = np.where(inside, mixed(out * U(3) + value + U(k + 1)), out)
    return out, start


def signature_rows(docs: DataFrame, gram: int = GRAM, tokens: int = TOKENS) -> DataFrame:
    """doc_id, row, two hashes of the text's grams (null for texts without words), and its tokens, whole and by their low bytes.

    row is a number that callers may give their rows (column _row; null if there is none).
    """
    seeds = mixed(np.arange(101, 101 + tokens, dtype=np.uint64)) | U(1)
    shifts = mixed(np.arange(901, 901 + tokens, dtype=np.uint64))

    @giving_back
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                h, start = shingles(batch.column("text"), gram)
                there = np.flatnonzero(np.diff(start) > 0)
                n = len(batch)
                a, b, sig = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64), np.zeros((n, tokens), dtype=np.uint32)
                if len(there):
                    cuts = start[there]
                    order = np.arange(len(h), dtype=np.uint64) - np.repeat(start[:-1], np.diff(start)).astype(np.uint64)
                    a[there] = np.add.reduceat(mixed(h + order), cuts)
                    b[there] = np.add.reduceat(mixed(h * U(5) + order), cuts)
                    for k in range(tokens):
                        sig[there, k] = np.minimum.reduceat((h ^ shifts[k]) * seeds[k], cuts) >> U(32)
                null = np.ones(n, dtype=bool)
                null[there] = False
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("row"), pa.array(a.view(np.int64), mask=null), pa.array(b.view(np.int64), mask=null), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())], ["doc_id", "row", "a", "b", "sig", "short"]
                )

    row = F.col("_row") if "_row" in docs.columns else F.lit(None)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.cast("long").alias("row"), "text").mapInArrow(sign, "doc_id long, row long, a long, b long, sig binary, short binary")


def chance(depth: int) -> float:
    """That a run keeps a pair at the threshold together for so many levels: one shared child on average each time."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return p


def runs_for(recall: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - chance(depth)))


def _children(rows: DataFrame, level: int, similarity: float, tokens: int, runs: int) -> DataFrame:
    """(path, id) of the children of each row's bucket; at level 0 the rows are sets, and the buckets the runs."""
    limit = U(int(2**64 / (similarity * tokens)))

    @giving_back
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = mixed(np.arange(1, tokens + 1, dtype=np.uint64))
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, tokens).astype(np.uint64)
            token = mixed(sig + places)
            paths = [np.full(len(ids), mixed(np.array([r + 1], dtype=np.uint64))[0]) for r in range(runs)] if level == 0 else [batch.column("path").to_numpy(zero_copy_only=False).view(np.uint64)]
            for path in paths:
                child = mixed(token ^ mixed(path + U(level))[:, None])
                row, k = np.nonzero(mixed(child + U(77)) < limit)
                yield pa.RecordBatch.from_arrays([pa.array(child[row, k].view(np.int64)), pa.array(ids[row])], ["path", "id"])

    return rows.mapInArrow(split, "path long, id long")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of a stream that is sorted by keys, several at once."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        df = batch.to_pandas()
        df = df if rest is None else pd.concat([rest, df], ignore_index=True)
        if df.empty:
            rest = df
            continue
        last = np.logical_and.reduce([df[k].to_numpy() == df[k].iloc[-1] for k in keys])
        if not last.all():
            yield df[~last]
        rest = df[last]
    if rest is not None and not rest.empty:
        yield rest


def _bounds(df: pd.DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    new = np.logical_or.reduce([df[k].to_numpy()[1:] != df[k].to_numpy()[:-1] for k in keys]) if len(df) > 1 else np.zeros(0, dtype=bool)
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(df)]
    return list(zip(cuts, cuts[1:], strict=False))


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Links of a forest over n items that joins what the pairs join."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for xs, ys in pairs:
        for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return [(root(x), x) for x in range(n) if root(x) != x]


def _bucket_links(rows: DataFrame, least: float, tokens: int) -> DataFrame:
    """Links between sets of one (bucket, block pair) whose tokens agree enough, by one byte of each; a forest for each."""

    @giving_back
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for df in _groups(batches, ["path", "x", "y"]):
            out = []
            sig = np.frombuffer(b"".join(df["short"]), dtype=np.uint8).reshape(-1, tokens)
            ids, side = df["id"].to_numpy(), df["side"].to_numpy()
            for s, e in _bounds(df, ["path", "x", "y"]):
                if e - s < 2:
                    continue
                own, part, g = sig[s:e], side[s:e], ids[s:e]

                def pairs(own=own, part=part):
                    for i in range(len(own) - 1):
                        hit = np.flatnonzero((own[i + 1 :] == own[i]).sum(1) >= least * tokens) + i + 1
                        hit = hit[part[hit] != part[i]] if part.any() else hit
                        if len(hit):
                            yield np.full(len(hit), i), hit

                out += [(g[x], g[y]) for x, y in spanning(e - s, pairs()) if g[x] != g[y]]
            if out:
                a, b = np.array(out, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    dealt = rows.repartition(partitions(rows.sparkSession), "path", "x", "y").sortWithinPartitions("path", "x", "y", "id")
    return dealt.mapInArrow(link, "a long, b long")


def in_blocks(rows: DataFrame, size: str, block: int) -> DataFrame:
    """Rows of large groups dealt to all pairs (x, y) of blocks; side is 1 for the rows of the second block of a pair.

    Pairs of equal blocks hold one block (side 0). Groups of up to `block` rows are the one pair (0, 0).
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(5)), F.col("_n")).cast("int")
    other = F.sequence(F.lit(0), F.col("_n") - 1)
    pair = lambda o: F.struct(F.least(F.col("_own"), o).alias("x"), F.greatest(F.col("_own"), o).alias("y"), F.when(F.col("_own") > o, 1).otherwise(0).alias("side"))
    many = rows.withColumn("_n", blocks).withColumn("_own", own).withColumn("_to", F.explode(F.transform(other, pair)))
    return many.select(*[c for c in rows.columns], F.col("_to.x").alias("x"), F.col("_to.y").alias("y"), F.col("_to.side").alias("side"))


def components(links: DataFrame) -> DataFrame:
    """id and group (its smallest id) of all ends of the links (a < b), by alternating large-star and small-star rounds.

    Rounds grow with the logarithm of the number of ends; an error after ROUNDS of them, never a half-way result.
    """
    edges = cut(links.filter("a <> b").distinct())
    for _ in range(ROUNDS):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        new = cut(small.select("e.a", "e.b").filter("a <> b").distinct())
        tell = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tell(new) == tell(edges):
            break
        edges = new
    else:
        raise RuntimeError("links didn't settle")
    return edges.select(F.col("b").alias("id"), F.col("a").alias("group")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("group")).distinct())


def text_hash(h: np.ndarray) -> int:
    """The first of the two hashes of a text's grams in their order."""
    return int(mixed(h + np.arange(len(h), dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))


def marked(ids: DataFrame, bits: int):
    """A broadcast bitmap of fixed size with the places (see _place) of the one column of ids."""
    name = ids.columns[0]
    words = ids.select(_place(F.col(name), bits).alias("h")).groupBy(F.floor(F.col("h") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(h % 64))")).alias("mask")).toArrow()
    bitmap = np.zeros(bits // 64, dtype=np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return ids.sparkSession.sparkContext.broadcast(bitmap)


def _place(ids, bits: int):
    return F.pmod(F.xxhash64(ids), F.lit(bits))


def _set_rows(docs: DataFrame, gram: int, held, bits: int) -> DataFrame:
    """doc_id, id and the distinct gram hashes of each text, sorted, as bytes; of documents whose ids the bitmap may hold."""

    @giving_back
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            place = whole.column("place").to_numpy(zero_copy_only=False)
            near = whole.filter(pa.array((held.value[place // 64] >> (place % 64)) & 1 == 1))
            for batch in slices(near, "text", SLICE_BYTES):
                h, start = shingles(batch.column("text"), gram)
                spans = list(zip(start, start[1:], strict=False))
                own = pa.array([text_hash(h[s:e]) for s, e in spans], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), own, pa.array([np.unique(h[s:e]).tobytes() for s, e in spans], pa.binary())], ["doc_id", "id", "grams"])

    doc_id = F.col("doc_id").cast("long")
    return docs.filter(doc_id.isNotNull()).select(doc_id.alias("doc_id"), _place(doc_id, bits).alias("place"), "text").mapInArrow(sets, "doc_id long, id long, grams binary")


def similar(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of exact Jaccard similarity at or over the threshold; shared grams by products of incidence parts."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    shared = np.zeros((n, n), dtype=np.float32)
    if n == 2:
        shared[0, 1] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        values, where = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(n), sizes)
        order = np.argsort(where, kind="stable")
        where, row = where[order], row[order]
        often = np.bincount(where, minlength=len(values)) > 1
        keep = often[where]
        where, row = np.cumsum(often)[where[keep]] - 1, row[keep]
        for begin in range(0, int(often.sum()), COLUMNS):
            s, e = np.searchsorted(where, [begin, begin + COLUMNS])
            part = np.zeros((n, min(COLUMNS, int(often.sum()) - begin)), dtype=np.float32)
            part[row[s:e], where[s:e] - begin] = 1
            shared += part @ part.T
    union = sizes[:, None] + sizes[None, :] - shared
    hit = np.triu(shared >= similarity * union - 1e-6 * union, 1)
    return np.nonzero(hit)


def _exact(rows: DataFrame, similarity: float) -> DataFrame:
    """For each (group, block pair): links of a forest of its similar pairs (n = 0), and each set's number of links (n > 0)."""

    @giving_back
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for df in _groups(batches, ["group", "x", "y"]):
            out = []
            df = df.drop_duplicates(["group", "x", "y", "id"])  # repeated rows of a doc_id
            ids, side, copies, grams = df["id"].to_numpy(), df["side"].to_numpy(), df["copies"].to_numpy(), df["grams"].tolist()
            for s, e in _bounds(df, ["group", "x", "y"]):
                g, part, c = ids[s:e], side[s:e], copies[s:e]
                i, j = similar([np.frombuffer(x, dtype=np.uint64) for x in grams[s:e]], similarity)
                if part.any():
                    apart = part[i] != part[j]
                    i, j = i[apart], j[apart]
                links = np.bincount(i, weights=c[j], minlength=e - s) + np.bincount(j, weights=c[i], minlength=e - s)
                out += [(min(g[x], g[y]), max(g[x], g[y]), 0) for x, y in spanning(e - s, iter([(i, j)]))]
                out += [(g[x], g[x], int(links[x])) for x in np.flatnonzero(links).tolist()]
            if out:
                a, b, n = np.array(out, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

    dealt = rows.repartition(partitions(rows.sparkSession), "group", "x", "y").sortWithinPartitions("group", "x", "y", "id")
    return dealt.mapInArrow(check, "a long, b long, n long")


def candidates(sets: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, depth: int = DEPTH, tokens: int = TOKENS, bucket: int = BUCKET) -> DataFrame:
    """Links (a < b) between sets (id, sig, short) that met in a bucket of some run and look alike by their tokens.

    Sets of the same tokens take the same paths, so one of them stands for all; the others are linked to it.
    """
    least = similarity - SLACK * math.sqrt(similarity * (1 - similarity) / tokens)
    runs = runs_for(recall, depth)
    alike = F.xxhash64("sig")
    stands = sets.groupBy(alike.alias("like"), "sig").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.max("short").alias("short"))
    stands = cut(stands)
    links = sets.join(stands.filter("n > 1").select("like", F.col("id").alias("a")), alike == F.col("like")).select("a", F.col("id").alias("b")).filter("a < b")
    own, short = stands.select("id", "sig"), stands.select("id", "short")
    at = _children(own, 0, similarity, tokens, runs)
    for level in range(1, depth + 1):
        at = cut(at)
        met = at.join(at.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"), "path")
        ended = met if level == depth else met.filter(F.col("n") <= bucket)
        links = links.unionByName(_bucket_links(in_blocks(ended, "n", bucket).join(short, "id"), least, tokens))
        if level < depth:
            at = _children(met.filter(F.col("n") > bucket).join(own, "id"), level, similarity, tokens, runs)
    return links


def join_rows(docs: DataFrame, similarity: float = SIMILARITY, gram: int = GRAM, recall: float = RECALL, depth: int = DEPTH, tokens: int = TOKENS, bucket: int = BUCKET, block: int = BLOCK, bits: int = FILTER_BITS) -> DataFrame:
    """join_documents with two more columns: row (see signature_rows) and class_set.

    class_set is one number for all rows of a class, also where unlike texts of one doc_id make several classes of one
    class_id; null for rows that have no set (null ids, texts without words).
    """
    signed = cut(signature_rows(docs, gram, tokens))
    usable = signed.filter("doc_id is not null and a is not null")
    sets = cut(usable.groupBy("a", "b").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.max("sig").alias("sig"), F.max("short").alias("short")).withColumnRenamed("a", "id"))
    groups = cut(components(candidates(sets, similarity, recall, depth, tokens, bucket)).join(sets.select("id", "copy_id", "copies"), "id"))
    sized = groups.join(groups.groupBy("group").agg(F.count("*").alias("n")), "group")
    # the grams of a text are made once, at its smallest doc_id; another text may have the same doc_id, repeated rows all
    grams = _set_rows(docs, gram, marked(groups.select("copy_id"), bits), bits).join(sized.select("id", F.col("copy_id").alias("doc_id"), "copies", "group", "n"), ["id", "doc_id"])
    checked = cut(_exact(in_blocks(grams.drop("doc_id"), "n", block), similarity))
    linked = components(checked.filter("n = 0").select("a", "b")).join(sets.select("id", "copy_id"), "id")
    classes = linked.join(linked.groupBy("group").agg(F.min("copy_id").alias("class_id")), "group").select("id", "class_id", F.col("group").alias("class_set"))
    counts = checked.filter("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    known = sets.select("id", "b", "copy_id", "copies").join(classes, "id", "left").join(counts, "id", "left")
    known = known.select(F.col("id").alias("a"), "b", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("class_set", "id").alias("class_set"))
    rows = signed.filter("doc_id is not null").select("doc_id", "row", "a", "b").join(known, ["a", "b"], "left")
    out = rows.select("doc_id", F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "row", "class_set")
    none = signed.filter("doc_id is null").select("doc_id", F.col("doc_id").alias("copy_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "row", F.lit(None).cast("long").alias("class_set"))
    return out.unionByName(none)


def join_documents(docs: DataFrame, **settings) -> DataFrame:
    """One row per row of docs: doc_id, copy_id, class_id, n_links. settings: see join_rows.

    copy_id is the smallest doc_id of the same words in the same order (case and white space aside). n_links is the
    number of other rows whose sets of word grams have a Jaccard similarity of at least the threshold; copies count, one
    by one. class_id is the smallest doc_id that such links lead to. Texts of fewer words than a gram are one gram; null
    texts and those without words have no links, and so have rows of a null id; each is a class of its own (null ids:
    null). Repeated rows are copies of each other. Extra columns are left out; an empty table gives no rows.
    """
    return join_rows(docs, **settings).select("doc_id", "copy_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """docs without near copies: of each class one row stays, the one of the smallest doc_id (then of the row's own hash).

    Rows of a null id and texts without words all stay. Of rows equal in every column one stays. Unlike texts of one
    doc_id are classes of their own, so one of each stays. Columns are those of docs.
    """
    # a row is one column, so that none of its own meets a name used here
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select("doc_id", "text", F.xxhash64(*[F.struct(F.col(f"`{c}`")) for c in docs.columns]).alias("_row"), whole.alias("_doc"))
    rows = join_rows(keyed.select("doc_id", "text", "_row"), **settings).filter("class_set is not null")
    first = rows.groupBy("class_set").agg(F.min(F.struct("doc_id", "row")).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.row").alias("_row")).distinct()
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = keyed.filter(~alone).withColumn("_id", F.col("doc_id").cast("long")).join(first, ["_id", "_row"]).dropDuplicates(["_id", "_row"])
    return kept.select("_doc.*").unionByName(docs.filter(alone))

"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate files: spark.checkpoint.dir, or where that is unset a folder in the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_between"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate files by the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from those files."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def digest(*parts: Column | str) -> Column:
    """Hex MD5 of the parts as text; null counts as the empty string."""
    cols = [F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def hex_bucket(hexed: Column, digits: int) -> Column:
    """The first hex digits as an integer: uniform in [0, 16**digits)."""
    return F.conv(F.substring(hexed, 1, digits), 16, 10).cast("long")


def digits_for(rows: int, per_bucket: int = 1 << 16) -> int:
    """Hex digits, two at least, that deal so many rows to buckets of about per_bucket rows or fewer."""
    return max(2, math.ceil(math.log(max(1, rows / per_bucket), 16)))


def running(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column | str], sums: dict[str, str], position: str | None = None) -> DataFrame:
    """Exclusive running sums (and the 0-based position) of each row in its group, without a group in one task.

    bucket must not fall when rows are put in the given order. Totals of each (group, bucket) are summed up first,
    so that a task sorts one bucket only. group and bucket hold no nulls. df is read twice: cut it before.
    sums maps new columns to the summed ones.
    """
    keys = [*group, bucket]
    counted = ({position: F.lit(1)} if position else {}) | {k: F.col(v) for k, v in sums.items()}
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(f"_{k}") for k, c in counted.items()])
    totals = totals.select(*keys, *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in counted])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(totals, keys)
    for k, c in counted.items():
        out = out.withColumn(k, (F.col(f"_{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).cast("long"))
    return out.drop(*[f"_{k}" for k in counted])


def words_of(text: Column) -> Column:
    """Number of runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def give_back() -> None:
    """What this process has freed and Arrow or the C library keep for later goes back to the system."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def giving_back(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same task; at its end, what it has freed goes back to the system.

    A Python worker stays for later tasks, also while other stages run in the JVM alone; what Arrow and the C library
    keep of a batch would count against the executor all that time.
    """

    @wraps(task)
    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        give_back()

    return run


def balanced(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task in batches of about `most` bytes of text each, whatever the batches they came in."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        for part in slices(whole, column, most):
            own = text_bytes(part, column)
            if held and size + own > most:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield pa.concat_batches(held)


def text_bytes(batch: pa.RecordBatch, column: str) -> int:
    import pyarrow.compute as pc

    return pc.sum(pc.binary_length(batch.column(column))).as_py() or 0


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about `most` bytes at most (a longer text comes alone)."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < batch.num_rows:
        yield batch.slice(begin)

"""What the operators of this subpackage share: the registry, model files, and running totals over a global order."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright.session import pin_utc, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HELD_OUT_PARTS, HELD_OUT_PART = 3, 1


def query(name: str, oracle: str | None = None):
    """Register a query under a key, with the SQL that must return the same rows where SQL can express it."""
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            pin_utc(spark)
            return fn(spark, folder.rstrip("/"))

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary_file(name: str) -> str:
    """Where a public tokenizer's file lies; executors have the same package."""
    return public_tokenizers.path(name)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept back from learning: crc32 of its id as text, by remainder."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % HELD_OUT_PARTS == HELD_OUT_PART, F.lit(False))


def draw(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone: the first 48 bits of their md5."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def bounded_sample(df: DataFrame, key: str, by: str, rows: int, seed: str) -> DataFrame:
    """About ``rows`` rows of each value of ``by`` (all of a smaller group), chosen by a hash of ``key``; no group meets in one task.

    ``by`` holds classes: the model to be learned has a column for each, so a row for each can be broadcast.
    """
    sizes = df.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(F.broadcast(sizes), F.col(by) == F.col("_by")).where(draw(F.lit(seed), F.col(key)) * F.col("_n") < rows).drop("_by", "_n")


_HELD: dict[tuple, object] = {}


def held(key: tuple, build: Callable[[], object]) -> object:
    """What a worker process keeps between tasks, such as a table of words met before: one thing at a time, so that memory stays bounded
    when operators follow each other on the same workers."""
    if key not in _HELD:
        release()
        _HELD[key] = build()
    return _HELD[key]


def release() -> None:
    """Let go of what the worker process keeps; the operating system gets back what is free."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def with_text(docs: DataFrame, keep: tuple[str, ...], text: str) -> tuple[DataFrame, int]:
    """``keep`` and the text, which comes once even if it is kept, and the text's place."""
    if text in keep:
        return docs.select(*keep), keep.index(text)
    return docs.select(*keep, F.col(text).alias("_text")), len(keep)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices with about ``most`` bytes of a text column each (one row at least), so that a worker's memory stays bounded."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def in_order(df: DataFrame, order: Sequence[str], totals: Sequence[str] = (), label: str = "order") -> DataFrame:
    """Add ``position`` (rows before this one in the order) and ``<column>_before`` for each of ``totals``.

    Rows are range-partitioned and sorted, each task adds running sums over its own rows as they
    stream by, and the tasks' totals (one row a task) give the offsets.  No key meets in one task
    unless rows agree in every order column.  The running sums are staged, so that the offsets
    belong to the very rows they are added to.  Nulls come first.  An empty table stays empty.
    """
    counted = [*totals]
    sums = ["position", *(f"{c}_before" for c in counted)]
    schema = T.StructType([*df.schema.fields, T.StructField("_block", T.IntegerType()), *(T.StructField(s, T.LongType()) for s in sums)])
    arrow_sums = [pa.field(s, pa.int64()) for s in sums]

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, before = TaskContext.get().partitionId(), [0] * len(sums)
        for batch in batches:
            if not batch.num_rows:
                continue
            values = [np.ones(batch.num_rows, np.int64), *(pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in counted)]
            added = []
            for k, v in enumerate(values):
                ends = np.cumsum(v) + before[k]
                added.append(pa.array(ends - v))
                before[k] = int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, block, np.int32)), *added],
                schema=pa.schema([*batch.schema, pa.field("_block", pa.int32()), *arrow_sums]))

    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    rows = stage(ranged.mapInArrow(running, schema), label)
    blocks = rows.groupBy("_block").agg(
        F.max(F.col("position") + 1).alias("_position"),
        *(F.max(F.col(f"{c}_before") + F.coalesce(F.col(c), F.lit(0))).alias(f"_{c}_before") for c in counted))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    offsets = blocks.select("_block", *(F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_{s}") for s in sums))
    return rows.join(F.broadcast(offsets), "_block").select(*df.columns, *((F.col(s) + F.col(f"_{s}")).alias(s) for s in sums))

"""Connected components of a large edge list, by alternating stars (Kiveris et al., "Connected Components in MapReduce and Beyond")."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.session import drop_staged, stage, stage_scope

#: So many edges at most are closed up by one task, whose memory they bound; more go through rounds of stars.
CLOSED_AT_ONCE = 100_000


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least member's index) after linking ``a`` and ``b`` element by element."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            shorter = labels[labels]
            if (shorter == labels).all():
                break
            labels = shorter


def _closed(edges: DataFrame) -> DataFrame:
    """A few edges (``CLOSED_AT_ONCE`` at most) to stars around each component's least vertex, in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.array([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
        if not found:
            return
        names, at = np.unique(np.concatenate(found, axis=1), return_inverse=True)
        u, v = at.reshape(2, -1)
        least = merge_labels(np.arange(len(names)), u, v)
        others = np.flatnonzero(least != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[others]), pa.array(names[least[others]])], names=["u", "v"])

    return edges.coalesce(1).mapInArrow(run, "u long, v long")


def _least(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each ``u``, staged so that the join back can split a vertex with many neighbours."""
    return stage(edges.groupBy("u").agg(F.min("v").alias("m")), "star_least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u``, ``v`` (longs) to one row (``u``, ``root``) per vertex that is not its component's least vertex.

    Both star steps sum before they shuffle, so a vertex with many neighbours never meets in one task.
    Rounds, each staged, go on until the edge set no longer changes; their number grows with the
    logarithm of the number of vertices.  A round's tables go when the next one has its own.  A small edge set
    takes no rounds, whose cost is that of starting their tasks then, but one task.
    """
    now, before = stage(edges.where("u <> v").select("u", "v").distinct(), "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if not mark["n"] or mark == before:
            return now.select("u", F.col("v").alias("root"))
        before = mark
        small = mark["n"] <= CLOSED_AT_ONCE
        with stage_scope(now.sparkSession) as keep:
            after = keep(stage(_closed(now) if small else _small_star(stage(_large_star(now), "large_star")), "small_star"))
        drop_staged(now)
        if small:
            return after.select("u", F.col("v").alias("root"))
        now = after

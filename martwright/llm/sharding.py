"""Sharding: the smallest capacity at which ordered atomic groups fit into a given number of contiguous shards.

Groups are equal texts, ordered by their SHA-256.  Capacity is found by binary search, each probe
checking greedily whether the groups fit.  The driver never holds the groups: it holds a grid over
the seven or so places where a cut can still fall, reads off one aggregate which group ends lie in
each cell, and searches with two step functions, the largest known end below a position and the
largest possible one.  The two answers bracket every cut; the next grid covers the brackets only.
A cell with one end is exact, so a few rounds end with the exact optimum at any number of groups.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.llm.base import in_order, query, table
from martwright.session import stage

GRID_CELLS = 512


@dataclass(frozen=True)
class Cell:
    """Group ends in one grid cell: the first and last of them, and how many there are."""

    first: int
    last: int
    ends: int


def _greedy(capacity: int, shards: int, total: int, reach: Callable[[int], int]) -> list[int]:
    """Cuts when every shard takes as much as fits; everything fits if the last one is the total."""
    cuts, at = [], 0
    for _ in range(shards):
        at = max(at, reach(at + capacity))
        cuts.append(at)
    return cuts


def _smallest(low: int, high: int, fits: Callable[[int], bool]) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def _reaches(cells: list[Cell], total: int) -> tuple[Callable[[int], int], Callable[[int], int]]:
    """The largest end at or below a position: as surely known, and at best."""
    firsts = [c.first for c in cells]

    def known(x: int) -> int:
        if x >= total:
            return total
        k = bisect.bisect_right(firsts, x) - 1
        if k < 0:
            return 0
        return cells[k].last if cells[k].last <= x else cells[k].first

    def possible(x: int) -> int:
        if x >= total:
            return total
        k = bisect.bisect_right(firsts, x) - 1
        if k < 0:
            return 0
        return cells[k].last if cells[k].last <= x else (cells[k].first if cells[k].ends <= 2 else x)

    return known, possible


def minimax_cuts(ends: DataFrame, column: str, shards: int, total: int, largest: int, cells: int = GRID_CELLS) -> list[int]:
    """Ends of the shards, as positions among the group ends in ``column``, at the smallest feasible capacity.

    ``ends`` holds one row per group with its end as a running total; ``largest`` is the largest group.
    Fewer groups than shards leave the last shards empty.  A round collects ``cells`` rows per window
    at most, whatever the number of groups.
    """
    if total <= 0:
        return [0] * shards
    windows = [(0, total)]
    low, high = max(largest, -(-total // shards)), total
    while True:
        cell = F.lit(None).cast("string")
        for number, (a, b) in enumerate(windows):
            width = -(-(b - a + 1) // cells)
            cell = F.when(F.col(column).between(a, b), F.concat(F.lit(f"{number}:"), F.floor((F.col(column) - a) / width).cast("string"))).otherwise(cell)
        grid = ends.select(column, cell.alias("cell")).where(F.col("cell").isNotNull()).groupBy("cell").agg(
            F.min(column).alias("first"), F.max(column).alias("last"), F.count(F.lit(1)).alias("ends"))
        found = sorted((Cell(r["first"], r["last"], r["ends"]) for r in grid.collect()), key=lambda c: c.first)
        # For capacities between low and high every cut lies in a window, so cells of older rounds are not needed.
        known, possible = _reaches(found, total)
        high = _smallest(low, high, lambda c: _greedy(c, shards, total, known)[-1] >= total)  # noqa: B023
        low = _smallest(low, high, lambda c: _greedy(c, shards, total, possible)[-1] >= total)  # noqa: B023
        least, most = _greedy(low, shards, total, known), _greedy(high, shards, total, possible)
        if low == high and least == most:
            return most
        windows = _joined(list(zip(least, most, strict=True)))


def _joined(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def shard_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's size, text checksum, shard and gapless slot; equal texts share a shard.

    A null text has no bytes and counts as equal to the empty one; size is bytes plus one.  Rows
    of a group are ordered by id (nulls first); repeated rows get slots of their own.  With fewer
    groups than shards the last shards stay empty; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stage(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.sha2(F.encode(body, "UTF-8"), 256).alias("digest")), "shard_rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("members"))
    ordered = in_order(groups, ["digest"], ["bytes", "members"], "shard_groups")
    ends = ordered.select("digest", (F.col("bytes_before") + F.col("bytes")).alias("end"), (F.col("members_before") + F.col("members")).alias("end_rows"))
    facts = ordered.agg(F.max(F.col("bytes_before") + F.col("bytes")).alias("total"), F.max("bytes").alias("largest")).first()
    cuts = minimax_cuts(ends, "end", shards, facts["total"] or 0, facts["largest"] or 0)
    at = {r["end"]: r for r in ends.where(F.col("end").isin(sorted(set(cuts)))).collect()}
    last = [at[c] for c in cuts if c in at]
    shard = sum(((F.col("digest") > r["digest"]).cast("int") for r in last[:-1]), F.lit(0))
    first_slot = F.lit(0).cast("long")
    for r in last[:-1]:
        first_slot = F.when(F.col("digest") > r["digest"], F.lit(r["end_rows"]).cast("long")).otherwise(first_slot)
    placed = in_order(rows, ["digest", "doc_id"], label="shard_slots")
    return placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("position") - first_slot).alias("slot"))


@query("op3_sharding")
def _(spark: SparkSession, folder: str) -> DataFrame:
    placed = shard_documents(table(spark, folder, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

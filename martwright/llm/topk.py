"""Exact top-k by inner product in three phases with one uniform threshold (Cao & Wang, "Efficient Top-K Query Calculation in Distributed Networks").

A vector's components are dealt to a few lists; each list has a partial score of every vector for a
query, and the score is the sum over the lists.

1. Every block of vectors finds the vectors with the best k partial scores of each of its lists and reports the best k
   sums of what its lists have of them.  The k-th best sum reported is one that the true k-th best can't be below.
2. That sum over the number of lists is the cutoff: a vector that is below it in every list can't reach the
   sum.  Each list collects its entries at or above it; a vector whose entries, with the cutoff for the
   lists that did not collect it, stay below the sum is dropped as well.
3. Scores of the vectors left are resolved exactly in whole numbers, and the best k kept.

Queries are a stated set.  A task holds one block of vectors, of bounded size, and all queries stream past it: vectors are
moved once a phase, queries once per block, and neither is ever sent through the driver.  A block holds its
vectors' components of all lists, so entries are collected where they arise and only final scores move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martwright.llm.base import in_order, query, table
from martwright.session import drop_staged, stage

LISTS = 2
#: Least rows of a block, blocks that a table is cut into from there on, and most components of a larger block.
BLOCK_ROWS, BLOCKS, BLOCK_CELLS = 4096, 48, 1 << 24
#: Queries that are scored at once, and scores of a list that are held at once.
QUERY_ROWS, TILE = 128, 1 << 20
K = 10

#: A function of a block of vectors and a batch of queries that gives its rows.
Work = Callable[["Block", "Asked"], pa.RecordBatch]


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``vec_id``, ``asks``, the vector's length, and its components laid end to end in the narrowest whole numbers that hold the batch's."""
    for batch in batches:
        vectors = batch.column(2)
        values, sizes = vectors.flatten().to_numpy(), pc.list_value_length(vectors).to_numpy()
        low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
        kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]) * np.dtype(kind).itemsize
        flat = pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.astype(kind))])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), flat], ["vec_id", "asks", "size", "flat"])


def against_all(vectors: DataFrame, queries: DataFrame, blocks: int, rows: int) -> DataFrame:
    """Each block of vectors, then all queries, as the rows of one partition.

    A row of the queries is repeated once per block, as an exact search in blocks must; no row of the vectors is.  Nothing is
    joined: sizes of repeated rows are underestimated, so that a join would take them for small enough to be broadcast.
    """
    own = vectors.select(F.floor(F.col("position") / rows).cast("int").alias("block"), F.lit(False).alias("asks"), "vec_id", "flat", F.lit(None).cast("long").alias("tau"))
    every = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", "flat", "tau")
    return own.unionByName(every).repartitionById(blocks, "block").sortWithinPartitions("block", "asks")


class Asked:
    """Rows of ``against_all``, queries or vectors: ids (0 where there is none), whole components, the greatest norm, and sums that queries have to reach."""

    def __init__(self, batches: list[pa.RecordBatch], d: int):
        ids, flat = (pa.chunked_array([b.column(c) for b in batches]) for c in ("vec_id", "flat"))
        self.vec_id = ids.combine_chunks()
        self.known, self.id = pc.is_valid(self.vec_id).to_numpy(zero_copy_only=False), pc.fill_null(self.vec_id, 0).to_numpy()
        self.tau = pa.chunked_array([b.column("tau") for b in batches])
        sizes = pc.binary_length(flat).to_numpy() // d
        self.whole = np.empty((len(sizes), d), f"i{sizes.max()}")
        for size in np.unique(sizes):
            these = sizes == size
            self.whole[these] = np.frombuffer(b"".join(flat.filter(pa.array(these)).to_pylist()), f"i{size}").reshape(-1, d)
        single = self.whole.astype(np.float32)
        self.norm = float(np.sqrt(np.einsum("ij,ij->i", single, single).max()))


class Block(Asked):
    """The vectors of a block, with their components of each list in the types that were asked for."""

    def __init__(self, batches: list[pa.RecordBatch], d: int, lists: list[tuple[int, int]]):
        super().__init__(batches, d)
        self.lists, self.of, self.room, self.marks = lists, {}, {}, [np.zeros(0, bool) for _ in lists]

    def scores(self, asked: Asked, rows: slice, columns: slice) -> list[np.ndarray]:
        """Each list's partial scores of some vectors for some queries, exact: no sum of products is beyond the norms' product.

        They stay until the next call, which fills the same memory.
        """
        most = 1.05 * self.norm * asked.norm
        kind = np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else np.int64
        if kind not in self.of:
            self.of[kind] = [np.ascontiguousarray(self.whole[:, x:y], kind) for x, y in self.lists]
        shape = rows.stop - rows.start, columns.stop - columns.start
        room = self.room.get(kind)
        if room is None or room.shape[1] < shape[0] * shape[1]:
            room = self.room[kind] = np.empty((len(self.lists), shape[0] * shape[1]), kind)
        return [np.matmul(asked.whole[rows, x:y].astype(kind), part[columns].T, out=to[: shape[0] * shape[1]].reshape(shape))
                for (x, y), part, to in zip(self.lists, self.of[kind], room, strict=True)]

    def marked(self, compare: np.ufunc, partial: list[np.ndarray], bounds: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of each list which scores compare with its bounds, and the places of those; the marks stay until the next call."""
        cells = partial[0].size
        if len(self.marks[0]) < cells + 8:
            self.marks = [np.zeros(cells + 8, bool) for _ in self.marks]
        for mark in self.marks:
            mark[cells : cells + 8] = False
        marks = [compare(p, b, out=mark[:cells].reshape(p.shape)) for p, b, mark in zip(partial, bounds, self.marks, strict=True)]
        return marks, [_marks(mark[: -(-cells // 8) * 8]) for mark in self.marks]

    def apart(self, asked: Asked, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Which pairs of a query and a vector are not of one id."""
        return (asked.id[rows] != self.id[columns]) | ~asked.known[rows] | ~self.known[columns]


def passing(batches: Iterator[pa.RecordBatch], d: int, lists: list[tuple[int, int]], work: Work) -> Iterator[pa.RecordBatch]:
    """Rows of ``against_all``: what the work makes of each batch of queries beside the block that came before them."""
    number, pieces, block = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])]))
        for start, end in zip(starts, [*starts[1:], len(blocks)], strict=True):
            piece = batch.slice(start, end - start)
            if number != blocks[start]:
                number, pieces, block = blocks[start], [], None
            if not asks[start]:
                pieces.append(piece)
                continue
            if block is None:
                block, pieces = Block(pieces, d, lists), []
            yield work(block, Asked([piece], d))


def _marks(mark: np.ndarray) -> np.ndarray:
    """Places of the true ones among flat marks, eight marks looked at together, since few are true."""
    eights = np.flatnonzero(mark.view(np.uint64) != 0)
    eighth, place = np.nonzero(mark.reshape(-1, 8)[eights])
    return eights[eighth] * 8 + place


def _merge(value: np.ndarray, place: np.ndarray, row: np.ndarray, score: np.ndarray, column: np.ndarray) -> None:
    """Take further scores, sorted by row, into the best of each row; of equal ones at the last place any."""
    if not len(row):
        return
    k = value.shape[1]
    start = np.flatnonzero(np.diff(row, prepend=-1))
    count = np.diff(start, append=len(row))
    changed, width = row[start], k + int(count.max())
    values, places = np.full((len(changed), width), _least(value.dtype), value.dtype), np.full((len(changed), width), -1)
    values[:, :k], places[:, :k] = value[changed], place[changed]
    at = np.repeat(np.arange(len(changed)), count), np.arange(len(row)) - np.repeat(start, count) + k
    values[at], places[at] = score, column
    best = np.argpartition(values, width - k, axis=1)[:, width - k :]
    value[changed], place[changed] = np.take_along_axis(values, best, 1), np.take_along_axis(places, best, 1)


def _least(kind: np.dtype) -> float | int:
    """What is below all scores of a type."""
    return np.iinfo(kind).min if kind.kind == "i" else -np.inf


def _first(row: np.ndarray, keys: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Places of the first k of each row's entries by the keys (the last key counts first), row after row."""
    order = np.lexsort((*keys, row))
    new = np.flatnonzero(np.diff(row[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(new, np.diff(new, append=len(order))) < k]


def _columns(n: int, first: int, most: int) -> Iterator[slice]:
    """Slices of n columns that grow to ``most``, so that few scores are met before there is a k-th best to be above."""
    start, width = 0, min(first, most)
    while start < n:
        yield slice(start, min(n, start + width))
        start, width = start + width, min(most, width * 8)


def best_sums(block: Block, asked: Asked, k: int, query_rows: int) -> pa.RecordBatch:
    """Phase one: of each query the best k sums of the vectors that are among the best k of a list."""
    ids, sums = [], []
    for at in range(0, len(asked.id), query_rows):
        rows = slice(at, min(at + query_rows, len(asked.id)))
        n = rows.stop - rows.start
        best = None
        for columns in _columns(len(block.id), 8 * k, TILE // query_rows):
            partial = block.scores(asked, rows, columns)
            best = best or [(np.full((n, k), _least(p.dtype), p.dtype), np.full((n, k), -1)) for p in partial]
            _, above = block.marked(np.greater, partial, [value.min(axis=1)[:, None] for value, _ in best])
            for p, at_list, (value, place) in zip(partial, above, best, strict=True):
                row, column = np.divmod(at_list, p.shape[1])
                apart = block.apart(asked, row + at, column + columns.start)
                _merge(value, place, row[apart], p.ravel()[at_list[apart]], column[apart] + columns.start)
        places = np.sort(np.concatenate([place for _, place in best], axis=1), axis=1)
        once = (places >= 0) & (np.diff(places, axis=1, prepend=-1) != 0)
        row, n_th = np.nonzero(once)
        total = np.einsum("ij,ij->i", asked.whole[row + at].astype(np.int64), block.whole[places[row, n_th]].astype(np.int64))
        first = _first(row, (-total,), k)
        ids.append(row[first] + at)
        sums.append(total[first])
    return pa.RecordBatch.from_arrays([asked.vec_id.take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(sums))], ["query_id", "total"])


def collected(block: Block, asked: Asked, k: int, query_rows: int) -> pa.RecordBatch:
    """Phases two and three: of each query the best k vectors that reach its sum, found among what the lists collect."""
    lists = len(block.lists)
    bounded, tau = pc.is_valid(asked.tau).to_numpy(), pc.fill_null(asked.tau, 0).to_numpy()
    cutoff = -(-tau // lists)  # partial scores are whole
    id_order = np.where(block.known, block.id, np.iinfo(np.int64).min)
    found = []
    for at in range(0, len(asked.id), query_rows):
        rows = slice(at, min(at + query_rows, len(asked.id)))
        row, column, score = (np.empty(0, np.int64) for _ in range(3))
        for columns in _columns(len(block.id), TILE // query_rows, TILE // query_rows):
            partial = block.scores(asked, rows, columns)
            lowest = np.where(bounded[rows], cutoff[rows], _least(partial[0].dtype)).astype(partial[0].dtype)[:, None]
            over, places = block.marked(np.greater_equal, partial, [lowest] * lists)
            r, c = np.divmod(np.unique(np.concatenate(places)), columns.stop - columns.start)
            has, value = [o[r, c] for o in over], [p[r, c].astype(np.int64) for p in partial]
            most = np.sum([np.where(h, v, cutoff[r + at]) for h, v in zip(has, value, strict=True)], axis=0)
            left = np.flatnonzero(((most >= tau[r + at]) | ~bounded[r + at]) & block.apart(asked, r + at, c + columns.start))
            r, c, exact = r[left], c[left], np.sum(value, axis=0)[left]
            reach = (exact >= tau[r + at]) | ~bounded[r + at]
            row, column, score = np.concatenate([row, r[reach]]), np.concatenate([column, c[reach] + columns.start]), np.concatenate([score, exact[reach]])
            if len(row) > TILE:
                first = _first(row, (id_order[column], -score), k)
                row, column, score = row[first], column[first], score[first]
        first = _first(row, (id_order[column], -score), k)
        found.append((row[first] + at, column[first], score[first]))
    row, column, score = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([asked.vec_id.take(pa.array(row)), block.vec_id.take(pa.array(column)), pa.array(score)], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = K, lists: int = LISTS, vec_id: str = "vec_id", vector: str = "embedding",
          block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k highest integer inner products of each query, ties to the smaller id.

    Components are whole numbers (as longs).  All rows but the query's own are candidates; rows that share an id are
    each other's own.  Vectors of different lengths take no part together: only the commonest length is searched.
    Fewer candidates than k give all; an empty table gives no rows.  Blocks have ``block_rows`` at least and grow with the table.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<long>").alias("vector"))
    given = rows.where(F.col("vector").isNotNull()).select("vec_id", F.coalesce(is_query, F.lit(False)).alias("asks"), "vector")
    flat = stage(given.mapInArrow(packed, "vec_id long, asks boolean, size int, flat binary"), "topk_rows")
    sizes = flat.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asked"))
    length = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if length is None or length["size"] <= 0 or not length["asked"]:
        drop_staged(flat)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d, n, lists = length["size"], length["n"], min(lists, length["size"])
    placed = in_order(flat.where(F.col("size") == d).select("vec_id", "asks", "flat"), ["vec_id"], label="topk_vectors")
    drop_staged(flat)
    block = max(block_rows, min(-(-n // BLOCKS), BLOCK_CELLS // d))
    blocks = -(-n // block)
    cuts = np.linspace(0, d, lists + 1).astype(int).tolist()
    parts = list(zip(cuts, cuts[1:], strict=False))
    asked = placed.where("asks").select("vec_id", "flat")

    def phase_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from passing(batches, d, parts, lambda b, a: best_sums(b, a, k, query_rows))

    def phases_two_and_three(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from passing(batches, d, parts, lambda b, a: collected(b, a, k, query_rows))

    no_cutoff = asked.withColumn("tau", F.lit(None).cast("long"))
    local = against_all(placed, no_cutoff, blocks, block).mapInArrow(phase_one, "query_id long, total long")
    highest = Window.partitionBy("query_id").orderBy(F.desc("total"))
    kth = local.withColumn("place", F.row_number().over(highest)).where(F.col("place") == k).select(F.col("query_id").alias("vec_id"), F.col("total").alias("tau"))
    # Fewer than k sums for a query: no cutoff, everything is collected.
    cut = stage(asked.join(stage(kth, "topk_cutoffs").hint("merge"), "vec_id", "left"), "topk_asked")
    exact = against_all(placed, cut, blocks, block).mapInArrow(phases_two_and_three, "query_id long, vec_id long, score long")
    ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_ORACLE = """
WITH rows AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scores
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""


@query("op7_exact_topk", _ORACLE)
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").where(usable(F.col("embedding")))
    whole = F.transform("embedding", lambda x: F.floor(1024 * x.cast("double")).cast("long"))
    return top_k(rows.select("vec_id", whole.alias("embedding")), F.col("vec_id") % 100 == 0)

"""Approximate nearest neighbours by largest inner product: inverted lists scanned dimension by dimension.

One more component turns the largest inner product into the smallest distance.  Vectors are rotated at
random, so that the distance over the first columns estimates the whole (Gao & Long, "High-Dimensional
Approximate Nearest Neighbor Search: with Reliable and Efficient Distance Comparison Operations"), and lie
in column blocks.  In each probed list a query first measures a few vectors in full; the others are followed
block by block, and one is abandoned once a test says that its distance, judged by the columns so far,
exceeds the k-th best.  Survivors get their exact inner product of original vectors.  The nearest lists are
searched first; what their k-th best is worth goes with the query to the others.

Centroids are fitted on a bounded sample; every row is indexed.  The number of lists to probe is the
smallest that reaches the wanted recall in the sample.  Long lists are dealt out in parts of bounded size,
and so are the queries that probe them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martwright.llm.base import draw, query, table
from martwright.llm.topk import usable
from martwright.session import stage

K = 20
#: Rows of a list on average, and the most lists; rows the centroids are fitted on, and rounds.
LIST_ROWS, MOST_LISTS, SAMPLE_ROWS, ROUNDS = 512, 1024, 20_000, 8
RECALL, TUNING_QUERIES = 0.97, 200
#: Rows of a part of a list, and queries that meet it at once.
PART_ROWS, QUERY_ROWS = 1024, 256
#: Columns of a block, candidates measured in full first, and the width of the test in standard deviations.
BLOCK_COLUMNS, FIRST_ROWS, DEVIATIONS = 16, 64, 2.1
#: Nearest lists a query searches before the others are told its k-th best; share of pairs (one in so many) below which pairs are taken singly.
FIRST_LISTS, DENSE_SHARE = 8, 8
SEED = 11


@dataclass(frozen=True)
class Index:
    """The rotation, the largest norm, the centroids (rotated), and how many lists a query probes."""

    rotation: np.ndarray
    largest: float
    centroids: np.ndarray
    probes: int

    def rotate(self, x: np.ndarray, as_query: bool = False) -> np.ndarray:
        """Vectors with the component that makes all norms equal (0 for a query), rotated."""
        more = np.zeros(len(x)) if as_query else np.sqrt(np.maximum(self.largest**2 - (x * x).sum(axis=1), 0.0))
        return np.column_stack([x, more]) @ self.rotation

    def distances(self, rotated: np.ndarray) -> np.ndarray:
        """Squared distance to each centroid, but for a term that is the same for all of them."""
        return (self.centroids**2).sum(axis=1) - 2.0 * (rotated @ self.centroids.T)


def build(sample: np.ndarray, largest: float, lists: int, k: int = K, recall: float = RECALL) -> Index:
    """Fit centroids on sample vectors and find how many lists hold ``recall`` of the k nearest in the sample."""
    rng = np.random.default_rng(SEED)
    rotation, _ = np.linalg.qr(rng.normal(size=(sample.shape[1] + 1,) * 2))
    index = Index(rotation, largest, np.zeros((1, sample.shape[1] + 1)), 1)
    rows = index.rotate(sample)
    centroids = np.unique(rows, axis=0)
    centroids = centroids[rng.permutation(len(centroids))[:lists]]
    for _ in range(ROUNDS if len(centroids) > 1 else 0):
        of = Index(rotation, largest, centroids, 1).distances(rows).argmin(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, rows)
        n = np.bincount(of, minlength=len(centroids))
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    index = Index(rotation, largest, centroids, 1)
    asked = rng.permutation(len(sample))[:TUNING_QUERIES]
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, max(len(sample) - 1, 1))]
    of = index.distances(rows).argmin(axis=1)
    rank = index.distances(index.rotate(sample[asked], True)).argsort(axis=1).argsort(axis=1)
    needed = np.take_along_axis(rank, of[near], axis=1) + 1
    return Index(rotation, largest, centroids, int(np.quantile(needed, recall, method="higher")) if needed.size else 1)


def scan(queries: np.ndarray, rows: np.ndarray, barred: np.ndarray, k: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Query and row numbers of the pairs that were not abandoned, the k nearest of each query and ties.

    All vectors are rotated; ``barred`` pairs are out; ``limit`` holds a squared distance per query beyond which nothing is
    wanted.  While many pairs are left a block's distances are one matrix product, then they are taken pair by pair.
    """
    size, first = rows.shape[1], min(len(rows), FIRST_ROWS)
    limit = np.full(len(queries), np.inf) if limit is None else limit

    def block(a: int, b: int, upto: int) -> np.ndarray:
        left, right = queries[:, a:b], rows[:upto, a:b]
        return (left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1)[None, :] - 2.0 * (left @ right.T)

    if first >= k:
        whole = np.where(barred[:, :first], np.inf, block(0, size, first))
        limit = np.minimum(limit, np.partition(whole, k - 1, axis=1)[:, k - 1])
    alive, partial, sparse = ~barred, np.zeros((len(queries), len(rows))), None
    for a in range(0, size, BLOCK_COLUMNS):
        b = min(size, a + BLOCK_COLUMNS)
        # At the last column the test is the comparison itself; rounding gets some room.
        slack = (b / size) * (1.0 + DEVIATIONS / np.sqrt(b)) ** 2 if b < size else 1.0 + 1e-9
        if sparse is None and alive.sum() * DENSE_SHARE < alive.size:
            q, c = np.nonzero(alive)
            sparse = (q, c, partial[q, c])
        if sparse is None:
            partial += block(a, b, len(rows))
            alive &= partial <= (limit * slack + 1e-9)[:, None]
        else:
            q, c, seen = sparse
            seen = seen + ((queries[q, a:b] - rows[c, a:b]) ** 2).sum(axis=1)
            stay = seen <= limit[q] * slack + 1e-9
            sparse = (q[stay], c[stay], seen[stay])
    if sparse is None:
        q, c = np.nonzero(alive)
        sparse = (q, c, partial[q, c])
    q, c, seen = sparse
    order = np.lexsort((seen, q))
    q, c, seen = q[order], c[order], seen[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    worst = np.full(len(queries), np.inf)
    worst[q[place == k - 1]] = seen[place == k - 1]
    stay = seen <= worst[q] * (1.0 + 1e-9) + 1e-9
    return q[stay], c[stay]


def nearest(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: about the k largest inner products of each query, ties to the smaller id.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors of another than the
    commonest length.  A query's own id is no candidate.  With k candidates or fewer all are given; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score double"
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    rows = vectors.where(usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = rows.where(F.exists("x", lambda v: v != 0))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("largest")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], out_schema)
    rows = rows.where(F.size("x") == lengths["d"])
    lists = int(min(MOST_LISTS, max(1, lengths["n"] // LIST_ROWS)))
    sampled = rows.where(draw(F.lit("ann"), F.col("vec_id")) * lengths["n"] < SAMPLE_ROWS).select("vec_id", "x").toPandas().sort_values("vec_id")
    sample = np.array(sampled["x"].to_list()).reshape(-1, lengths["d"])
    index = build(sample, lengths["largest"], lists, k, recall) if len(sample) else build(np.zeros((1, lengths["d"])), lengths["largest"], 1, k, recall)
    sent = spark.sparkContext.broadcast(index)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                rotated = sent.value.rotate(np.stack(frame["x"].to_list()))
                yield frame.assign(rotated=list(rotated), list=sent.value.distances(rotated).argmin(axis=1))

    indexed = stage(rows.mapInPandas(assign, "vec_id long, x array<double>, asked boolean, rotated array<double>, list long"), "ann_index")
    sizes = stage(indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n")), "ann_sizes")  # a row a list, MOST_LISTS at most
    held = {r["list"]: r["n"] for r in sizes.collect()}
    counts = np.array([held.get(n, 0) for n in range(len(index.centroids))])

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                rotated = sent.value.rotate(np.stack(frame["x"].to_list()), True)
                order = sent.value.distances(rotated).argsort(axis=1)
                enough = (np.cumsum(counts[order], axis=1) <= k).sum(axis=1) + 1  # lists that hold more than k rows
                use = np.minimum(np.maximum(enough, sent.value.probes), order.shape[1])
                first = np.minimum(np.maximum(enough, FIRST_LISTS), use)
                yield pd.DataFrame({"query_id": frame["vec_id"], "q": frame["x"], "q_rotated": list(rotated), "near": [o[:n] for o, n in zip(order, first, strict=True)],
                                    "far": [o[n:m] for o, n, m in zip(order, first, use, strict=True)]})

    asked = stage(indexed.where("asked").select("vec_id", "x").mapInPandas(probe, "query_id long, q array<double>, q_rotated array<double>, near array<long>, far array<long>"), "ann_queries")
    near = stage(_search(indexed, asked.select("query_id", "q", "q_rotated", "near", F.lit(None).cast("double").alias("tau")), "near", sizes, index.largest, k), "ann_near")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    kth = near.withColumn("place", place).where(F.col("place") == k).select("query_id", F.col("score").alias("tau"))
    told = stage(asked.join(kth, "query_id", "left").select("query_id", "q", "q_rotated", "far", "tau"), "ann_told")
    found = near.unionByName(_search(indexed, told, "far", sizes, index.largest, k))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(indexed: DataFrame, asked: DataFrame, lists: str, sizes: DataFrame, largest: float, k: int) -> DataFrame:
    """The k best of each part of each list in ``lists`` that are not below the query's ``tau``."""
    probing = asked.select(F.explode(lists).alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("m"))
    parts = stage(sizes.join(probing, "list").select(
        "list", F.ceil(F.col("n") / PART_ROWS).cast("long").alias("parts"), F.ceil(F.col("m") / QUERY_ROWS).cast("long").alias("q_parts")), "ann_parts")

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = indexed.select("vec_id", "x", "rotated", "list").join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).withColumn("q_part", each("q_parts"))
    right = asked.select("query_id", "q", "q_rotated", "tau", F.explode(lists).alias("list")).join(F.broadcast(parts), "list").withColumn(
        "q_part", F.pmod(F.xxhash64("query_id"), F.col("q_parts"))).withColumn("part", each("parts"))
    key = ["list", "part", "q_part"]

    def search(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        candidates = candidates.sort_values("vec_id")
        ids, query_ids = candidates["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        q, c = np.stack(queries["q"].to_list()), np.stack(candidates["x"].to_list())
        tau = queries["tau"].to_numpy(float)
        limit = np.where(np.isnan(tau), np.inf, (largest**2 + (q * q).sum(axis=1) - 2.0 * tau) * (1.0 + 1e-9) + 1e-9)
        q_at, c_at = scan(np.stack(queries["q_rotated"].to_list()), np.stack(candidates["rotated"].to_list()), query_ids[:, None] == ids[None, :], k, limit)
        score = (q[q_at] * c[c_at]).sum(axis=1)
        order = np.lexsort((ids[c_at], -score, q_at))
        q_at, c_at, score = q_at[order], c_at[order], score[order]
        keep = (np.arange(len(q_at)) - np.searchsorted(q_at, q_at) < k) & ~(score < tau[q_at])
        return pd.DataFrame({"query_id": query_ids[q_at[keep]], "vec_id": ids[c_at[keep]], "score": score[keep]})

    return left.select(*key, "vec_id", "x", "rotated").groupBy(*key).cogroup(right.select(*key, "query_id", "q", "q_rotated", "tau").groupBy(*key)).applyInPandas(
        search, "query_id long, vec_id long, score double")


@query("op5_ann")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)

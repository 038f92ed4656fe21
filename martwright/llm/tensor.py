"""MinHash near-duplicates by tensored banding, confirmed on full sets of shingles.

A text is the set of its shingles; texts with one set are one vertex.  Two small collections of half bands are drawn
from few minimal hashes, and a table key is a pair of half bands, one of each collection: with m half bands of q hashes in
each, m * m tables of 2q hashes cost 2mq minimal hashes instead of 2qm².  Two sets of similarity s miss all tables with
probability about 2(1 - s^q)^m.  Only half bands that another set has too are paired up.

Members of a bucket are compared with one of them, the one that shares most half bands with others, then with a second one.
What is still apart in a bucket is settled by prefixes instead of pairs: with shingles in order of rarity, two similar sets
share one of their first few, so sets that only share a common passage never meet.  Pairs pass bounds on sizes
and on agreeing half bands before any set moves, and a link counts only when the full sets confirm it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright.llm import simhash
from martwright.llm.base import held, query, slices, table
from martwright.llm.components import components
from martwright.session import drop_staged, stage, stage_scope

SEED = 42
#: Of the query: words of a shingle, least similarity in hundredths, hashes of a half band, half bands of a collection.
SHINGLE_WORDS, LEAST_PERCENT, HALF_ROWS, HALVES = 3, 85, 3, 14
#: A pair with fewer agreeing half bands than a linked pair has but with this probability is not compared.
SLIP = 1e-6
#: Rounds in which a bucket's members are compared with one member: of table buckets, of prefix buckets.
STARS, PREFIX_STARS = 2, 3
WORDS_HELD = 200_000
#: Shingles of a set are counted by so many cells of their hashes; two sets share no more than their cells' lesser counts.
CELLS = 64
#: Members of a bucket that are left to be paired are dealt out by so many, to so many tasks at most, each of which sees the bucket whole.
SALT_ROWS, SALTS = 256, 16
SHINGLES_AT_ONCE = 1024
BYTES_AT_ONCE = 8_000_000
#: An odd factor one less than a multiple of four, so that differences between places lose one bit at most.
_PLACE = np.uint64(0x9E3779B97F4A7C17)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _WordHashes(dict):
    """XXH64 of words met before, a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the results depends on all bits of the arguments; equal only if the arguments are."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, words_each: int) -> np.ndarray:
    """Hashes of a text's distinct shingles in ascending order; fewer words are one shingle, none are none."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII blanks only
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(held(("words",), _WordHashes).__getitem__, words), np.uint64, len(words))
    places = min(words_each, len(words))
    many = len(words) - places + 1
    hashes = np.full(many, places, np.uint64)
    for k in range(places):
        hashes = hashes * _PLACE + codes[k : k + many]
    return np.unique(_mixed(hashes))


def minimal_hashes(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set."""
    low, high = hashes.astype(np.uint32)[:, None], (hashes >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(factors.shape[1], (1 << 32) - 1, np.uint32)
    for at in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = low[at : at + SHINGLES_AT_ONCE] * factors[0]
        part += high[at : at + SHINGLES_AT_ONCE] * factors[1]
        np.minimum(least, part.min(axis=0), out=least)
    return least


def half_bands(least: np.ndarray, rows: int) -> np.ndarray:
    """A row of minimal hashes per set to a row of half bands, each a hash of its minimal hashes and its place."""
    grouped = least.reshape(len(least), -1, rows).astype(np.uint64)
    value = np.broadcast_to(np.arange(1, grouped.shape[1] + 1, dtype=np.uint64), grouped.shape[:2])
    for k in range(rows):
        value = _mixed(value * _PLACE + grouped[:, :, k])
    return value.view(np.int64)


def signatures(docs: DataFrame, text: str, doc_id: str, words_each: int, half_rows: int, halves: int, marked: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``text_key``, ``row_key`` (unique in this staged table), ``digest`` of the set, ``n_shingles``, ``halves``
    (both collections, empty without words) and ``fingerprint``, the SimHash of operator 9 (repeated shingles included) where ``marked`` asks for it, else null."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], rows.schema["text_key"], T.StructField("row_key", T.LongType()), T.StructField("digest", T.BinaryType()),
                           T.StructField("n_shingles", T.LongType()), T.StructField("halves", T.ArrayType(T.LongType())), T.StructField("fingerprint", T.LongType())])
    factors = np.random.default_rng(SEED).integers(0, 1 << 32, (2, 2 * halves * half_rows), dtype=np.uint32) | np.uint32(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 2, BYTES_AT_ONCE):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            sets = [shingle_set(t or b"", words_each) for t in texts]
            prints = np.array([simhash.fingerprint(t or b"", words_each) for t in texts], "<u8").view("<i8") if marked else [None] * len(sets)
            least = np.array([minimal_hashes(s, factors) for s in sets])
            bands = [row if len(s) else row[:0] for s, row in zip(sets, half_bands(least, half_rows), strict=True)]
            keys = np.arange(at, at + len(sets), dtype=np.int64)
            at += len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys), pa.array([xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(prints, pa.int64())], names=schema.names)

    return stage(rows.mapInArrow(run, schema), "signatures")


def _sets_of(members: DataFrame, docs: DataFrame, text: str, doc_id: str, words_each: int) -> DataFrame:
    """``members`` (``code``, ``digest``, ``doc_id``, ``text_key`` of one document each) with their ``set``, made anew from that document's text."""
    wanted = members.select(F.col("text_key").alias("_key"), F.col("doc_id").alias("_id"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    texts = texts.join(wanted, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, BYTES_AT_ONCE):
            sets = [shingle_set(t or b"", words_each) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets], pa.binary()),
                                              pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                                              pa.array([np.bincount((s % np.uint64(CELLS)).astype(np.int64), minlength=CELLS) for s in sets], pa.list_(pa.int64()))], names=["digest", "set", "cells"])

    # A repeated row gives its set again: one of each.
    sets = texts.mapInArrow(run, "digest binary, set array<long>, cells array<long>").dropDuplicates(["digest"])
    return stage(members.select("code", "digest", "n", "halves").join(sets, "digest").drop("digest"), "sets")


def least_agreement(percent: int, half_rows: int, halves: int) -> int:
    """The most agreeing half bands that a pair of the least similarity falls short of with a probability below ``SLIP``."""
    p, many, below = (percent / 100) ** half_rows, 2 * halves, 0.0
    for k in range(many):
        below += comb(many, k) * p**k * (1 - p) ** (many - k)
        if below >= SLIP:
            return k
    return many


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, agree: int) -> DataFrame:
    """Those of the pairs (``u``, ``v``) whose sets have the similarity, as edges."""
    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("code").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    near = pairs.join(side("u", "n", "halves", "cells"), "u").join(side("v", "n", "halves", "cells"), "v").where(_sizes_fit(percent) & (_agreeing() >= agree) & _cells_fit(percent)).select("u", "v", "n_u", "n_v")
    both = F.size(F.array_intersect("set_u", "set_v"))
    sure = stage(near, "near_pairs").join(side("u", "set"), "u").join(side("v", "set"), "v").withColumn("both", both)
    return stage(sure.where(100 * F.col("both") >= percent * (F.col("n_u") + F.col("n_v") - F.col("both"))).select("u", "v"), "confirmed")


def _agreeing() -> Column:
    return F.aggregate(F.zip_with("halves_u", "halves_v", lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, b: a + b)


def _cells_fit(percent: int) -> Column:
    """Whether two sets may share enough by their counts per cell; never false for a linked pair."""
    shared = F.aggregate(F.zip_with("cells_u", "cells_v", lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda a, b: a + b)
    return shared * (100 + percent) >= percent * (F.col("n_u") + F.col("n_v"))


def _sizes_fit(percent: int) -> Column:
    return 100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")


def _merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Components grown by new edges: ``code``, ``root`` of every code that is not its component's least."""
    if edges.isEmpty():
        return roots

    def at(column: str) -> DataFrame:
        return roots.select(F.col("code").alias(column), F.col("root").alias(f"root_{column}"))

    lifted = edges.join(at("u"), "u", "left").join(at("v"), "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
    grown = components(lifted)
    moved = roots.join(grown.select(F.col("u").alias("root"), F.col("root").alias("next")), "root", "left").select("code", F.coalesce("next", "root").alias("root"))
    return stage(moved.union(grown.select(F.col("u").alias("code"), "root")), "roots")


def _one_of_each(rows: DataFrame, label: str, first: str = "key") -> DataFrame:
    """Buckets (``key``, ``code``, ``score``) with two members or more; of buckets with the same members the one that is least by ``first`` (the same in a bucket) and key."""
    held_by = rows.groupBy("key").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("code")).alias("x"), F.min("code").alias("a"), F.max("code").alias("b"))
    keys = stage(held_by.where("n > 1").groupBy("n", "x", "a", "b").agg(F.min(F.struct("first", "key")).alias("least")).select("least.key"), f"{label}_keys")
    return stage(rows.join(keys, "key").select("key", "code", "score"), label)


def _open_rows(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one component, with ``root``."""
    placed = buckets.join(roots, "code", "left").select("key", "code", "score", F.coalesce("root", "code").alias("root"))
    apart = stage(placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key"), "apart")
    return stage(placed.join(apart, "key"), "open_rows")


def _star_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Each member of a bucket with its head: the member that shares most at first, later another that shares much."""
    first = F.col("score") * (1 - min(turn, 1) * F.pmod(F.xxhash64("code", F.lit(turn)), F.lit(1024)) / 4096)
    heads = stage(rows.groupBy("key").agg(F.max(F.struct(first.alias("first"), "score", "code", "root")).alias("m")).select("key", F.col("m.code").alias("head"), F.col("m.root").alias("head_root")), "heads")
    pairs = rows.join(heads, "key").where("root <> head_root")
    return stage(pairs.select(F.least("code", "head").alias("u"), F.greatest("code", "head").alias("v")).distinct(), "star_pairs")


def _starred(rows: DataFrame, roots: DataFrame, turns: int, sets: DataFrame, percent: int, agree: int) -> tuple[DataFrame, DataFrame]:
    """Open rows and components after so many rounds of comparing members with a head; those given go with the round that replaces them."""
    for turn in range(turns):
        if rows.isEmpty():
            break
        with stage_scope(rows.sparkSession) as keep:
            merged = keep(_merged(roots, _confirmed(_star_pairs(rows, turn), sets, percent, agree)))
            opened = keep(_open_rows(rows.drop("root"), merged))
        for given, now in ((roots, merged), (rows, opened)):
            if now is not given:
                drop_staged(given)
        rows, roots = opened, merged
    return rows, roots


def _prefix_buckets(rows: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Buckets by shingle over the members of open buckets: each member under its rarest shingles, so many that two similar sets share one;
    and ``code``, ``own``, ``prefix``: how many shingles a member has that no other has, and the rarest of its others in order.

    A member's own shingles count among the rarest but need no bucket.
    """
    members = stage(rows.groupBy("code").agg(F.max("score").alias("score")), "open_members")
    each = sets.join(members, "code").select("code", "score", "n", F.explode("set").alias("key"))
    often = stage(each.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    common = each.join(often, "key").groupBy("code", "score", "n").agg(F.collect_list(F.struct("often", "key")).alias("common"))
    own = F.col("n") - F.size("common")
    # The prefix has n - ceil(n * percent / 100) + 1 shingles, of which the member's own come first.
    most = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1 - own
    cut = stage(common.where(most > 0).select("code", "score", own.alias("own"), F.slice(F.array_sort("common"), 1, F.greatest(most, F.lit(0)).cast("int")).alias("prefix")), "prefixes")
    each = cut.select("code", "score", F.explode("prefix").alias("at")).select("code", "score", "at.often", "at.key")
    return _one_of_each(each, "prefix_buckets", "often"), cut.select("code", "own", F.col("prefix.key").alias("prefix"))


def _rest(rows: DataFrame, owned: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket that are still apart and that neither places in the order of rarity, shingles of their own nor counts per cell tell to be too different.

    A pair is made in the bucket of the rarest shingle of both prefixes alone, however many more they share: of buckets with the
    same members the rarest is the one kept, so that bucket is there for every similar pair.
    """
    place = F.array_position("prefix", F.col("key")).cast("int")
    fit = stage(rows.join(owned, "code").join(sets.select("code", "n", "cells"), "code").select(
        "key", "code", "root", "n", "own", "cells", (F.col("own") + place - 1).alias("at"), F.slice("prefix", 1, place - 1).alias("rarer")), "rest_rows")
    salts = stage(fit.groupBy("key").agg(F.least(F.lit(SALTS), 1 + F.floor(F.count(F.lit(1)) / SALT_ROWS)).cast("int").alias("salts")), "salts")
    dealt = fit.join(salts, "key")
    left, right = (dealt.select("key", "salts", *(F.col(c).alias(f"{c}_{side}") for c in ("code", "root", "n", "own", "cells", "at", "rarer"))) for side in "uv")
    left = left.withColumn("salt", F.pmod(F.xxhash64("code_u"), F.col("salts")).cast("int")).drop("salts")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    # What one has alone is not in the other: it bounds the intersection and adds to the union.
    both = F.least(F.col("n_u") - F.col("own_u"), F.col("n_v") - F.col("own_v"))
    every = F.greatest(F.col("n_u") + F.col("own_v"), F.col("n_v") + F.col("own_u"))
    # Of what is rarer than the rarest shingle of both they share nothing.
    behind = F.least(F.col("n_u") - F.col("at_u"), F.col("n_v") - F.col("at_v"))
    near = (F.col("root_u") < F.col("root_v")) & (100 * both >= percent * every) & (behind * (100 + percent) >= percent * (F.col("n_u") + F.col("n_v")))
    near = near & _cells_fit(percent) & ~F.arrays_overlap("rarer_u", "rarer_v")
    same = (left["key"] == right["key"]) & (left["salt"] == right["salt"])
    return stage(left.join(right, same & near).select(F.least("code_u", "code_v").alias("u"), F.greatest("code_u", "code_v").alias("v")), "rest")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words_each: int = SHINGLE_WORDS, percent: int = LEAST_PERCENT,
                    half_rows: int = HALF_ROWS, halves: int = HALVES, fingerprints_first: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``text_key`` (a hash of the text), ``n_shingles``, ``root`` (the same for all of a component) and ``component_id``, its smallest id.

    Documents link when 100 * |intersection| >= percent * |union| of their sets.  Null, empty and blank texts have no
    shingles and link with nothing (``root`` is null, ``component_id`` is their own id).  Repeated rows are rows of one
    component; null ids are passed over for ``component_id``, which is null where a component has no other.  Ties play no part,
    an empty table gives none, and other columns are not looked at, whatever their names.

    ``fingerprints_first`` puts documents into the groups of operator 9 first (fingerprints within three bits through the Gray-order index,
    merged by stars).  A group is one more bucket: every similar pair inside is found, and links only where full sets confirm it.
    """
    with stage_scope(docs.sparkSession):
        marked = signatures(docs, text, doc_id, words_each, half_rows, halves, fingerprints_first)
        one = F.min(F.struct("row_key", "doc_id", "text_key", F.col("n_shingles").alias("n"), "halves", "fingerprint"))
        codes = stage(marked.where("n_shingles > 0").groupBy("digest").agg(one.alias("m")).select(
            F.col("m.row_key").alias("code"), "digest", "m.doc_id", "m.text_key", "m.n", "m.halves", "m.fingerprint"), "codes")

        every = codes.select("code", F.posexplode("halves").alias("place", "key"))
        shared = stage(every.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "shared_halves")
        joined = every.join(shared, "key").groupBy("code").agg(
            F.collect_list(F.when(F.col("place") < halves, F.col("key"))).alias("a"), F.collect_list(F.when(F.col("place") >= halves, F.col("key"))).alias("b"),
            F.sum("often").alias("score")).where("size(a) > 0 and size(b) > 0")
        shares = stage(joined, "shared_by_code")
        paired = shares.select("code", "score", F.explode(F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))).alias("key"))
        buckets = _one_of_each(paired, "buckets")
        candidates = buckets.select("code").distinct()

        groups = None
        if fingerprints_first:
            groups = _fingerprint_groups(codes, shares)
            candidates = candidates.union(groups.select("code")).distinct()
        members = stage(codes.join(candidates, "code", "left_semi"), "members")
        sets = _sets_of(members, docs, text, doc_id, words_each)

        agree = least_agreement(percent, half_rows, halves)
        roots = codes.select("code", F.col("code").alias("root")).limit(0)
        if groups is not None:
            done, roots = _starred(_open_rows(groups, roots), roots, STARS, sets, percent, agree)
            drop_staged(done)
            buckets = buckets.union(groups)
        rows, roots = _starred(_open_rows(buckets, roots), roots, STARS, sets, percent, agree)
        if not rows.isEmpty():
            by_prefix, owned = _prefix_buckets(rows, sets, percent)
            rows, roots = _starred(_open_rows(by_prefix, roots), roots, PREFIX_STARS, sets, percent, agree)
            if not rows.isEmpty():
                roots = _merged(roots, _confirmed(_rest(rows, owned, sets, percent), sets, percent, agree))

        rooted = stage(codes.select("digest", "code").join(roots, "code", "left").select("digest", F.coalesce("root", "code").alias("root")), "rooted")
        placed = stage(marked.select("doc_id", "text_key", "n_shingles", "digest").join(rooted, "digest", "left").drop("digest"), "placed_rows")
        least = stage(placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
        found = placed.join(least, "root", "left").select("doc_id", "text_key", "n_shingles", "root", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
        return stage(found, "near_duplicates", outlive=True)


def _fingerprint_groups(codes: DataFrame, shares: DataFrame) -> DataFrame:
    """Groups of operator 9 with two codes or more, as buckets (``key``, ``code``, ``score``): all that a chain of fingerprints within three bits ties."""
    with stage_scope(codes.sparkSession) as keep:
        found = simhash.near_duplicates(codes.select("code", "fingerprint"), "code")
        score = F.coalesce("score", F.lit(0)) + 1
        rows = codes.select("code", "fingerprint").join(found, "fingerprint").join(shares.select("code", "score"), "code", "left")
        return keep(_one_of_each(rows.select(F.xxhash64(F.lit("fingerprints"), "root").alias("key"), "code", score.alias("score")), "fingerprint_groups"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT u, v FROM met JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT reach.u, edge.v FROM reach JOIN edge ON edge.u = reach.v),
least AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least.m, d.doc_id) AS component_id, coalesce(least.m, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.u = d.doc_id"""


@query("op13_minhash", ORACLE)
def _(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))

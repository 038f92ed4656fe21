"""SimHash near-duplicates through a hierarchical index over fingerprints in Gray order.

Fingerprints of all documents reduce to distinct ones.  Two that differ in three bits or fewer agree in
one of four 16-bit segments, so each goes to four buckets; a bucket with very many is dealt out once
more by four segments of the bits left, and again.  In a bucket fingerprints are sorted by Gray rank,
where neighbours share long patterns; runs of neighbours become nodes that keep the bits all below
agree on, runs of nodes become upper nodes.  The bucket is joined with itself from the root down: a pair
of nodes whose shared bits already differ in more than three places is dropped with everything below.
Links found reduce to a star per local group at once, and alternating stars merge the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright.llm.base import query, release, slices, table, with_text
from martwright.llm.components import components, merge_labels
from martwright.session import stage

HASH_SEED = 42
SHINGLE_WORDS = 3
MOST_BITS = 3
SEGMENTS = MOST_BITS + 1
#: A bucket with more distinct fingerprints than this is dealt out again by the bits that are left.
BUCKET_ROWS = 4096
DEALS = 3
#: Children of an index node, groups large enough to be skipped as a whole, and node pairs expanded at once.
FAN, LARGE_GROUP, PAIRS_AT_ONCE = 8, 64, 200_000
BATCH_ROWS = 200_000
BYTES_AT_ONCE = 8_000_000


def shingle_hashes(text: bytes, words_each: int = SHINGLE_WORDS) -> np.ndarray:
    """Hash of each run of so many words (one of all words if there are fewer); none without words."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII blanks only
    if not words:
        return np.empty(0, "<u8")
    shingles = map(b" ".join, zip(*(words[k:] for k in range(words_each)), strict=False)) if len(words) >= words_each else [b" ".join(words)]
    return np.array([xxhash.xxh64_intdigest(s, HASH_SEED) for s in shingles], "<u8")


def fingerprint(text: bytes, words_each: int = SHINGLE_WORDS) -> int:
    """SimHash of a text: a bit is 1 if it is 1 in more than half of the shingles' hashes; 0 without words."""
    hashes = shingle_hashes(text, words_each)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words_each: int = SHINGLE_WORDS) -> DataFrame:
    """``keep`` with ``row_key`` (unique within this staged table) and ``fingerprint`` (the 64 bits as a long).

    A null text has no words.
    """
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("row_key", T.LongType()), T.StructField("fingerprint", T.LongType())])
    rows, place = with_text(docs, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        at = TaskContext.get().partitionId() << 40
        for batch in slices(batches, place, BYTES_AT_ONCE):
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            codes = np.array([fingerprint(t or b"", words_each) for t in texts], "<u8").view("<i8")
            keys = np.arange(at, at + len(texts), dtype=np.int64)
            at += len(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(keys), pa.array(codes)], names=[*keep, "row_key", "fingerprint"])

    return stage(rows.mapInArrow(run, schema), "fingerprints")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the sequence of Gray codes."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _runs(*columns: np.ndarray) -> np.ndarray:
    """True where a row begins a new combination of values."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _nodes(new: np.ndarray, fan: int) -> np.ndarray:
    """First rows of runs of up to ``fan`` rows that don't cross a new combination."""
    index = np.arange(len(new))
    start = np.maximum.accumulate(np.where(new, index, 0))
    return np.flatnonzero((index - start) % fan == 0)


def bucket_groups(keys: np.ndarray, codes: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """For each code the index of a representative of its group, codes linking within their bucket only.

    ``keys`` says which bucket a code is in; buckets may come in any number and order.  Every pair of a
    bucket that differs in ``most`` bits or fewer ends up in one group.
    """
    n = len(codes)
    labels = np.arange(n)
    # Neighbours in Gray order, in the order of the codes turned by a quarter, and so on: dense groups close up early.
    for turn in (0, 16, 32, 48):
        turned = codes if not turn else (codes << np.uint64(turn)) | (codes >> np.uint64(64 - turn))
        order = np.lexsort((gray_rank(turned), keys))
        a, b = order[:-1], order[1:]
        near = (keys[a] == keys[b]) & (np.bitwise_count(codes[a] ^ codes[b]) <= most)
        labels = merge_labels(labels, a[near], b[near])
    sizes = np.bincount(labels, minlength=n)
    group = np.where(sizes[labels] >= LARGE_GROUP, labels, -1)
    order = np.lexsort((gray_rank(codes), group, keys))
    key, code, group = keys[order], codes[order], group[order]
    # Levels of nodes, leaves first: bits all members have, bits any has, the large group all are in, and where children begin.
    levels = [(code, code, group, None)]
    key_at = key
    while _runs(key_at).sum() < len(key_at):
        both, either, grp, _ = levels[-1]
        within = _runs(key_at, grp)
        first = _nodes(within, FAN)
        if len(first) == len(key_at):  # only nodes of different large groups are left beside each other
            first = _nodes(_runs(key_at), FAN)
        ends = np.append(first[1:], len(key_at))
        same = np.minimum.reduceat(grp, first) == np.maximum.reduceat(grp, first)
        levels.append((np.bitwise_and.reduceat(both, first), np.bitwise_or.reduceat(either, first), np.where(same, grp[first], -1), (first, ends)))
        key_at = key_at[first]
    roots = np.arange(len(key_at))
    todo = [(len(levels) - 1, roots, roots)]
    while todo:
        level, a, b = todo.pop()
        if len(a) > PAIRS_AT_ONCE:
            todo += [(level, a[at : at + PAIRS_AT_ONCE], b[at : at + PAIRS_AT_ONCE]) for at in range(0, len(a), PAIRS_AT_ONCE)]
            continue
        if level == 0:
            apart = a != b
            labels = merge_labels(labels, order[a[apart]], order[b[apart]])
            continue
        first, ends = levels[level][3]
        wide, high = ends[a] - first[a], ends[b] - first[b]
        pair = np.repeat(np.arange(len(a)), wide * high)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(wide * high) - wide * high, wide * high)
        c, d = first[a][pair] + nth // high[pair], first[b][pair] + nth % high[pair]
        both, either, grp, _ = levels[level - 1]
        shared = ~(both[c] ^ either[c]) & ~(both[d] ^ either[d])
        keep = (c <= d) & ((grp[c] < 0) | (grp[c] != grp[d])) & (np.bitwise_count((both[c] ^ both[d]) & shared) <= most)
        if keep.any():
            todo.append((level - 1, c[keep], d[keep]))
    return labels


def _deal(rows: DataFrame, width: int) -> DataFrame:
    """Each row to ``SEGMENTS`` buckets, one per segment of the ``width`` bits in ``rest``; the others stay in ``rest``."""
    each = width // SEGMENTS
    mask = (1 << each) - 1

    def cut(k: int) -> Column:
        low = F.col("rest").bitwiseAND(F.lit((1 << each * k) - 1))
        high = F.shiftleft(F.shiftrightunsigned("rest", each * (k + 1)), each * k) if k < SEGMENTS - 1 else F.lit(0).cast("long")
        value = F.shiftrightunsigned("rest", each * k).bitwiseAND(F.lit(mask))
        return F.struct(((F.col("key") * SEGMENTS + k) * (mask + 1) + value).alias("key"), high.bitwiseOR(low).alias("rest"))

    return rows.select("fingerprint", F.explode(F.array(*map(cut, range(SEGMENTS)))).alias("to")).select("fingerprint", "to.key", "to.rest")


def links(codes: DataFrame, most_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (``u``, ``v``) over distinct ``fingerprint`` longs that connect whatever a chain of links connects."""
    rows, width, dealt = codes.select("fingerprint", F.lit(1).cast("long").alias("key"), F.col("fingerprint").alias("rest")), 64, None
    for deal in range(DEALS):
        rows = _deal(rows, width)
        width -= width // SEGMENTS
        if deal < DEALS - 1:
            rows = stage(rows, "buckets")
            hot = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_rows).select("key"), "hot_buckets")
            ready = rows.join(hot, "key", "left_anti")
            rows = rows.join(hot, "key", "left_semi") if hot.head(1) else None
        else:
            ready = rows
        ready = ready.select("key", "fingerprint")
        dealt = ready if dealt is None else dealt.union(ready)
        if rows is None:
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, codes = np.empty(0, np.int64), np.empty(0, np.int64)

        def found(k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            group = bucket_groups(k, c.view(np.uint64))
            other = np.flatnonzero(group != np.arange(len(c)))
            return pa.RecordBatch.from_arrays([pa.array(c[other]), pa.array(c[group[other]])], names=["u", "v"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            codes = np.concatenate([codes, batch.column(1).to_numpy()])
            if len(keys) >= BATCH_ROWS and keys[0] != keys[-1]:
                whole = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
                yield found(keys[:whole], codes[:whole])
                keys, codes = keys[whole:], codes[whole:]
        if len(keys):
            yield found(keys, codes)

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def near_duplicates(marked: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Per distinct ``fingerprint`` its ``root`` (the same for all of a component) and ``component_id``: the smallest id a chain of links reaches.

    ``marked`` is a result of ``fingerprints``.  Null ids are passed over; a component of null ids alone has a null id.
    Nothing is dropped: exact copies share a fingerprint, so they meet in a sum, not in a list.
    """
    codes = stage(marked.groupBy("fingerprint").agg(F.min(doc_id).alias("least")), "codes")
    roots = stage(components(links(codes)), "roots")
    linked = stage(codes.join(roots, F.col("fingerprint") == F.col("u"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")), "linked")
    least = stage(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    return stage(linked.join(least, "root").select("fingerprint", "root", "component_id"), "components")


@query("op9_simhash")
def _(spark: SparkSession, folder: str) -> DataFrame:
    marked = fingerprints(table(spark, folder, "documents"))
    found = near_duplicates(marked)
    return marked.join(found, "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")

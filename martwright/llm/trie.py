"""Prefix trie of conversations by fixed-length block hashing.

A conversation is cut into blocks of ``BLOCK_TURNS`` turns.  A node at a block's end is known by the sum of digests of the
blocks before it, each mixed with its number, so conversations are grouped by successive blocks without following
them turn by turn, and a very long one is no task's alone.  Where all conversations that share the blocks so far go on with the same
block, one of them speaks for all; only where siblings diverge are turn boundaries refined, for each of the
conversations.  Sums over subtrees go up by doubling distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.llm.base import in_order, query, table
from martwright.llm.spelling import CRC32
from martwright.session import stage, stage_scope

BLOCK_TURNS = 4
#: A block's digest counts in words of so many bits: sums of 2^36 of them stay within a long, all words together tell 135 bits.
WORDS, WORD_BITS = 5, 27
#: Of the query: turns shared with the first conversation of a hundred.
SHARED_SPAN, SHARED_TURNS = 100, 6
CHUNK_IDS = 1000
PATH = [f"w{k}" for k in range(WORDS)]


def turn_digests(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``digest`` and ``n_chars`` per turn: texts go no further than this."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    return turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), said[0].alias("role"),
        F.sha2(F.concat(F.length(said[0]).cast("string"), F.lit(":"), *said), 256).alias("digest"), F.char_length(said[1]).cast("long").alias("n_chars"))


def numbered(turns: DataFrame) -> DataFrame:
    """Add ``place``, the number of a turn in its conversation from 0."""
    rows = stage(in_order(turns, ["conv_id", "turn", "role", "digest"], label="turns"), "turns")
    first = stage(rows.groupBy("conv_id").agg(F.min("position").alias("first")), "first_turns")
    return stage(rows.join(first, "conv_id").select("conv_id", (F.col("position") - F.col("first")).alias("place"), "digest", "n_chars"), "numbered")


def with_shared_openings(turns: DataFrame, span: int = SHARED_SPAN, most: int = SHARED_TURNS) -> DataFrame:
    """Each conversation c anew: the first h turns of conversation c - c % span, then its own after its first h; h = crc32(c) % most."""
    own = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most
    convs = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % span).alias("base"), own.alias("h"))
    opening = turns.where(F.col("place") < most - 1).select(F.col("conv_id").alias("base"), "place", "digest", "n_chars")
    rest = turns.where(F.col("place") >= own).select("conv_id", "place", "digest", "n_chars")
    # Places of a conversation with a short opening have a gap, which numbering closes.
    gapped = convs.join(opening, "base").where("place < h").select("conv_id", "place", "digest", "n_chars").union(rest)
    rows = stage(in_order(gapped, ["conv_id", "place"], label="rebuilt"), "rebuilt")
    first = stage(rows.groupBy("conv_id").agg(F.min("position").alias("first")), "first_rebuilt")
    return stage(rows.join(first, "conv_id").select("conv_id", (F.col("position") - F.col("first")).alias("place"), "digest", "n_chars"), "openings")


def blocks(turns: DataFrame) -> DataFrame:
    """A row per block of a conversation: ``block`` number, ``digests`` and ``chars`` of its turns, ``own`` digest, and the path before it (``PATH``)."""
    number = F.floor(F.col("place") / BLOCK_TURNS).cast("long")
    rows = turns.groupBy("conv_id", number.alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "n_chars"))).alias("t"))  # at most BLOCK_TURNS
    own = F.sha2(F.concat_ws(",", "t.digest"), 256)
    placed = F.sha2(F.concat_ws(":", "block", "own"), 256)
    words = [F.conv(F.substring(placed, 1 + 12 * k, 12), 16, 10).cast("long") % (1 << WORD_BITS) for k in range(WORDS)]
    rows = rows.select("conv_id", "block", F.col("t.digest").alias("digests"), F.col("t.n_chars").alias("chars"), own.alias("own"))
    rows = in_order(stage(rows.withColumns(dict(zip(PATH, words, strict=True))), "block_digests"), ["conv_id", "block"], PATH, "blocks")
    rows = stage(rows.drop("position"), "block_sums")
    first = stage(rows.where("block = 0").select(F.col("conv_id").alias("conv"), *(F.col(f"{w}_before").alias(f"{w}_first") for w in PATH)), "first_blocks")
    before = [(F.col(f"{w}_before") - F.col(f"{w}_first")).alias(w) for w in PATH]
    after = [(F.col(f"{w}_before") - F.col(f"{w}_first") + F.col(w)).alias(f"{w}_after") for w in PATH]
    return stage(rows.join(first, rows.conv_id == first.conv).select("conv_id", "block", "digests", "chars", "own", *before, *after), "block_paths")


def _node(block: Column, path: list[Column], turns: Column, inside: Column) -> Column:
    """The key of the node after so many turns of a block; a whole block's is that of the next one's start."""
    return F.md5(F.concat_ws(",", block.cast("string"), *(p.cast("string") for p in path), turns.cast("string"), inside))


def _start(block: Column, path: list[Column]) -> Column:
    return _node(block, path, F.lit(0), F.lit(""))


def nodes_of(rows: DataFrame) -> DataFrame:
    """``node``, ``parent``, ``depth``, ``conv_id`` (smallest member), ``n_convs`` and ``n_chars`` of the last turn, for all nodes below the root."""
    here, after = [F.col(w) for w in PATH], [F.col(f"{w}_after") for w in PATH]
    groups = stage(rows.groupBy("block", *PATH).agg(
        F.min("conv_id").alias("speaker"), F.count(F.lit(1)).alias("n"), F.min("own").alias("one"), F.max("own").alias("other")).select(
        "block", *PATH, "speaker", "n", (F.col("one") == F.col("other")).alias("alike")), "block_groups")
    # Alike: one conversation speaks for all of the group.  Otherwise each counts for itself, turn by turn.
    spoken = rows.join(groups, ["block", *PATH]).where("not alike or conv_id = speaker").withColumn("weight", F.when(F.col("alike"), F.col("n")).otherwise(1))

    def upto(t: Column) -> Column:
        whole = t == BLOCK_TURNS
        return F.when(whole, _start(F.col("block") + 1, after)).otherwise(_node(F.col("block"), here, t, F.sha2(F.concat_ws(",", F.slice("digests", 1, t)), 256)))

    turn = F.explode(F.transform(F.sequence(F.lit(1), F.size("digests")), lambda t: F.struct(
        upto(t).alias("node"), F.when(t == 1, _start(F.col("block"), here)).otherwise(upto(t - 1)).alias("parent"),
        (F.col("block") * BLOCK_TURNS + t).alias("depth"), F.element_at("chars", t).alias("n_chars"))))
    each = spoken.select("conv_id", "weight", turn.alias("at")).select("conv_id", "weight", "at.*")
    return each.groupBy("node", "parent", "depth", "n_chars").agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"))


def _ends(rows: DataFrame, every: DataFrame) -> DataFrame:
    """``node`` and ``ends_sha256`` of nodes where conversations end; ``every`` has all ``conv_id``.

    A node's ids are gathered into long texts where they lie in order, and only those are fed to the hash, a stream per node.
    """
    here, after = [F.col(w) for w in PATH], [F.col(f"{w}_after") for w in PATH]
    size, whole = F.size("digests"), F.size("digests") == BLOCK_TURNS
    at = F.when(whole, _start(F.col("block") + 1, after)).otherwise(_node(F.col("block"), here, size, F.sha2(F.concat_ws(",", "digests"), 256)))
    last = stage(rows.groupBy("conv_id").agg(F.max("block").alias("block")), "last_blocks")
    root = _start(F.lit(0), [F.lit(0)] * WORDS)
    told = rows.select("conv_id", "block", at.alias("node")).join(last, ["conv_id", "block"], "left_semi").select("conv_id", "node")
    silent = every.join(last, "conv_id", "left_anti").select("conv_id", root.alias("node"))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, at = [], 0
            while at < len(ids):
                to = at + 1
                while to < len(ids) and to - at < CHUNK_IDS and nodes[to] == nodes[at]:
                    to += 1
                out.append((nodes[at], ids[at], ",".join(map(str, ids[at:to]))))
                at = to
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["node", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != node:
                    if running is not None:
                        done.append((node, running.hexdigest()))
                    node, running = key, hashlib.sha256(ids.encode())
                else:
                    running.update(f",{ids}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], names=["node", "ends_sha256"])
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([running.hexdigest()])], names=["node", "ends_sha256"])

    ids = stage(told.union(silent), "ends").select("node", "conv_id")
    texts = ids.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(gathered, "node string, first long, ids string")
    return texts.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node string, ends_sha256 string")


def _summed_upwards(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """``node`` and ``sums`` added up over its subtree, itself included; ``nodes`` has ``node``, ``parent`` and ``sums``.

    In each round a node takes what those 2^k below it have gathered, then looks twice as far up.
    """
    now = stage(nodes.select("node", F.col("parent").alias("above"), *sums), "tree")
    while now.where("above is not null").head(1):
        given = stage(now.where("above is not null").groupBy(F.col("above").alias("node")).agg(*(F.sum(s).alias(f"{s}_below") for s in sums)), "given")
        further = now.select(F.col("node").alias("above"), F.col("above").alias("next"))
        rows = now.join(given, "node", "left").join(further, "above", "left")
        now = stage(rows.select("node", F.col("next").alias("above"), *((F.col(s) + F.coalesce(f"{s}_below", F.lit(0))).alias(s) for s in sums)), "tree")
    return now.drop("above")


def prefix_trie(turns: DataFrame, every: DataFrame) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    ``turns`` has ``conv_id``, ``place`` (from 0, without gaps), ``digest`` and ``n_chars`` of each turn; ``every`` has the
    ``conv_id`` of all conversations once, those without turns included, which end at the root.  Without any conversation there is no node.
    """
    with stage_scope(turns.sparkSession):
        every = stage(every.select("conv_id"), "conversations")
        rows = blocks(turns)
        root = _start(F.lit(0), [F.lit(0)] * WORDS)
        top = every.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
            root.alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_chars"), "conv_id", "n_convs")
        nodes = stage(nodes_of(rows).unionByName(top), "nodes")
        children = stage(nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")).where("node is not null"), "children")
        nodes = stage(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes_with_children")
        own = nodes.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"))
        below = _summed_upwards(own, ["n_leaves", "saved_tokens"])
        parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        out = nodes.join(parents, "parent", "left").join(below, "node").join(stage(_ends(rows, every), "end_digests"), "node", "left")
        nothing = hashlib.sha256(b"").hexdigest()
        return stage(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")), "trie", outlive=True)


def shared_opening_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt by ``with_shared_openings``.

    Turns go by ``turn`` (null first), equal ones by role and then by the digest of their text; a null role or text is empty, and
    what repeats is a turn like any other.  Rows without ``conv_id`` belong to no conversation.  Texts of any length are one turn;
    other columns are not looked at; an empty table has no node.
    """
    with stage_scope(conversations.sparkSession):
        turns = numbered(turn_digests(conversations))
        return stage(prefix_trie(with_shared_openings(turns), turns.select("conv_id").distinct()), "shared_trie", outlive=True)


ORACLE = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY p) AS turns FROM t GROUP BY conv_id),
h AS (SELECT conv_id, turns, conv_id - conv_id % 100 AS base, (({CRC32.format(x="conv_id::VARCHAR")}) % 6)::INT AS h FROM own),
re AS (SELECT h.conv_id, coalesce(list_slice(b.turns, 1, h.h), []) || coalesce(list_slice(h.turns, h.h + 1, len(h.turns)), []) AS turns FROM h LEFT JOIN own b ON b.conv_id = h.base),
pre AS (SELECT conv_id, turns, d, list_slice(turns, 1, d) AS path FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM re)),
node AS (SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d = 0 THEN 0 ELSE length(path[d].t) END) AS chars,
         sha256(coalesce(string_agg(CASE WHEN len(turns) = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM pre GROUP BY path, d),
kids AS (SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.path = node.path),
up AS (SELECT list_slice(path, 1, a) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved
       FROM (SELECT path, n_children, n_convs, chars, unnest(range(0, depth + 1)) AS a FROM full_node) GROUP BY ALL)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children, up.n_leaves::BIGINT AS n_leaves, up.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_node f JOIN up ON up.path = f.path LEFT JOIN node p ON f.depth > 0 AND p.path = list_slice(f.path, 1, f.depth - 1)"""


@query("op11_prefix_trie", ORACLE)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return shared_opening_trie(table(spark, folder, "conversations"))

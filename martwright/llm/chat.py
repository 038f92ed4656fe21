"""Chat formatting by quotation linking: who answers whom, found from what messages quote.

Each message is parsed into its own words and quoted passages with their nesting level.  Passages and
single lines are normalised and hashed.  A quoted hash is joined to the original, the first message of the
conversation that has it among its own words; the message answered is the one that most quoted words of the
outermost level lead to.  Chains of answers are followed by doubling, and messages come out in reply order
with their quotes removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright.llm.base import in_order, query, table
from martwright.session import stage

#: Quote marks at a line's start, and the line that often stands before a quote.
_MARKS = re.compile(r"^(?:[ \t]{0,3}>)+[ \t]?")
_ATTRIBUTION = re.compile(r"^.{0,200}\b(?:wrote|writes|said):\s*$")
#: Single lines link if they have so many words; passages always do.
LINE_WORDS = 4


def parse(text: str) -> tuple[str, list[str], list[tuple[int, str]]]:
    """Own text, own passages, and quoted passages with their levels.

    A passage is a run of lines of one level up to an empty line.  A line that only announces a quote
    right below it belongs to the quote.  Lines are cut at line feeds; a carriage return before one goes.
    """
    lines = []
    for line in text.split("\n"):
        line = line.removesuffix("\r")
        marks = _MARKS.match(line)
        lines.append((marks.group().count(">"), line[marks.end() :]) if marks else (0, line))
    own = [n for n, (level, _) in enumerate(lines) if level == 0]
    for n in range(len(lines) - 1):
        if lines[n][0] < lines[n + 1][0] and _ATTRIBUTION.match(lines[n][1]):
            lines[n] = (lines[n][0], "")
            if lines[n][0] == 0:
                own.remove(n)
    passages: list[tuple[int, list[str]]] = []
    open_level = None
    for level, line in lines:
        if not line.strip():
            open_level = None
        elif level == open_level:
            passages[-1][1].append(line)
        else:
            passages.append((level, [line]))
            open_level = level
    body = "\n".join(lines[n][1] for n in own)
    if len(own) < len(lines):
        body = re.sub(r"\n{3,}", "\n\n", body).strip("\n")
    return body, ["\n".join(p) for level, p in passages if level == 0], [(level, "\n".join(p)) for level, p in passages if level]


def units(passage: str) -> list[tuple[int, int]]:
    """Hash and number of words of a passage and of each of its longer lines; case and blanks don't count."""
    texts = [passage.lower().split()]
    lines = passage.split("\n")
    if len(lines) > 1:
        texts += [words for words in (line.lower().split() for line in lines) if len(words) >= LINE_WORDS]
    return [(int.from_bytes(hashlib.blake2b(" ".join(w).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True), len(w)) for w in texts if w]


_UNIT = T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("words", T.IntegerType())]))
_QUOTED = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("words", T.IntegerType())]))
_ARROW_UNIT = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int32())]))
_ARROW_QUOTED = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("words", pa.int32())]))


def parsed(messages: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` with ``row_key``, ``content``, ``own`` and ``quoted``, staged so that keys stay."""
    schema = T.StructType([*(messages.schema[k] for k in keep), T.StructField("row_key", T.LongType()), T.StructField("content", T.StringType()),
                           T.StructField("own", _UNIT), T.StructField("quoted", _QUOTED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            contents, own, quoted = [], [], []
            for body in batch.column(batch.num_columns - 1).to_pylist():
                content, mine, others = parse(body or "")
                contents.append(content)
                own.append([{"hash": h, "words": n} for h, n in sorted({u for p in mine for u in units(p)})])
                quoted.append([{"level": level, "hash": h, "words": n} for level, h, n in sorted({(level, *u) for level, p in others for u in units(p)})])
            keys = pa.array(range(key, key + batch.num_rows), pa.int64())
            key += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], keys, pa.array(contents, pa.string()), pa.array(own, _ARROW_UNIT), pa.array(quoted, _ARROW_QUOTED)],
                                             names=[*keep, "row_key", "content", "own", "quoted"])

    return stage(messages.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema), "chat_parsed")


def replies(messages: DataFrame) -> DataFrame:
    """``row_key`` and ``parent`` (the answered message's key) of every message whose quotes lead to an earlier one.

    Of one passage only the first message that has it is the original, so a passage that everybody repeats
    gives each quoting message one row.  Levels are tried from the outermost; most words decide, then the later message.
    """
    originals = stage(messages.where("turn IS NOT NULL").select("conv_id", F.explode("own.hash").alias("hash"), "turn", "row_key").groupBy("conv_id", "hash").agg(
        F.min(F.struct("turn", "row_key")).alias("first")), "chat_originals")
    quotes = messages.select(F.col("conv_id").alias("q_conv"), F.col("turn").alias("q_turn"), F.col("row_key").alias("q_key"), F.explode("quoted").alias("q"))
    found = quotes.join(originals, F.col("conv_id").eqNullSafe(F.col("q_conv")) & (F.col("hash") == F.col("q.hash"))).where(F.col("first.turn") < F.col("q_turn"))
    votes = found.groupBy("q_key", "q.level", "first").agg(F.sum("q.words").alias("words"))
    return votes.groupBy(F.col("q_key").alias("row_key")).agg(F.max_by("first.row_key", F.struct(-F.col("level"), "words", "first")).alias("parent"))


def threads(links: DataFrame) -> DataFrame:
    """``row_key``, ``parent``, ``root`` and ``depth`` of every answer, by doubling: rounds grow with the log of the longest chain.

    A parent always has an earlier turn, so chains end.
    """
    now = stage(links.select("row_key", "parent", F.col("parent").alias("root"), F.lit(1).alias("depth")), "chat_links")
    while True:
        ahead = now.select(F.col("row_key").alias("a_key"), F.col("root").alias("a_root"), F.col("depth").alias("a_depth"))
        joined = now.join(ahead, F.col("root") == F.col("a_key"), "left")
        now = stage(joined.select("row_key", "parent", F.coalesce("a_root", "root").alias("root"), (F.col("depth") + F.coalesce("a_depth", F.lit(0))).alias("depth"),
                                  F.col("a_key").isNotNull().alias("moved")), "chat_threads")
        if not now.where("moved").head(1):
            return now.drop("moved")
        now = now.drop("moved")


def chat_message(role: Column, content: Column) -> Column:
    """One message of a chat template; a null role is ``unknown``."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), content, F.lit("\n<|end|>\n"))


def conversations(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Every message once, without quotes, in reply order within its conversation.

    ``position`` counts from 0: threads by their first message's turn, in a thread answers after what they answer
    (by depth, then turn).  ``parent_turn`` is null for a message that answers nothing; ``root_turn`` and ``depth`` say where
    its chain begins and how long it is.  A null text counts as empty; null conversations are one conversation; a message
    with a null turn answers nothing and comes first.  Repeated rows stay.  An empty table gives no rows.
    """
    rows = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    read = parsed(rows, "text", ["conv_id", "turn", "role"])
    chains = threads(replies(read))
    named = read.select(F.col("row_key").alias("n_key"), F.col("turn").alias("n_turn"))
    chains = chains.join(named.withColumnsRenamed({"n_key": "parent", "n_turn": "parent_turn"}), "parent").join(named.withColumnsRenamed({"n_key": "root", "n_turn": "root_turn"}), "root")
    chains = stage(chains, "chat_chains")
    placed = read.select("conv_id", "turn", "role", "row_key", "content").join(chains, "row_key", "left").select(
        "conv_id", "turn", "role", "content", "parent_turn", "row_key", F.coalesce("root", "row_key").alias("root"),
        F.when(F.col("root").isNull(), F.col("turn")).otherwise(F.col("root_turn")).alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"))
    ordered = in_order(placed, ["conv_id", "root_turn", "root", "depth", "turn", "row_key"], label="chat_order")
    starts = stage(ordered.groupBy(F.col("conv_id").alias("s_conv")).agg(F.min("position").alias("start")), "chat_starts")
    return ordered.join(starts, F.col("conv_id").eqNullSafe(F.col("s_conv"))).select(
        "conv_id", (F.col("position") - F.col("start")).alias("position"), "turn", "role", "content", "parent_turn", "root_turn", "depth",
        chat_message(F.col("role"), F.col("content")).alias("message"))


@query("op10_chat_formatting")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return conversations(table(spark, folder, "conversations"))


@query("quoted_replies")
def _(spark: SparkSession, folder: str) -> DataFrame:
    """The same on mail-like messages that Spark derives from the table: each turn quotes an earlier one, which may itself hold a quote."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    earlier = turns.select("conv_id", F.when(F.col("turn") % 3 == 0, F.col("turn") + 2).otherwise(F.col("turn") + 1).alias("turn"), F.col("text").alias("one"))
    first = turns.where("turn = 0").select("conv_id", F.col("text").alias("two"))
    joined = turns.join(earlier.groupBy("conv_id", "turn").agg(F.min("one").alias("one")), ["conv_id", "turn"], "left").join(
        first.groupBy("conv_id").agg(F.min("two").alias("two")), "conv_id", "left")
    mark = lambda text, marks: F.regexp_replace(F.concat(F.lit("\n"), text), "\n", f"\n{marks} ")
    quoting = F.concat(F.lit("Someone wrote:"), F.coalesce(mark(F.col("two"), ">>"), F.lit("")), mark(F.col("one"), ">"), F.lit("\n\n"), F.col("text"))
    return conversations(joined.withColumn("text", F.when(F.col("one").isNotNull(), quoting).otherwise(F.col("text"))))

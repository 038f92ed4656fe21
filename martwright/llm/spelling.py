"""Spelling variants: words one edit apart, found through a dictionary of trie-node pairs.

Every prefix of a word is a node of the forward trie, every suffix one of the reversed trie; nodes have numbers.  Leaving out
position i of a word leaves the pair (prefix node i, suffix node i + 1), cutting it there the pair (prefix node i, suffix
node i).  Two words differ by a replaced letter if they leave the same pair, by an inserted one if what one leaves is a cut of
the other.  Of the words that leave one pair, each has another letter in the gap, so there are no more of them than
letters; the dictionary keeps their number and the best two, and no pair of words is ever spelled out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.llm.base import in_order, query, slices, table
from martwright.session import stage, stage_scope

#: A letter is left out of a run if this divides the checksum of the document's id and the run.
TYPO_PART = 97
LEAST_LETTERS, LEAST_COUNT, FORM_TIMES = 5, 3, 2
#: Letters A-Z, a-z and U+00C0 to U+00FF, as UTF-8.
RUNS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
LETTERS = re.compile(rb"[A-Za-z]|\xc3[\x80-\xbf]")
BYTES_AT_ONCE, WORDS_AT_ONCE = 8_000_000, 200_000
#: Two primes and bases for the digests of nodes, from which they get their numbers.
PRIMES, BASES = ((1 << 61) - 1, (1 << 31) - 1), (0x1F3A5C7E9B2D4F61, 0x2C6E35B9)


def typo(run: bytes, before: int) -> bytes:
    """The lower-case run, without one letter if its checksum, continued from that of the id, says so."""
    h = zlib.crc32(run, before)
    if h % TYPO_PART:
        return run
    letters = LETTERS.findall(run)
    del letters[h % len(letters)]
    return b"".join(letters)


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word`` and ``n`` over whole texts: lower-case runs of letters, some with the letter left out that their checksum names.

    Words are counted per slice of texts before they are shuffled.  Null texts have none; a null id is written as nothing.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in slices(batches, 1, BYTES_AT_ONCE):
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if body:
                    before = zlib.crc32(f"{key}:".encode())
                    for word, n in Counter(RUNS.findall(body.lower())).items():
                        counts[typo(word, before)] += n
                if len(counts) >= WORDS_AT_ONCE:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _digests(letters: str) -> list[tuple[int, int]]:
    """Digests of all prefixes of a word, the empty one first."""
    (p, q), (a, b) = PRIMES, BASES
    x, y, all_ = 1, 1, [(1, 1)]
    for c in map(ord, letters):
        x, y = (x * a + c) % p, (y * b + c) % q
        all_.append((x, y))
    return all_


def _places(words: DataFrame) -> DataFrame:
    """A row for each position 0 to length of each word: digests of the prefix before it and of the suffix from it, and whether a letter
    stands there that differs from the one before."""
    schema = "word_no long, place int, fresh boolean, p1 long, p2 long, s1 long, s2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 200_000):
            rows = []
            for number, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ahead, back = _digests(word), _digests(word[::-1])[::-1]
                rows += [(number, i, i < len(word) and word[i] != word[i - 1 : i], *ahead[i], *back[i]) for i in range(len(word) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.bool_(), *[pa.int64()] * 4), strict=True)],
                                             names=["word_no", "place", "fresh", "p1", "p2", "s1", "s2"])

    return stage(words.select("word_no", "word").mapInArrow(run, schema), "places")


def _numbered(places: DataFrame, side: str) -> DataFrame:
    """The nodes of one trie with their numbers."""
    first, second = f"{side}1", f"{side}2"
    return stage(places.select(first, second).distinct().withColumn(side, F.monotonically_increasing_id()), f"nodes_{side}")


def node_pairs(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``word_no``, ``p``, ``s``, ``fresh``) of every left-out position, and (``word_no``, ``p``, ``s``) of every cut.

    ``fresh`` is true for one position of those that leave the same word, the first of equal letters.
    """
    places = _places(words)
    ahead, back = (_numbered(places, side) for side in "ps")
    nodes = stage(places.join(ahead, ["p1", "p2"]).join(back, ["s1", "s2"]).select("word_no", "place", "fresh", "p", "s"), "node_places")
    after = nodes.select("word_no", (F.col("place") - 1).alias("place"), F.col("s").alias("next"))
    skips = stage(nodes.drop("s").join(after, ["word_no", "place"]).select("word_no", "p", F.col("next").alias("s"), "fresh"), "skips")
    return skips, nodes.select("word_no", "p", "s")


def neighbours(words: DataFrame) -> DataFrame:
    """``word_no``, ``n_near`` and ``best``, the smallest number of a near word, of words that have near words.

    ``words`` has ``word_no`` (distinct, better words first) and ``word`` (distinct).
    """
    skips, cuts = node_pairs(words)
    left = stage(skips.groupBy("p", "s").agg(
        F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_list("word_no")), 1, 2).alias("first"),  # at most one word a letter
        F.count_if("fresh").alias("n_fresh"), F.min(F.when(F.col("fresh"), F.col("word_no"))).alias("first_fresh")), "pair_dictionary")
    replaced = skips.join(left.where("n > 1").select("p", "s", "n", "first"), ["p", "s"]).select(
        "word_no", (F.col("n") - 1).alias("near"), F.when(F.col("first")[0] == F.col("word_no"), F.col("first")[1]).otherwise(F.col("first")[0]).alias("best"))
    longer = cuts.join(left.where("n_fresh > 0").select("p", "s", "n_fresh", "first_fresh"), ["p", "s"]).select("word_no", F.col("n_fresh").alias("near"), F.col("first_fresh").alias("best"))
    shorter = skips.where("fresh").select("word_no", "p", "s").join(cuts.withColumnRenamed("word_no", "best"), ["p", "s"]).select("word_no", F.lit(1).cast("long").alias("near"), "best")
    return replaced.union(longer).union(shorter).groupBy("word_no").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def variants(counts: DataFrame, times: Column | int = FORM_TIMES) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of a table of distinct words and their counts.

    The form of a word is its near word with the largest count (of equal ones the first in code-point order), if that
    count is at least ``times`` the word's; ``root`` is where following forms ends.  Null words and counts take no part, the
    empty word is a word like any other, an empty table gives none, other columns are not looked at.
    """
    with stage_scope(counts.sparkSession):
        known = stage(counts.select("word", "n").where("word is not null and n is not null").withColumn("less", -F.col("n")), "counts")
        words = stage(in_order(known, ["less", "word"], label="words").select(F.col("position").alias("word_no"), "word", "n"), "words")
        near = stage(neighbours(words), "near")
        others = words.select(F.col("word_no").alias("best"), F.col("n").alias("best_n"))
        told = words.join(near, "word_no", "left").join(others, "best", "left").select(
            "word_no", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            *(F.when(F.col("best_n") >= times * F.col("n"), F.col(c)).alias(name) for c, name in (("best", "form_no"), ("best_n", "form_n"))))
        told = stage(told, "told")
        up = told.where("form_no is not null").select("word_no", F.col("form_no").alias("root_no"))
        roots = stage(up, "roots")
        while True:  # counts double along a chain, so its length has few binary digits
            above = roots.select(F.col("word_no").alias("root_no"), F.col("root_no").alias("above"))
            jumped = stage(roots.join(above, "root_no", "left").select("word_no", F.coalesce("above", "root_no").alias("root_no"), F.col("above").isNotNull().alias("moved")), "roots")
            roots = jumped.drop("moved")
            if not jumped.where("moved").head(1):
                break

        def named(no: str, name: str) -> DataFrame:
            return words.select(F.col("word_no").alias(no), F.col("word").alias(name))

        out = told.join(roots, "word_no", "left").join(named("form_no", "form"), "form_no", "left").join(named("root_no", "root"), "root_no", "left")
        return stage(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants", outlive=True)


#: CRC-32 of UTF-8 text in SQL: eight steps a byte of the reflected polynomial.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode({x})) + 1), lambda i: ('0x' || hex(encode({x}))[2 * i - 1 : 2 * i])::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) "
CRC32 = "xor(" + _CRC + ", 4294967295)"

ORACLE = rf"""
WITH RECURSIVE run AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
each AS (SELECT doc_id, r, count(*) AS k FROM run GROUP BY doc_id, r),
h AS (SELECT r, k, {CRC32.format(x="(coalesce(doc_id::VARCHAR, '') || ':' || r)")} AS h FROM each),
typed AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
gap AS (SELECT DISTINCT word, n, substr(word, 1, i) || '_' || substr(word, i + 2) AS g, substr(word, 1, i) || substr(word, i + 2) AS d
        FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM gap a JOIN gap b ON a.g = b.g AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM gap a JOIN w b ON a.d = b.word
         UNION SELECT b.word, a.word, a.n FROM gap a JOIN w b ON a.d = b.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS m FROM near GROUP BY word),
form AS (SELECT w.word, w.n, coalesce(best.n_near, 0) AS n_near, min(near.other) AS form, min(near.other_n) AS form_n
         FROM w LEFT JOIN best USING (word) LEFT JOIN near ON near.word = w.word AND near.other_n = best.m AND best.m >= 2 * w.n GROUP BY ALL),
chain AS (SELECT word, word AS at FROM form UNION ALL SELECT chain.word, form.form FROM chain JOIN form ON form.word = chain.at WHERE form.form IS NOT NULL),
last AS (SELECT chain.word, chain.at AS root FROM chain JOIN form ON form.word = chain.at WHERE form.form IS NULL)
SELECT form.word, form.form, last.root, form.n, form.n_near::BIGINT AS n_near, form.form_n FROM form JOIN last USING (word)"""


@query("op12_spelling", ORACLE)
def _(spark: SparkSession, folder: str) -> DataFrame:
    counts = word_counts(table(spark, folder, "documents"))
    return variants(counts.where((F.length("word") >= LEAST_LETTERS) & (F.col("n") >= LEAST_COUNT)))

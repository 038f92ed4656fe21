"""A training corpus from raw documents: five stages, each on all that the stage before it kept.

Language and quality models learn from the stage's own input and, for quality, the labels; documents held
out from learning are scored like all others.  Near-duplicates are by shingles of five words and similarity of
0.8, compared exactly; mixing takes the parameters of its operator's query.  Between stages the documents are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.llm import langid, mixing, pieces, quality, tensor
from martwright.llm.base import table, vocabulary_file
from martwright.session import pin_utc, stage, stage_scope

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language must have this share of the total probability, and a text this probability of being good.
LEAST_LANGUAGE, LEAST_QUALITY = 0.5, 0.5
#: Shingles and least similarity of near-duplicates; with so many half bands of three hashes a pair at 0.8 is missed with a probability of 5e-6.
SHINGLE_WORDS, LEAST_PERCENT, HALVES = 5, 80, 18

#: Models and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without letters, or between languages, go."""
    found = langid.identify(docs, langid.train_on(docs), keep=COLUMNS)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE)).select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good."""
    scored = quality.classify(docs, quality.train_on(docs, table(spark, sf_dir, "labels")), keep=COLUMNS)
    return scored.where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 0.8 of their five-word shingles the one with the smallest id (null ids last; of one id's rows one).

    SimHash groups of the operator's index are confirmed first; half bands find what three bits of a fingerprint don't reach.
    Documents without words are copies of each other.
    """
    nameless = F.col("doc_id").isNull()
    name = [nameless.alias("nameless"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_key"]
    with stage_scope(spark) as keep:
        found = tensor.near_duplicates(docs, words_each=SHINGLE_WORDS, percent=LEAST_PERCENT, halves=HALVES, fingerprints_first=True)
        first = found.groupBy(F.coalesce("root", F.lit(-1))).agg(F.min(F.struct(nameless.alias("nameless"), "doc_id", "text_key")).alias("first"))
        kept = keep(stage(first.select("first.doc_id", "first.text_key").select(*name), "kept_rows"))
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("text_key")).select(*COLUMNS, *name).join(kept, ["nameless", "id", "text_key"], "left_semi")
    rest = [c for c in COLUMNS if c != "doc_id"]
    one = rows.groupBy("nameless", "id", "text_key").agg(F.min(F.struct(*rest)).alias("one"))
    return one.select(F.when(~F.col("nameless"), F.col("id")).alias("doc_id"), *(F.col(f"one.{c}") for c in rest)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, sized by words."""
    return mixing.mix(docs.select(*COLUMNS), mixing.word_count(F.col("text")))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number, digest and decoded checksum of each document's pieces, one row per copy."""
    return pieces.encode_and_decode(docs, vocabulary_file(pieces.MODEL), keep=("doc_id", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    pin_utc(spark)
    docs = table(spark, sf_dir.rstrip("/"), "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir.rstrip("/")), f"pipeline_{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}

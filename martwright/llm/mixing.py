"""Mixing sources to target weights: whole repeats of every document plus one hash-seeded Bernoulli copy.

Tokens are summed per source, targets follow from weights, a total and a ceiling per source, and a
source's rate is its target over its size.  A document is taken floor(rate) times, and once more if
a number drawn from a hash of its id lies below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.llm.base import draw, in_order, query, table
from martwright.session import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2.0
SEED = "mix"
#: What counts as a word: a run without space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Number of words in a text; each word and the blanks around it shrink to one letter."""
    body = F.coalesce(text, F.lit(""))
    shrunk = F.regexp_replace(body, f"[{BLANKS}]*+[^{BLANKS}]++[{BLANKS}]*+", "w")
    return F.when(body.rlike(f"[^{BLANKS}]"), F.length(shrunk)).otherwise(0).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """Target of each source: shares of the total by weight, capped, the excess reshared until none is above its cap.

    ``sizes`` has ``source`` and ``source_size``.  Sources take the weights in turn, by code point, null last.
    All uncapped targets are one level times the weight, so each round is a sum over the sources above
    and below the level; rounds end when no further source is capped.
    """
    ranked = in_order(sizes.withColumn("unnamed", F.col("source").isNull()), ["unnamed", "source"], label="mix_sources").drop("unnamed")
    turn = (F.col("position") % len(weights)).cast("int")
    weighed = stage(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double")), "mix_weights")
    cap = F.lit(ceiling) * F.col("source_size")
    whole = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    wanted = share * (whole["size"] or 0)
    level, capped = (wanted / whole["weight"] if whole["weight"] else 0.0), -1
    while True:
        above = cap < F.lit(level) * F.col("weight")
        now = weighed.agg(F.count_if(above).alias("n"), F.sum(F.when(above, cap)).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("weight")).first()
        if now["n"] == capped or not now["weight"]:
            break
        level, capped = (wanted - (now["held"] or 0.0)) / now["weight"], now["n"]
    return weighed.withColumn("target", F.least(cap, F.lit(level) * F.col("weight"))).drop("position")


def plan_copies(docs: DataFrame, size: Column, doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
                share: float = SHARE, ceiling: float = CEILING, seed: str = SEED) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies``; rows of size 0 get no copy beyond their source's rate.

    Sources are summed before any shuffle and joined back by adaptive execution: broadcast below the
    session's size limit, else a join whose hot source is split.  A null source is a source of its own.
    Repeated rows share one draw.  An empty table gives no rows.
    """
    sized = docs.withColumn("mix_size", size)
    sums = stage(sized.groupBy(F.col(source).alias("source")).agg(F.sum("mix_size").alias("source_size")), "mix_sizes")
    plan = stage(targets(sums, weights, share, ceiling).select(
        F.col("source").alias("_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_rate")), "mix_plan")
    joined = sized.join(plan, F.col(source).eqNullSafe(F.col("_source")), "left")
    whole = F.floor("_rate")
    extra = (draw(F.lit(seed), F.col(doc_id)) < F.col("_rate") - whole).cast("long")
    return joined.withColumn("mix_copies", whole + extra).drop("_source", "_rate")


def mix(docs: DataFrame, size: Column, **how) -> DataFrame:
    """The mixed documents: each row as often as planned, all columns kept."""
    planned = plan_copies(docs, size, **how)
    copies = F.when(F.col("mix_copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))).otherwise(F.array().cast("array<bigint>"))
    return planned.select(*docs.columns, F.explode(copies).alias("_copy")).drop("_copy")


_ORACLE = r"""
WITH RECURSIVE docs AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT source, source_size, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight,
  2.0 * CAST(source_size AS DOUBLE) AS cap FROM sizes),
facts AS (SELECT 1.5 * CAST(sum(source_size) AS DOUBLE) AS wanted, sum(weight) AS weight FROM weighed),
levels AS (SELECT 0 AS step, CASE WHEN weight > 0 THEN wanted / weight ELSE 0 END AS level FROM facts
  UNION ALL
  SELECT step + 1, ((SELECT wanted FROM facts) - coalesce((SELECT sum(cap) FROM weighed WHERE cap < level * weight), 0))
    / (SELECT sum(weight) FROM weighed WHERE NOT cap < level * weight) FROM levels WHERE step < 50),
final AS (SELECT level FROM levels ORDER BY step DESC LIMIT 1),
plan AS (SELECT source, source_size, least(cap, (SELECT level FROM final) * weight) AS target FROM weighed),
rated AS (SELECT d.doc_id, d.size, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0 END AS rate
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  size * (CAST(floor(rate) AS BIGINT) + CASE WHEN CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 12) AS UBIGINT) AS DOUBLE)
    / 281474976710656.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rated"""


@query("op8_mixing", _ORACLE)
def _(spark: SparkSession, folder: str) -> DataFrame:
    planned = plan_copies(table(spark, folder, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), F.col("size"))
    return planned.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * F.col("mix_copies")).alias("taken"))

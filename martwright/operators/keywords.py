"""Matching a table of free-text requests to a measure catalogue and to onboarded metrics.

Requests may be many and long; the catalogue is a dimension.  Words and short stretches
of a request are exploded inside its task and probed against a size-checked
broadcast of the catalogue, so no request text is ever copied or shuffled.  Lookup tables are
materialised first: their true size, not an estimate of their source, is checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martwright import rules
from martwright.functions import text as txt
from martwright.operators import keys as key_ops
from martwright.operators import stats


def catalog_words(catalog: DataFrame) -> DataFrame:
    """Distinct words of the catalogue with the measure they belong to."""
    return catalog.select("question_id", F.explode(txt.tokens(F.concat_ws(" ", "question", "topic"))).alias("word")).distinct()


def matches_catalog(requests: DataFrame, ids: list[str], text: str, catalog: DataFrame) -> DataFrame:
    """Whether a request shares a word with the catalogue or names a fixed column: ids, matched."""
    words = stats.dimension(catalog_words(catalog).select(F.col("word").alias("token"), F.lit(True).alias("known")).distinct())
    fixed = txt.contains_any(F.col("low"), rules.FIXED_COLUMN_TERMS)
    # Whatever is computed per request is computed before the explode, once per request.
    per_request = (requests.select(*ids, F.lower(text).alias("low"))
                   .select(*ids, fixed.alias("fixed"), txt.tokens(F.col("low")).alias("tokens")))
    return (per_request.select(*ids, "fixed", F.explode_outer("tokens").alias("token"))
            .join(words, "token", "left").groupBy(*ids)
            .agg(F.max(F.col("fixed") | F.coalesce("known", F.lit(False))).alias("matched")))


def suggest_metrics(requests: DataFrame, ids: list[str], text: str, metrics: DataFrame, k: int = rules.MAX_MEASURES) -> DataFrame:
    """Up to k onboarded metrics per request that share a telling word, in catalogue order: ids, position, metric_id.

    ``metrics`` has metric_id, ordinal and meaning.
    """
    words = metrics.select("metric_id", "ordinal", F.explode(key_ops.metric_words(F.col("meaning"))).alias("token"))
    hits = (requests.select(*ids, F.explode(key_ops.metric_words(F.col(text))).alias("token"))
            .join(stats.dimension(words), "token").select(*ids, "ordinal", "metric_id").distinct())
    return _first_k(hits, ids, ["ordinal", "metric_id"], k).select(*ids, "position", "metric_id")


def pick_measures(requests: DataFrame, ids: list[str], text: str, catalog: DataFrame, defaults: list[str] | None = None,
                  k: int = rules.MAX_MEASURES) -> DataFrame:
    """Up to k measures per request: everyday synonyms first, then measures with a word inside the request,
    in catalogue order; the defaults when nothing fits.  Columns: ids, position, question_id.

    ``catalog`` has question_id, ordinal, question and topic.
    """
    spark = requests.sparkSession
    words = catalog_words(catalog).join(catalog.select("question_id", "ordinal"), "question_id").select(
        F.substring("word", 1, 4).alias("window"), "word", "question_id", (F.col("ordinal") + len(rules.MEASURE_SYNONYMS)).alias("place"))
    synonyms = (spark.createDataFrame([(i, term, q) for i, (term, q) in enumerate(rules.MEASURE_SYNONYMS)],
                                      "place long, word string, question_id string")
                .join(stats.dimension(catalog.select("question_id")), "question_id", "left_semi")
                .select(F.substring("word", 1, 4).alias("window"), "word", "question_id", "place"))
    lookup = stats.dimension(words.withColumn("place", F.col("place").cast("long")).unionByName(synonyms))
    # Of a request only stretches as long as the longest word leave its row, never the text itself.
    longest = lookup.agg(F.max(F.length("word"))).first()[0] or 4
    stretches = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(?s)(?=([a-z]{{4}}.{{0,{max(0, longest - 4)}}}))"), F.lit(1)))
    found = (requests.select(*ids, F.explode(stretches).alias("stretch")).withColumn("window", F.substring("stretch", 1, 4)).join(lookup, "window")
             .filter(F.startswith("stretch", "word")).groupBy(*ids, "question_id").agg(F.min("place").alias("place")))
    picked = _first_k(found, ids, ["place", "question_id"], k).select(*ids, "position", "question_id")
    if not defaults:
        return picked
    fallback = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(q).alias("question_id")) for i, q in enumerate(defaults)]))
    rest = requests.select(*ids).join(picked.select(*ids).distinct(), ids, "left_anti").select(*ids, fallback.alias("x"))
    return picked.unionByName(rest.select(*ids, "x.position", "x.question_id"))


def valid_measures(requests: DataFrame, request: str, ordinal: str, measure: str, catalog: DataFrame, k: int = rules.MAX_MEASURES) -> DataFrame:
    """Requested measures that exist, once each, at most k in request order; the first is the primary one.

    Repeats collapse before ranking, so a request's group is never larger than the catalogue.
    """
    named = requests.select(request, ordinal, F.upper(F.trim(measure)).alias("question_id"))
    known = named.join(stats.dimension(catalog.select("question_id")), "question_id", "left_semi")
    once = known.groupBy(request, "question_id").agg(F.min(ordinal).alias("place"))
    return (_first_k(once, [request], ["place", "question_id"], k)
            .select(request, "position", "question_id", (F.col("position") == 1).alias("is_primary")))


def _first_k(df: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("position", rank).filter(F.col("position") <= k)

"""Spine, crosswalk, normalised-key and external joins; optional filters."""

from __future__ import annotations

from collections.abc import Sequence

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright import rules
from martwright.functions import numeric as num
from martwright.operators import stats

_AGGREGATES = {"mean": F.avg, "avg": F.avg, "sum": F.sum, "count": F.count}


def keep_codes(df: DataFrame, column: str, codes) -> DataFrame:
    """Rows whose code is in the list."""
    return df.filter(F.col(column).isin(*codes))


def drop_codes(df: DataFrame, column: str, codes) -> DataFrame:
    """Rows whose code is not in the list; a missing code stays."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*codes))


def where_equal(df: DataFrame, wanted: Mapping[str, object | None]) -> DataFrame:
    """Rows that equal every given value; parameters left empty do not filter."""
    tests = [F.col(c) == F.lit(v) for c, v in wanted.items() if v not in (None, "")]
    return df.filter(num.all_of(tests)) if tests else df


def group_sum_distinct(df: DataFrame, key: str, amount: str, counted: str, sum_as: str, distinct_as: str) -> DataFrame:
    """Sum and distinct count per key; missing keys drop out, an all-missing sum is 0."""
    return (df.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias(sum_as), F.countDistinct(counted).alias(distinct_as)))


def group_by_op(df: DataFrame, key: str, column: str, op: str, name: str) -> DataFrame:
    """One aggregate per key, chosen by name; unknown names mean the average."""
    return df.groupBy(key).agg(_AGGREGATES.get(op.lower(), F.avg)(column).alias(name))


def group_by_ops(df: DataFrame, key: str, column: str, ops: Sequence[str], name: str) -> DataFrame:
    """``group_by_op`` for several operations in one aggregate: a row per key and operation."""
    found = df.groupBy(key).agg(*[_AGGREGATES.get(op.lower(), F.avg)(column).cast("double").alias(f"o{i}") for i, op in enumerate(ops)])
    each = F.explode(F.array(*[F.struct(F.lit(op).alias("op"), F.col(f"o{i}").alias(name)) for i, op in enumerate(ops)]))
    return found.select(key, each.alias("x")).select(key, "x.op", f"x.{name}")


def spine_join(spine: DataFrame, measures: DataFrame, key: str, checked: bool = True) -> DataFrame:
    """Every key of the spine once, with the measures that exist for it.

    A key with several rows of measures would multiply the spine: that is found first and refused, unless the caller
    knows better.  The planner broadcasts whichever side proves small at run time.
    """
    if checked and (twice := measures.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()) is not None:
        raise ValueError(f"several rows of measures for key {twice[key]!r}")
    return spine.join(measures, key, "left")


def crosswalk_join(df: DataFrame, crosswalk: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Look up codes in a small dimension; ``inner`` drops rows without a match."""
    return df.join(stats.small_side(crosswalk), on, how)


def state_crosswalk(spark: SparkSession) -> DataFrame:
    """Code, abbreviation and name of the canonical keys."""
    return spark.createDataFrame(list(rules.STATES), "state_fips string, state_abbr string, state_name string")


def spellings(dimension: DataFrame, key: str, *columns: str) -> DataFrame:
    """Every accepted spelling of a key, lower-cased and trimmed, with the key it stands for; of several the smallest."""
    each = F.explode(F.array(*[F.lower(F.trim(F.col(c).cast("string"))) for c in columns]))
    return dimension.select(each.alias("spelling"), key).filter(F.col("spelling").isNotNull()).groupBy("spelling").agg(F.min(key).alias(key))


def normalize_key(df: DataFrame, raw: str, dimension: DataFrame, key: str, *columns: str) -> DataFrame:
    """Attach the key any accepted spelling in ``raw`` stands for; rows without one drop out."""
    crosswalk = stats.small_side(spellings(dimension, key, *columns))
    return (df.withColumn("spelling", F.lower(F.trim(F.col(raw).cast("string"))))
            .join(crosswalk, "spelling").drop("spelling"))


def external_measure(df: DataFrame, raw_key: str, column: str, op: str, dimension: DataFrame, key: str, *columns: str,
                     name: str) -> DataFrame:
    """One value per key from an onboarded table: keys are normalised before aggregating."""
    keyed = normalize_key(df, raw_key, dimension, key, *columns)
    value = _AGGREGATES.get(op.lower(), F.avg)(column)
    return keyed.groupBy(key).agg(F.round(value.cast("double"), 2).alias(name))


def external_column(table: str, column: str) -> str:
    """Mart column name of an external metric (from names, not data)."""
    base = "_".join(p for p in "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in f"{table}_{column}".lower()).split())
    return f"ext_{base}"[:60]



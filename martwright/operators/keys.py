"""Finding a table's key column and judging whether it can join a mart."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright import rules
from martwright.functions import numeric as num
from martwright.functions import text as txt
from martwright.operators import stats
from martwright.operators.stats import quoted

def key_candidates(tables: dict[str, DataFrame], spellings: DataFrame) -> DataFrame:
    """Per string column of every table: distinct normalised values and how many of them are known keys.

    One long table of digests serves all tables: values are counted exactly, by 128 bits, and no text is shuffled.
    Columns without values are left out.  Columns: table_name, ordinal, column, values_n, hits.
    """
    cells = []
    for table, df in tables.items():
        structs = [_cell(table, i, c) for i, c in enumerate(stats.columns_of(df, num.is_text))]
        if structs:
            cells.append(df.selectExpr(f"inline(array({', '.join(structs)}))"))
    if not cells:
        return spellings.sparkSession.createDataFrame([], "table_name string, ordinal int, column string, values_n long, hits long")
    digest = stats.text_key("spelling", heads=False)
    known = stats.small_side(spellings.selectExpr(*[f"{text} AS {d}" for d, text in digest.items()], "1 AS known").distinct())
    values = reduce(DataFrame.unionByName, cells).filter("d0 IS NOT NULL").distinct()
    return (values.join(known, list(digest), "left").groupBy("table_name", "ordinal", "column")
            .agg(F.count(F.lit(1)).alias("values_n"), F.count("known").alias("hits")))


def _cell(table: str, ordinal: int, column: str) -> str:
    digest = stats.text_key(f"lower(trim({stats.ident(column)}))", heads=False)
    return (f"named_struct('table_name', {num.sql_literal(table)}, 'ordinal', {ordinal}, 'column', {num.sql_literal(column)}, "
            + ", ".join(f"'{d}', {text}" for d, text in digest.items()) + ")")


def key_columns(tables: dict[str, DataFrame], spellings: DataFrame) -> DataFrame:
    """Per table the column with most known keys among those that mostly hold keys, ties to the first; no row without one."""
    share = F.try_divide(F.col("hits").cast("double"), F.col("values_n").cast("double"))
    best = F.max_by(F.struct("ordinal", "column", "values_n", "hits"), F.struct("hits", -F.col("ordinal")))
    return (key_candidates(tables, spellings).filter((F.col("hits") > 0) & (share >= rules.KEY_HIT_RATIO))
            .groupBy("table_name").agg(best.alias("best")).select("table_name", "best.*"))


def is_metric_name(name: str) -> bool:
    """Whether a numeric column's name reads like a metric rather than an identifier."""
    return not name.lower().endswith(rules.NOT_A_METRIC_HINTS)


def numeric_summary(df: DataFrame) -> DataFrame:
    """Min, max and mean of every numeric column, in one pass."""
    df = stats.normalize_nan(df)
    names = stats.columns_of(df, num.is_number)
    if not names:
        return df.sparkSession.createDataFrame([], "ordinal int, column string, min double, max double, mean double")
    return stats.long_stats(df, [
        {"ordinal": str(i), "column": num.sql_literal(c), "min": f"CAST(min({stats.ident(c)}) AS DOUBLE)",
         "max": f"CAST(max({stats.ident(c)}) AS DOUBLE)", "mean": f"round(avg({stats.ident(c)}), 4)"} for i, c in enumerate(names)])


def source_profiles(tables: dict[str, DataFrame], spellings: DataFrame) -> DataFrame:
    """One row per table: can it join the mart by key, and would its metrics be of use?"""
    rows = []
    for table, df in tables.items():
        numbers = stats.columns_of(df, num.is_number)
        topical = any(h in c.lower() for c in df.columns for h in rules.TOPIC_HINTS)
        rows.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(table).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_fields"),
            F.lit(any(is_metric_name(c) for c in numbers)).alias("has_metrics"), F.lit(topical).alias("topical")))
    key = key_columns(tables, spellings).select("table_name", F.col("column").alias("key_column"), F.col("values_n").alias("n_keys"))
    has_key, n_keys = F.col("key_column").isNotNull(), F.coalesce("n_keys", F.lit(0))
    joinable = has_key & (n_keys >= rules.JOINABLE_MIN_KEYS)
    return reduce(DataFrame.unionByName, rows).join(key, "table_name", "left").select(
        "table_name", "n_rows", "n_fields", "key_column", n_keys.alias("n_keys"), joinable.alias("joinable"),
        (joinable & F.col("has_metrics") & F.col("topical")).alias("relevant"), _reason(has_key, joinable).alias("reason"))


def source_metrics(tables: dict[str, DataFrame], profiles: DataFrame) -> DataFrame:
    """The metrics the relevant tables would add, a row each: table_name, ordinal, column, aggregation, meaning."""
    rows = [(table, i, c, "mean", f"average {c.replace('_', ' ')} per key") for table, df in tables.items()
            for i, c in enumerate(c for c in stats.columns_of(df, num.is_number) if is_metric_name(c))]
    named = profiles.sparkSession.createDataFrame(rows, "table_name string, ordinal int, column string, aggregation string, meaning string")
    return named.join(profiles.filter("relevant").select("table_name"), "table_name", "left_semi")


def _reason(has_key: Column, joinable: Column) -> Column:
    return (F.when(~has_key, "No key column detected, so it cannot be joined to the mart.")
            .when(~F.col("has_metrics"), "A key column is present, but no numeric metric to aggregate per key.")
            .when(~F.col("topical"), "A key column and numbers, but nothing related to the mart's topic.")
            .when(~joinable, "Related in content, but it covers too few keys.")
            .otherwise("Keys to the mart and carries metrics to aggregate per key."))


def rank_profiles(profiles: DataFrame) -> DataFrame:
    """Useful sources first, then by rows."""
    return profiles.orderBy(F.desc("relevant"), F.desc("n_rows"), F.asc("table_name"))


def metric_words(c: Column) -> Column:
    """Words of a metric's name and meaning that may drive a suggestion."""
    return F.array_except(txt.tokens(c), F.array(*[F.lit(w) for w in rules.SUGGESTION_STOP_WORDS]))

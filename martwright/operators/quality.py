"""Named checks, score, grade, gate and triage as DataFrames.

A check row is ordinal, check, passed, value, threshold, detail (the last three as text).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright import rules
from martwright.functions import numeric as num
from martwright.functions import text as txt
from martwright.operators import stats
from martwright.operators.stats import quoted
from martwright.session import stage

# Checks of each family start at these ordinals, in the order they are reported.
_COMPLETENESS, _DUPLICATES, _NULLS, _TYPES, _RANGES, _UNIQUE, _MART = 0, 1, 1000, 20000, 40000, 60000, 80000


def _check(ordinal: Column, name: Column, passed: Column, value: Column, threshold: Column, detail: Column) -> list[Column]:
    return [ordinal.cast("int").alias("ordinal"), name.alias("check"), passed.alias("passed"),
            value.cast("string").alias("value"), threshold.cast("string").alias("threshold"), detail.alias("detail")]


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def column_stats(df: DataFrame) -> DataFrame:
    """Everything the per-column checks need, in one pass over the data: one row per column."""
    df = stats.normalize_nan(df)
    rows = []
    for i, f in enumerate(df.schema):
        c, is_number = stats.ident(f.name), num.is_number(f.dataType)
        v = f"CAST({c} AS DOUBLE)"
        rows.append({
            "i": str(i), "column": num.sql_literal(f.name), "n": "count(1)", "filled": f"count({c})",
            "numbers": f"count({num.safe_numeric_sql(c)})" if num.is_text(f.dataType) else "CAST(NULL AS BIGINT)",
            "negatives": f"count_if({v} < 0)" if is_number else "CAST(NULL AS BIGINT)",
            "mean": f"avg({num.finite_sql(v)})" if is_number else "CAST(NULL AS DOUBLE)",
            "std": f"stddev_samp({num.finite_sql(v)})" if is_number else "CAST(NULL AS DOUBLE)"})
    return stats.long_stats(df, rows)


def completeness(df: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Share of filled cells is high enough."""
    seen = column_stats(df) if seen is None else seen
    raw = F.coalesce(F.try_divide(F.col("filled") * 100.0, F.col("cells").cast("double")), F.lit(0.0))
    return seen.agg(F.sum("filled").alias("filled"), F.sum("n").alias("cells")).select(*_check(
        F.lit(_COMPLETENESS), F.lit("overall_completeness"), raw >= rules.MIN_COMPLETENESS_PCT, F.round(raw, 2),
        F.lit(rules.MIN_COMPLETENESS_PCT), _text(F.round(raw, 1).cast("string"), "% complete")))


def duplicates(df: DataFrame) -> DataFrame:
    """Share of repeated rows is low enough."""
    counted = stats.duplicate_count(stats.normalize_nan(df))
    raw = F.coalesce(F.try_divide(F.col("duplicate_rows") * 100.0, F.col("row_count").cast("double")), F.lit(0.0))
    return counted.select(*_check(
        F.lit(_DUPLICATES), F.lit("duplicate_rows"), raw <= rules.MAX_DUPLICATE_PCT, F.round(raw, 2),
        F.lit(rules.MAX_DUPLICATE_PCT), _text(F.col("duplicate_rows").cast("string"), " duplicates")))


def null_rates(df: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Each column's share of missing values is low enough."""
    seen = column_stats(df) if seen is None else seen
    raw = F.coalesce(F.try_divide((F.col("n") - F.col("filled")) * 100.0, F.col("n").cast("double")), F.lit(0.0))
    return seen.select(*_check(
        F.col("i") + _NULLS, _text("null_rate_", F.col("column")), raw <= rules.MAX_NULL_PCT, F.round(raw, 2),
        F.lit(rules.MAX_NULL_PCT), _text("Column '", F.col("column"), "': ", F.round(raw, 1).cast("string"), "% null")))


def type_mix(df: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """No string column mixes numbers and other text; columns without values are skipped."""
    seen = column_stats(df) if seen is None else seen
    share = F.col("numbers") / F.col("filled").cast("double")
    mixed = (share > rules.MIXED_LOW) & (share < rules.MIXED_HIGH)
    return seen.filter(F.col("numbers").isNotNull() & (F.col("filled") > 0)).select(*_check(
        F.col("i") + _TYPES, _text("type_consistency_", F.col("column")), ~mixed,
        _text(F.col("numbers").cast("string"), "/", F.col("filled").cast("string"), " numeric"), F.lit("< 10% or > 90% numeric"),
        _text("Column '", F.col("column"), "': ", F.when(mixed, "MIXED").otherwise("consistent"))))


def no_negatives(df: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Columns whose name promises a positive number hold no negative one."""
    seen = column_stats(df) if seen is None else seen
    promised = txt.contains_any(F.lower("column"), rules.POSITIVE_HINTS)
    bad = F.col("negatives")
    return seen.filter(bad.isNotNull() & (F.col("filled") > 0) & promised).select(*_check(
        F.col("i") * 2 + _RANGES, _text("no_negatives_", F.col("column")), bad == 0, bad, F.lit(0),
        _text("Column '", F.col("column"), "': ", bad.cast("string"), " negative values found")))


def extreme_outliers(df: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """No value lies more than five standard deviations from the mean, both of the finite values; constant columns are skipped."""
    df = stats.normalize_nan(df)
    seen = column_stats(df) if seen is None else seen
    # One row per column reaches the driver; the second pass over the data then needs no join.
    spread = seen.filter("std > 0").select("i", "column", "mean", "std").collect()
    rows = [{"i": str(r["i"]), "column": num.sql_literal(r["column"]),
             "bad": f"count_if(abs((CAST({stats.ident(r['column'])} AS DOUBLE) - {num.double_literal(r['mean'])}) / {num.double_literal(r['std'])}) > {rules.EXTREME_STD})"}
            for r in spread]
    if not rows:
        return _no_checks(df)
    return stats.long_stats(df, rows).select(*_check(
        F.col("i") * 2 + 1 + _RANGES, _text("extreme_outliers_", F.col("column")), F.col("bad") == 0, F.col("bad"),
        F.lit(f"> {rules.EXTREME_STD} std deviations"),
        _text("Column '", F.col("column"), "': ", F.col("bad").cast("string"), " extreme outliers")))


def uniqueness(df: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Identifier-like columns that are mostly unique are fully unique; a null breaks that."""
    df = stats.normalize_nan(df)
    names = [c for c in df.columns if any(h in c.lower() for h in rules.IDENTIFIER_HINTS)]
    if not names:
        return _no_checks(df)
    seen = column_stats(df.select(*[quoted(c) for c in names])) if seen is None else seen
    distinct = stats.distinct_counts(df, names).select("column", F.col("unique_count").alias("k"))
    mostly = F.try_divide(F.col("k").cast("double"), F.col("n").cast("double")) > rules.UNIQUENESS_TEST_RATIO
    return seen.join(distinct, "column").filter(mostly).select(*_check(
        F.col("i") + _UNIQUE, _text("uniqueness_", F.col("column")), F.col("k") == F.col("n"), F.col("k"), F.col("n"),
        _text("Column '", F.col("column"), "': ", F.col("k").cast("string"), "/", F.col("n").cast("string"), " unique")))


def _no_checks(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "ordinal int, check string, passed boolean, value string, threshold string, detail string")


def scorecard(df: DataFrame) -> DataFrame:
    """All checks of one dataset as rows.

    The per-column statistics are one staged pass; besides it the data is read once
    each for duplicates, extreme values and identifier uniqueness.
    """
    seen = stage(column_stats(df), "column-stats")
    parts = [completeness(df, seen), duplicates(df), null_rates(df, seen), type_mix(df, seen),
             no_negatives(df, seen), extreme_outliers(df, seen), uniqueness(df, seen)]
    return reduce(DataFrame.unionByName, parts)


def summarize(checks: DataFrame) -> DataFrame:
    """One row: totals, score and grade of a set of checks."""
    passed, total = F.count_if(F.col("passed")), F.count(F.lit(1))
    score = num.percentage(F.col("checks_passed"), F.col("total_checks"))
    return (checks.agg(total.alias("total_checks"), passed.alias("checks_passed"))
            .select("total_checks", "checks_passed", (F.col("total_checks") - F.col("checks_passed")).alias("checks_failed"),
                    score.alias("score"))
            .withColumn("grade", num.grade(F.col("score"))))


def gate_blocks(grade: Column, minimum: str) -> Column:
    """Whether a grade is worse than the minimum for loading."""
    return num.grade_rank(grade) < rules.GRADE_RANK.get(minimum, 0)


def by_dimension(checks: DataFrame) -> DataFrame:
    """Checks passed and total per quality dimension."""
    return (checks.groupBy(txt.check_dimension(F.col("check")).alias("dimension"))
            .agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"),
                 F.min("ordinal").alias("first_ordinal")))


def dimension_details(checks: DataFrame) -> DataFrame:
    """Every check under its quality dimension, with its place there: dimension, place, check, passed, detail."""
    dimension = txt.check_dimension(F.col("check"))
    place = F.row_number().over(Window.partitionBy("dimension").orderBy("ordinal", "check"))  # a few checks per column
    return checks.withColumn("dimension", dimension).select("dimension", place.alias("place"), "check", "passed", "detail")


def mart_checks(mart: DataFrame, spine_rows: int, population: str, bands: list[str], per_capita: str,
                measures: list[str], allowed_gaps: int = 5) -> DataFrame:
    """Invariants of a mart, in one pass: grain, population, sanity bands, spend, coverage."""
    def row(ordinal, name, passed, value, threshold, what):
        return {"ordinal": F.lit(_MART + ordinal), "check": F.lit(name), "passed": passed, "value": value.cast("string"),
                "threshold": F.lit(str(threshold)), "detail": F.concat(value.cast("string"), F.lit(f" {what}"))}

    n = F.count(F.lit(1))
    bad_population = F.count_if(F.coalesce(F.col(population), F.lit(0)) <= 0)
    bad_spend = F.count_if(F.coalesce(F.col(per_capita), F.lit(0.0)) < 0)
    gaps = F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in measures]))
    rows = [row(0, "mart_row_count", n == spine_rows, n, spine_rows, "rows"),
            row(1, "mart_population_positive", bad_population == 0, bad_population, 0, "keys with non-positive population")]
    for i, c in enumerate(bands):
        outside = F.count_if((F.col(c) < 0) | (F.col(c) > 60))
        rows.append(row(2 + i, f"mart_{c}_band_0_60", outside == 0, outside, 0, "keys outside the sanity band"))
    rows += [row(100, "mart_spend_per_capita_nonneg", bad_spend == 0, bad_spend, 0, "keys with negative spend"),
             row(101, f"mart_missing_measures_le{allowed_gaps}", gaps <= allowed_gaps, gaps, allowed_gaps, "keys with a missing measure")]
    return stats.long_stats(mart, rows)


def triage(issues: DataFrame, checks: DataFrame) -> DataFrame:
    """Profile issues and failed checks in one list, worst first: position, label, kind, title, column, check_name."""
    severity = F.col("severity")

    def pick(slot: int) -> Column:
        hits = [F.when(severity == entry[0], F.lit(entry[slot])) for entry in rules.ISSUE_SEVERITY]
        return F.coalesce(*hits, F.lit(rules.ISSUE_SEVERITY[-1][slot]))

    from_profile = issues.select(F.lit(0).alias("part"), "ordinal", severity.alias("severity"), F.col("issue").alias("check"), "column",
                                 F.concat_ws("_", "issue", "column").alias("check_name"))
    from_checks = checks.filter(~F.col("passed")).select(
        F.lit(1).alias("part"), "ordinal", F.lit("fail").alias("severity"), "check",
        txt.check_column(F.col("check")).alias("column"), F.col("check").alias("check_name"))
    return (from_profile.unionByName(from_checks)
            .select(pick(1).alias("rank"), pick(2).alias("label"), pick(3).alias("kind"),
                    F.replace(F.col("check"), F.lit("_"), F.lit(" ")).alias("title"), "column", "check_name", "part", "ordinal")
            .orderBy("rank", "part", "ordinal", "check_name"))


def triage_top(checks: DataFrame, n: int = 5) -> DataFrame:
    """The n most severe failed checks with an explanation and a suggested fix."""
    check = F.col("check")
    return (checks.filter(~F.col("passed"))
            .select(txt.check_severity(check).alias("severity"), "ordinal", "check",
                    txt.explain_check(check).alias("explanation"), txt.suggest_fix(check).alias("suggested_fix"))
            .orderBy("severity", "ordinal").limit(n))

"""Column profiles, issues, correlations and personal-data findings, as long tables.

Two small tables hold nearly everything: ``column_facts`` (one aggregate pass) and
``value_facts`` (one shuffle of distinct values).  Each section is a projection of
them; a full profile stages both once and derives every section from there.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright import rules
from martwright.functions import numeric as num
from martwright.operators import stats
from martwright.operators.stats import ident, quoted
from martwright.session import stage

_NUMERIC_SCHEMA = ("ordinal int, column string, mean double, median double, std double, min double, max double, q1 double, q3 double, "
                   "iqr double, outlier_count bigint, skewness double")
ALL_PARTS = ("numbers", "lengths", "dates", "pii")
TOP_K = 5


def column_facts(df: DataFrame, parts: tuple[str, ...] = ALL_PARTS) -> DataFrame:
    """One row per column with every statistic a single pass can give; ``parts`` narrows it."""
    df = stats.normalize_nan(df)
    rows = []
    for i, f in enumerate(df.schema):
        c = ident(f.name)
        row = {"ordinal": str(i), "column": num.sql_literal(f.name), "dtype": num.sql_literal(num.type_family(f.dataType)),
               "row_count": "count(1)", "null_count": f"count_if({c} IS NULL)"}
        if "numbers" in parts:
            row |= _number_facts(f"CAST({c} AS DOUBLE)" if num.is_number(f.dataType) else None)
        if "lengths" in parts:
            row |= _length_facts(c if num.is_text(f.dataType) else None)
        if "dates" in parts:
            row |= _date_facts(c if num.is_moment(f.dataType) else None)
        if "pii" in parts:
            row |= _pii_facts(stats.text_sql(c, f.dataType))
        rows.append(row)
    return stats.long_stats(df, rows)


def _number_facts(v: str | None) -> dict[str, str]:
    texts = {"mean": "avg({f})", "std": "stddev_samp({f})", "min": "min({v})", "max": "max({v})",
             # Spark's skewness is the population one; the factor makes it the sample one.
             "skewness": "CASE WHEN count({f}) > 2 THEN skewness({f}) * sqrt(count({f}) * (count({f}) - 1.0D)) / (count({f}) - 2.0D) END"}
    return {k: t.format(v=v, f=num.finite_sql(v)) if v else "CAST(NULL AS DOUBLE)" for k, t in texts.items()}


def _length_facts(c: str | None) -> dict[str, str]:
    texts = {"avg_length": ("avg(length({c}))", "DOUBLE"), "min_length": ("min(length({c}))", "INT"),
             "max_length": ("max(length({c}))", "INT"), "empty_count": ("count_if({c} = '')", "BIGINT")}
    return {k: t.format(c=c) if c else f"CAST(NULL AS {kind})" for k, (t, kind) in texts.items()}


def _date_facts(c: str | None) -> dict[str, str]:
    return {f"{f}_date": f"CAST({f}({c}) AS TIMESTAMP_NTZ)" if c else "CAST(NULL AS TIMESTAMP_NTZ)" for f in ("min", "max")}


def _pii_facts(v: str) -> dict[str, str]:
    codes = ", ".join(num.sql_literal(abbr) for _, abbr, _ in rules.STATES)
    names = ", ".join(num.sql_literal(name.lower()) for _, _, name in rules.STATES)
    longest = max(len(name) for _, _, name in rules.STATES)
    row = {"values_n": f"count({v})", "filled": f"count_if(trim({v}) <> '')",
           "states": f"count_if(length(trim({v})) <= {longest} AND (upper(trim({v})) IN ({codes}) OR lower(trim({v})) IN ({names})))",
           "persons": f"count_if(trim({v}) RLIKE {num.sql_literal(rules.PERSON_NAME_PATTERN)})"}
    # A cheap test every match must pass spares most long texts the full pattern.
    digits = f"{v} RLIKE {num.sql_literal(chr(92) + 'd{3}')}"
    needs = {"email": f"contains({v}, '@')", "phone": digits, "ssn": digits, "npi": f"length({v}) <= 11"}
    return row | {kind: f"count_if({needs[kind]} AND {v} RLIKE {num.sql_literal(p)})" for kind, p in rules.PII_VALUE_PATTERNS}


def value_facts(df: DataFrame, top: int = TOP_K, samples: int = 3) -> DataFrame:
    """One row per column with values: filled cells, distinct count, top values, smallest samples; with none of a kind asked for, no value is ranked for it.

    All come from one count of distinct values, whose shuffle the branches share.
    Rank filters are pushed below the next shuffle, so a ranking task gets a few rows per
    column and task, never all values.  Texts alike in their first ``stats.TEXT_HEAD`` characters are ordered by digest.
    """
    df = stats.normalize_nan(df)
    # Every count is positive, but a branch that needs none would group the values apart from the others.
    counted = stats.value_counts(df, df.columns).filter("n > 0")
    totals = counted.groupBy("ordinal", "column").agg(F.count(F.lit(1)).alias("unique_count"), F.sum("n").alias("filled_count"))
    frequent = Window.partitionBy("ordinal").orderBy(F.desc("n"), *stats.text_order(), "whole", "real")
    smallest = Window.partitionBy("ordinal").orderBy("whole", "real", *stats.text_order())

    def first(kind: str, w, k: int) -> DataFrame:
        return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("kind", F.lit(kind))

    ranked = [first(kind, w, k) for kind, w, k in (("top", frequent, top), ("samples", smallest, samples)) if k] or [first("top", frequent, 0)]
    shown = stats.whole_texts(df, df.columns, reduce(DataFrame.unionByName, ranked))
    entry = F.struct("rank", "value", "n")
    lists = shown.groupBy("ordinal").agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == k, entry))).alias(k) for k in ("top", "samples")])
    return totals.join(lists, "ordinal", "left")


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, duplicate rows and their share, completeness.

    Completeness comes from the same grouping that finds the duplicates: a group's
    filled cells times its size, so the data is shuffled once.
    """
    df = stats.normalize_nan(df)
    filled = F.expr(" + ".join(f"CAST({ident(c)} IS NOT NULL AS BIGINT)" for c in df.columns))
    width = len(df.columns)
    groups = df.groupBy(*stats.row_digest(df)).agg(F.count(F.lit(1)).alias("__n"), F.max(filled).alias("__filled"))
    totals = groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"),
                        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"),
                        F.coalesce(F.sum(F.col("__filled") * F.col("__n")), F.lit(0)).alias("filled"))
    return totals.select(
        "row_count", F.lit(width).alias("column_count"), "duplicate_rows",
        num.percentage(F.col("duplicate_rows"), F.col("row_count")).alias("duplicate_pct"),
        num.percentage(F.col("filled"), F.col("row_count") * width).alias("completeness"))


def _distinct(df: DataFrame, values: DataFrame | None, approx: bool = False) -> DataFrame:
    source = stats.distinct_counts(stats.normalize_nan(df), df.columns, approx) if values is None else values
    return source.select("ordinal", "unique_count")


def columns(df: DataFrame, approx: bool = False, facts: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """Per column: ordinal, column, dtype, row_count, null_count, null_pct, unique_count."""
    facts = column_facts(df, ()) if facts is None else facts
    return (facts.join(_distinct(df, values, approx), "ordinal", "left")
            .select("ordinal", "column", "dtype", "row_count", "null_count",
                    num.percentage(F.col("null_count"), F.col("row_count")).alias("null_pct"),
                    F.coalesce("unique_count", F.lit(0)).alias("unique_count")))


def numeric(df: DataFrame, names: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Per numeric column: moments, quartiles, outliers outside the IQR fences, sample skewness.

    Infinities are values for range and quartiles and always outliers; mean, deviation and skewness are of the
    finite values.  Without a numeric column the table is empty.
    """
    df = stats.normalize_nan(df)
    names = names or stats.columns_of(df, num.is_number)
    if not names:
        return df.sparkSession.createDataFrame([], _NUMERIC_SCHEMA)
    quartiles = stats.quantiles(df, names, [0.25, 0.5, 0.75], approx)
    rows = []
    for ordinal, name in enumerate(names):
        q1, q2, q3 = quartiles[name]
        v = f"CAST({ident(name)} AS DOUBLE)"
        known = q1 is not None and math.isfinite(q1) and math.isfinite(q3)
        low, high = (num.double_literal(x) for x in ((q1 - rules.IQR_FACTOR * (q3 - q1), q3 + rules.IQR_FACTOR * (q3 - q1)) if known else (-sys.float_info.max, sys.float_info.max)))
        m = _number_facts(v)
        rows.append({
            "ordinal": str(ordinal), "column": num.sql_literal(name), "mean": f"round({m['mean']}, 4)", "median": _rounded(q2),
            "std": f"round({m['std']}, 4)", "min": m["min"], "max": m["max"], "q1": _rounded(q1), "q3": _rounded(q3),
            "iqr": _rounded(q3 - q1 if known else None),
            "outlier_count": f"count_if({v} < {low} OR {v} > {high})", "skewness": f"round({m['skewness']}, 4)"})
    return stats.long_stats(df, rows)


def _rounded(x: float | None) -> str:
    return num.double_literal(x) if x is None or not math.isfinite(x) else f"round({num.double_literal(x)}, 4)"


def _some(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns; without any the first one, so that a table of no rows keeps its schema."""
    return df.select(*[quoted(c) for c in names or df.columns[:1]])


def strings(df: DataFrame, facts: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """Per string column: length statistics, empty values, whether it looks like an identifier."""
    if facts is None:
        df = _some(df, stats.columns_of(df, num.is_text))
        facts = column_facts(df, ("lengths",))
    share = F.try_divide(F.coalesce("unique_count", F.lit(0)).cast("double"), F.col("row_count").cast("double"))
    return (facts.filter("dtype = 'VARCHAR'").join(_distinct(df, values), "ordinal", "left")
            .select("ordinal", "column", F.round("avg_length", 2).alias("avg_length"), "min_length", "max_length", "empty_count",
                    F.coalesce(share > rules.ID_UNIQUE_RATIO, F.lit(False)).alias("looks_like_id")))


def moments_in_time(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Per date or time column: first, last, and whole elapsed days between them."""
    if facts is None:
        facts = column_facts(_some(df, stats.columns_of(df, num.is_moment)), ("dates",))
    return (facts.filter("dtype = 'TIMESTAMP'").select("ordinal", "column", "min_date", "max_date")
            .withColumn("range_days", num.age_days(F.col("min_date"), F.col("max_date"))))


def top_values(df: DataFrame, k: int = TOP_K, facts: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """The k most frequent values of each string column; ties by value, of texts alike in their first characters by digest."""
    if values is not None:
        texts = facts.filter("dtype = 'VARCHAR'").select("ordinal")
        return (values.join(texts, "ordinal", "left_semi").select("column", F.inline("top"))
                .select("column", "rank", "value", F.col("n").alias("occurrences")))
    names = stats.columns_of(df, num.is_text)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, rank int, value string, occurrences bigint")
    df = df.select(*[quoted(c) for c in names])
    w = Window.partitionBy("ordinal").orderBy(F.desc("n"), *stats.text_order())
    picked = stats.value_counts(df, names).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return stats.whole_texts(df, names, picked).select("column", "rank", "value", F.col("n").alias("occurrences"))


def issues(df: DataFrame, facts: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """High null rates, constant columns and possible identifiers: ordinal, column, issue, severity, detail."""
    values = value_facts(df) if values is None else values
    facts = column_facts(df, ()) if facts is None else facts
    only = F.element_at("samples", 1)["value"]
    base = facts.join(values.select("ordinal", "unique_count", only.alias("only_value")), "ordinal", "left")
    null_share = F.try_divide(F.col("null_count") * 100.0, F.col("row_count").cast("double"))
    unique_share = F.try_divide(F.col("unique_count").cast("double"), F.col("row_count").cast("double"))

    def issue(kind: str, severity: Column, detail: Column) -> Column:
        return F.struct(F.lit(kind).alias("issue"), severity.alias("severity"), detail.alias("detail"))

    found = F.array_compact(F.array(
        F.when(null_share > rules.MAX_NULL_PCT,
               issue("high_null_rate", F.when(null_share > rules.CRITICAL_NULL_PCT, "critical").otherwise("warning"),
                     F.concat(F.round(null_share, 1).cast("string"), F.lit("% null")))),
        F.when(F.col("unique_count") == 1,
               issue("constant_column", F.lit("info"), F.concat(F.lit("Only value: "), F.col("only_value")))),
        F.when((unique_share > rules.ID_UNIQUE_RATIO) & (F.col("dtype") == "VARCHAR"),
               issue("possible_id_column", F.lit("info"),
                     F.concat(F.col("unique_count").cast("string"), F.lit(" unique out of "),
                              F.col("row_count").cast("string"), F.lit(" rows"))))))
    return base.select("ordinal", "column", F.inline(found))


def correlations(df: DataFrame, names: list[str] | None = None, above: float = rules.STRONG_CORRELATION,
                 digits: int = 4) -> DataFrame:
    """Pearson r of every pair of numeric columns once, over the rows where both are present, kept where ``|r| > above``.

    Two passes however many columns there are and whatever gaps they have: a first aggregate gives means and ranges, a second
    one the cross products of all pairs.  A pair with a constant column, or with an infinity among its rows, has no r.
    """
    df = stats.normalize_nan(df)
    names = names or stats.columns_of(df, num.is_number)
    empty = df.sparkSession.createDataFrame([], "column_1 string, column_2 string, correlation double")
    if len(names) < 2:
        return empty
    values = df.selectExpr(*[f"CAST({ident(c)} AS DOUBLE) AS c{i}" for i, c in enumerate(names)])
    seen = values.selectExpr(*[f"named_struct('m', avg({f}), 'a', min({f}), 'b', max({f})) AS s{i}" for i, f in enumerate(num.finite_sql(f"c{i}") for i in range(len(names)))]).first()
    used = [i for i in range(len(names)) if seen[f"s{i}"]["a"] is not None and seen[f"s{i}"]["a"] < seen[f"s{i}"]["b"]]
    if len(used) < 2:
        return empty
    # Shifted by the mean and brought to -1 .. 1, sums of squares neither overflow nor cancel.
    shifts = [seen[f"s{i}"]["m"] for i in used]
    scales = [max(seen[f"s{i}"]["b"] - m, m - seen[f"s{i}"]["a"]) for i, m in zip(used, shifts)]
    sums = _cross_sums(values.select(*[f"c{i}" for i in used]), shifts, scales).withColumns({
        "var_x": F.expr("xx - x * x / n"), "var_y": F.expr("yy - y * y / n"), "cov": F.expr("xy - x * y / n")})
    # Below this share of the sum of squares a variance is rounding error.
    r = F.when((F.col("infinite") == 0) & (F.col("var_x") > F.col("xx") * 1e-12) & (F.col("var_y") > F.col("yy") * 1e-12), F.col("cov") / F.sqrt(F.col("var_x") * F.col("var_y")))
    label = F.array(*[F.lit(names[i]) for i in used])
    return sums.withColumn("r", r).where(F.abs("r") > above).select(
        label[F.col("i")].alias("column_1"), label[F.col("j")].alias("column_2"), F.round("r", digits).alias("correlation"))


def _cross_sums(values: DataFrame, shifts: list[float], scales: list[float]) -> DataFrame:
    """For columns i < j, over the rows where both are present: ``n``, ``infinite`` rows, and sums ``x``, ``y``, ``xx``, ``yy``, ``xy`` of the shifted, scaled values.

    A task multiplies blocks of rows by their presence masks and emits one row per pair.
    """
    k = len(shifts)
    first, second = np.triu_indices(k, 1)
    schema = "i int, j int, n double, infinite double, x double, y double, xx double, yy double, xy double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products = np.zeros((5, k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            here, endless = ~np.isnan(x), np.isinf(x)
            with np.errstate(invalid="ignore"):
                z = np.where(here & ~endless, (x - shifts) / scales, 0.0)
            m = here.astype(float)
            for at, left, right in ((0, m, m), (1, endless.astype(float), m), (2, z, m), (3, z * z, m), (4, z, z)):
                products[at] += left.T @ right
        n, infinite, s, squares, cross = products
        pair = [n, infinite + infinite.T, s, s.T, squares, squares.T, cross]
        yield pa.RecordBatch.from_arrays([pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), *(pa.array(p[first, second]) for p in pair)],
                                         names=["i", "j", "n", "infinite", "x", "y", "xx", "yy", "xy"])

    sums = [F.sum(c).alias(c) for c in ("n", "infinite", "x", "y", "xx", "yy", "xy")]
    return values.mapInArrow(run, schema).groupBy("i", "j").agg(*sums).where("n > 1")


def pii_columns(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Columns that look like personal data: column, reason, confidence.  Every value is examined.

    Guards in order: mostly state names is geography; a clear name; values that match a
    pattern; an unclear name backed by values that look like person names.
    """
    facts = column_facts(df, ("pii",)) if facts is None else facts
    low = F.lower("column")

    def share(hits: str, of: str) -> Column:
        return F.coalesce(F.try_divide(F.col(hits).cast("double"), F.col(of).cast("double")), F.lit(0.0))

    def verdict(reason: str, confidence: str) -> Column:
        return F.struct(F.lit(reason).alias("reason"), F.lit(confidence).alias("confidence"))

    weak = F.coalesce(*[F.when(low.contains(h), verdict(f"name_hint:{h}", "medium")) for h in rules.PII_WEAK_HINTS])
    decision = F.when(share("states", "filled") < rules.PII_MOSTLY_RATIO, F.coalesce(
        *[F.when(low.contains(h), verdict(f"name_hint:{h}", "high")) for h in rules.PII_STRONG_HINTS],
        *[F.when(share(k, "values_n") > rules.PII_VALUE_RATIO, verdict(f"value_pattern:{k}", "medium")) for k, _ in rules.PII_VALUE_PATTERNS],
        F.when(share("persons", "filled") >= rules.PII_MOSTLY_RATIO, weak)))
    return (facts.withColumn("x", decision).filter(F.col("x").isNotNull())
            .select("ordinal", "column", "x.reason", "x.confidence"))


class Profile:
    """Every profile table of one dataset, computed when first asked for.

    The two fact tables are staged on first use; all sections but the overview, the
    quartiles and the correlations are projections of them.
    """

    def __init__(self, df: DataFrame, approx: bool = False):
        self.df, self.approx = df, approx

    @cached_property
    def facts(self) -> DataFrame:
        return stage(column_facts(self.df), "column-facts")

    @cached_property
    def values(self) -> DataFrame:
        return stage(value_facts(self.df), "value-facts")

    @cached_property
    def overview(self) -> DataFrame:
        return overview(self.df)

    @cached_property
    def columns(self) -> DataFrame:
        return columns(self.df, facts=self.facts, values=None if self.approx else self.values, approx=self.approx)

    @cached_property
    def issues(self) -> DataFrame:
        return issues(self.df, self.facts, self.values)

    @cached_property
    def correlations(self) -> DataFrame:
        return correlations(self.df)

    @cached_property
    def pii_columns(self) -> DataFrame:
        return pii_columns(self.df, self.facts)

    @cached_property
    def numeric(self) -> DataFrame | None:
        return numeric(self.df, approx=self.approx) if stats.columns_of(self.df, num.is_number) else None

    @cached_property
    def strings(self) -> DataFrame:
        return strings(self.df, self.facts, self.values)

    @cached_property
    def top_values(self) -> DataFrame:
        return top_values(self.df, facts=self.facts, values=self.values)

    @cached_property
    def moments(self) -> DataFrame:
        return moments_in_time(self.df, self.facts)

    SECTIONS = ("overview", "columns", "numeric", "strings", "moments", "issues", "correlations", "pii_columns", "top_values")

    def tables(self) -> dict[str, DataFrame]:
        named = {s: getattr(self, s) for s in self.SECTIONS}
        return {s: table for s, table in named.items() if table is not None}

    def as_facts(self) -> DataFrame:
        """All sections as one long table: section, column, metric, value (text)."""
        parts = []
        for section, table in self.tables().items():
            label = "column" if "column" in table.columns else "CAST('' AS STRING) AS column"
            cells = ", ".join(f"named_struct('metric', '{m}', 'value', CAST({ident(m)} AS STRING))" for m in table.columns if m not in ("ordinal", "column"))
            parts.append(table.selectExpr(f"'{section}' AS section", label, f"inline(array({cells}))"))
        return reduce(DataFrame.unionByName, parts)

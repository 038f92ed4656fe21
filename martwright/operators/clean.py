"""The cleaning steps: names, duplicates, types, nulls, text, load metadata.

Steps whose result depends on the data first run one aggregate that returns a single
row of scalars, then build a lazy projection from it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright import rules
from martwright.functions import numeric as num
from martwright.functions import text as txt
from martwright.operators import stats
from martwright.operators.stats import quoted
from martwright.session import rows_seen, stage

STEPS = ("standardize_columns", "remove_duplicates", "convert_types", "handle_nulls", "clean_text_columns", "add_metadata_columns")
UNKNOWN = "Unknown"
# An approximate distinct count this far above the limit is certainly above it.
_CLEARLY_ABOVE = 3


@dataclass
class CleanResult:
    """A cleaned DataFrame and the counts each step reported."""

    df: DataFrame
    counts: dict[str, int] = field(default_factory=dict)


@dataclass
class Readings:
    """What one pass over a dataset tells all data-dependent steps."""

    rows: int
    filled: dict[str, int]
    numbers: dict[str, int]
    dates: dict[str, int]
    distinct_sketch: dict[str, int]

    def missing(self, name: str, converted: str | None = None) -> int:
        """Missing cells of a column, after conversion if it was converted."""
        present = {"number": self.numbers, "date": self.dates}.get(converted or "", self.filled)
        return self.rows - present[name]


def read(df: DataFrame) -> Readings:
    """Counts of filled, numeric and date-like cells and a distinct-value sketch, in one aggregate.

    The sketch sees text as the later steps leave it: filled and stripped.
    """
    texts = stats.columns_of(df, num.is_text)
    aggs = ["count(1) AS n"] + [f"count({stats.ident(c)}) AS f{i}" for i, c in enumerate(df.columns)]
    for i, c in enumerate(texts):
        name = stats.ident(c)
        aggs.append(f"count({num.safe_numeric_sql(name)}) AS num{i}")
        aggs.append(f"approx_count_distinct({_stripped_sql(f'coalesce({name}, {num.sql_literal(UNKNOWN)})')}) AS d{i}")
        if _hinted(c):
            aggs.append(f"count({num.safe_timestamp_sql(name)}) AS ts{i}")
    seen = df.selectExpr(*aggs).first()
    return Readings(seen["n"], {c: seen[f"f{i}"] for i, c in enumerate(df.columns)}, {c: seen[f"num{i}"] for i, c in enumerate(texts)},
                    {c: seen[f"ts{i}"] for i, c in enumerate(texts) if _hinted(c)}, {c: seen[f"d{i}"] for i, c in enumerate(texts)})


def _stripped_sql(c: str) -> str:
    return f"regexp_replace({c}, {num.sql_literal(txt.EDGE_SPACES)}, '')"


def standardize_columns(df: DataFrame) -> DataFrame:
    """Snake-case, unique column names."""
    return df.toDF(*txt.snake_names(df.columns))


def remove_duplicates(df: DataFrame) -> DataFrame:
    """One row of each group of equal rows; nulls are equal, and so are maps with the same entries in any order."""
    maps = {f.name: stats.canonical(quoted(f.name), f.dataType) for f in df.schema if isinstance(f.dataType, T.MapType)}
    if not maps:
        return df.dropDuplicates()
    marked = df.withColumns({f"__map{i}": c for i, c in enumerate(maps.values())})
    return marked.dropDuplicates([c for c in marked.columns if c not in maps]).drop(*[f"__map{i}" for i in range(len(maps))])


def _hinted(name: str) -> bool:
    return any(h in name.lower() for h in rules.DATE_HINTS)


def _conversions(df: DataFrame, seen: Readings) -> dict[str, str]:
    """Columns to convert, and to what."""
    chosen = {}
    for c in stats.columns_of(df, num.is_text):
        filled = seen.filled[c]
        if filled and seen.numbers[c] / filled > rules.CONVERT_RATIO:
            chosen[c] = "number"
        elif filled and c in seen.dates and seen.dates[c] / filled > rules.CONVERT_RATIO:
            chosen[c] = "date"
    return chosen


def convert_types(df: DataFrame, seen: Readings | None = None) -> CleanResult:
    """String columns that mostly parse as numbers, else (if the name says so) as dates, are converted."""
    seen = read(df) if seen is None else seen
    chosen = _conversions(df, seen)
    parse = {"number": num.safe_numeric, "date": num.safe_timestamp}
    changes = {c: parse[kind](quoted(c)) for c, kind in chosen.items()}
    lost = sum(seen.missing(c, kind) - seen.missing(c) for c, kind in chosen.items())
    kinds = list(chosen.values())
    return CleanResult(df.withColumns(changes) if changes else df,
                       {"numeric_converted": kinds.count("number"), "datetime_converted": kinds.count("date"), "cells_coerced": lost})


def handle_nulls(df: DataFrame, approx: bool = False, missing: dict[str, int] | None = None, rows: int | None = None) -> CleanResult:
    """Missing numbers take the column median, missing text takes ``Unknown``; times and flags stay.

    ``missing`` and ``rows`` may come from an earlier pass over the same rows.
    """
    df = stats.normalize_nan(df)
    types = {f.name: f.dataType for f in df.schema}
    fillable = [c for c in df.columns if num.is_number(types[c]) or num.is_text(types[c])]
    if missing is None and fillable:
        seen = df.selectExpr("count(1) AS n", *[f"count_if({stats.ident(c)} IS NULL) AS m{i}" for i, c in enumerate(fillable)]).first()
        missing, rows = {c: seen[f"m{i}"] for i, c in enumerate(fillable)}, seen["n"]
    gaps = [c for c in fillable if missing[c]]
    medians = stats.quantiles(df, [c for c in gaps if num.is_number(types[c])], [0.5], approx)
    changes = {}
    for c in gaps:
        if num.is_text(types[c]):
            changes[c] = F.coalesce(quoted(c), F.lit(UNKNOWN))
        elif medians[c][0] is not None:
            median = medians[c][0]
            whole = num.is_integral(types[c]) and float(median).is_integer()
            kind = types[c] if whole else "double"
            changes[c] = F.coalesce(quoted(c).cast(kind), F.lit(median).cast(kind))
    return CleanResult(df.withColumns(changes) if changes else df, {"columns_filled": len(gaps)})


def clean_text_columns(df: DataFrame, sketch: dict[str, int] | None = None) -> CleanResult:
    """Strip every string column; lower-case those with few distinct values.

    A sketch rules out the columns that are clearly too varied; only the rest are
    counted exactly, so the exact count never shuffles a high-cardinality column.
    """
    names = stats.columns_of(df, num.is_text)
    if not names:
        return CleanResult(df, {"text_columns": 0, "lowercased": 0})
    stripped = df.selectExpr(*[f"{_stripped_sql(stats.ident(c))} AS {stats.ident(c)}" for c in names])
    if sketch is None:
        seen = stripped.selectExpr(*[f"approx_count_distinct({stats.ident(c)}) AS d{i}" for i, c in enumerate(names)]).first()
        sketch = {c: seen[f"d{i}"] for i, c in enumerate(names)}
    near = [c for c in names if sketch[c] <= _CLEARLY_ABOVE * rules.LOWERCASE_BELOW_DISTINCT]
    exact = {r["column"]: r["unique_count"] for r in stats.distinct_counts(stripped, near).collect()} if near else {}
    few = {c for c in near if exact.get(c, 0) < rules.LOWERCASE_BELOW_DISTINCT}
    changes = {c: F.lower(txt.strip(quoted(c))) if c in few else txt.strip(quoted(c)) for c in names}
    return CleanResult(df.withColumns(changes), {"text_columns": len(names), "lowercased": len(few)})


def add_metadata(df: DataFrame, source: str, loaded_at: datetime | None = None) -> DataFrame:
    """Load time and source name as columns."""
    moment = F.current_timestamp() if loaded_at is None else F.lit(loaded_at)
    return df.withColumns({"_loaded_at": moment, "_source": F.lit(source)})


def transform(df: DataFrame, source: str, loaded_at: datetime | None = None, approx: bool = False) -> CleanResult:
    """All steps in order.

    The duplicate-free rows are staged once, counted on both sides of the shuffle by the
    write itself.  One pass over that table then answers every data-dependent question
    but the medians and the exact distinct counts of low-cardinality text.
    """
    old = df.columns
    renamed = stats.normalize_nan(standardize_columns(df))
    before, after = Observation(), Observation()
    n_rows = F.count(F.lit(1)).alias("n")
    rows = stage(remove_duplicates(renamed.observe(before, n_rows)).observe(after, n_rows), "deduplicated")
    counts = {"renamed": sum(a != b for a, b in zip(old, renamed.columns)), "columns": len(old),
              "rows_before": rows_seen(before), "rows_after": rows_seen(after)}
    seen = read(rows)
    kinds = _conversions(rows, seen)
    typed = convert_types(rows, seen)
    filled = handle_nulls(typed.df, approx, {c: seen.missing(c, kinds.get(c)) for c in rows.columns}, seen.rows)
    cleaned = clean_text_columns(filled.df, seen.distinct_sketch)
    for step in (typed, filled, cleaned):
        counts.update(step.counts)
    return CleanResult(add_metadata(cleaned.df, source, loaded_at), counts)


def transform_log(spark, counts: dict[str, int], source: str, at: datetime | None = None) -> DataFrame:
    """The audit trail of one ``transform``: step, action, detail, timestamp."""
    c = counts
    details = (
        f"Renamed {c['renamed']}/{c['columns']} columns to snake_case",
        f"Removed {c['rows_before'] - c['rows_after']} duplicate rows (before={c['rows_before']}, after={c['rows_after']})",
        f"Converted {c['numeric_converted']} columns to numeric, {c['datetime_converted']} to datetime; "
        f"{c['cells_coerced']} unreadable cells became null",
        f"Applied null-fill strategy to {c['columns_filled']} columns",
        f"Stripped whitespace on {c['text_columns']} text columns, lowercased {c['lowercased']} of them",
        f"Added _loaded_at and _source='{source}'",
    )
    moment = F.current_timestamp() if at is None else F.lit(at)
    return (spark.createDataFrame([(i + 1, a, d) for i, (a, d) in enumerate(zip(STEPS, details))],
                                  "step int, action string, detail string")
            .withColumn("timestamp", moment))

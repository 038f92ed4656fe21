"""Shared statistics: one-pass aggregates, value counts, exact quantiles, size-checked broadcast."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright.functions import numeric as num
from martwright.session import stage

# A side is broadcast only when the optimizer's size estimate stays below this.
BROADCAST_BYTES = 64 * 1024 * 1024
# Buckets a bracket is cut into when searching quantiles, and the size and rank error of the sketch that gives brackets.
BUCKETS = 4096
_SKETCH_K, _SKETCH_ERROR = 4096, 0.002
_APPROX_ACCURACY = 10_000
# Texts up to this many characters are counted as they are.
TEXT_HEAD = 64
# Aggregate expressions per job, to stay inside generated-code limits.
EXPRESSIONS_PER_JOB = 500


def small_side(df: DataFrame) -> DataFrame:
    """Mark ``df`` for broadcast if its estimated size is small; else leave the join to Catalyst."""
    return F.broadcast(df) if plan_size_bytes(df) <= BROADCAST_BYTES else df


def dimension(df: DataFrame) -> DataFrame:
    """Materialise a derived lookup table, so that its real size decides whether it is broadcast."""
    return small_side(stage(df, "dimension"))


def plan_size_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def normalize_nan(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes null; other columns pass untouched."""
    floats = {f.name: F.expr(f"CASE WHEN NOT isnan({ident(f.name)}) THEN {ident(f.name)} END") for f in df.schema
              if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.withColumns(floats) if floats else df


def quoted(name: str) -> Column:
    return F.col(ident(name))


def columns_of(df: DataFrame, test) -> list[str]:
    return [f.name for f in df.schema if test(f.dataType)]


def chunks(items: list, size: int) -> Iterable[list]:
    for start in range(0, len(items), size):
        yield items[start:start + size]


def ident(name: str) -> str:
    """A column name as expression text."""
    return "`" + name.replace("`", "``") + "`"


def long_stats(df: DataFrame, rows: list[dict[str, Column | str]]) -> DataFrame:
    """Evaluate aggregates in one pass and return them as rows.

    Each dict is one output row of constants and aggregates, given as columns or, for
    tables with many columns, as expression text (one parse instead of a call per node).
    """
    parts = []
    for group in chunks(rows, max(1, EXPRESSIONS_PER_JOB // max(1, len(rows[0])))):
        if all(isinstance(c, str) for row in group for c in row.values()):
            packed = F.expr("array(" + ", ".join(_named_struct(row) for row in group) + ")")
        else:
            packed = F.array(*[F.struct(*[c.alias(name) for name, c in row.items()]) for row in group])
        parts.append(df.agg(packed.alias("rows")).select(F.inline("rows")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _named_struct(row: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"{num.sql_literal(name)}, {text}" for name, text in row.items()) + ")"


def pearson_sql(a: str, b: str) -> str:
    """Pearson r over rows where both are present, as expression text; null when either is constant.

    The built-in ``corr`` divides by zero on a constant column under ANSI rules.
    """
    a, b = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    r = f"try_divide(regr_sxy({a}, {b}), sqrt(regr_sxx({a}, {b}) * regr_syy({a}, {b})))"
    return f"CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN {r} END"


def value_counts(df: DataFrame, columns: list[str], heads: bool = True) -> DataFrame:
    """Occurrences of every distinct non-null value: ordinal, column, whole, real, txt, d0, d1, n.

    Values stay in the slot of their type, so numbers are neither formatted nor
    compared as text.  A text over ``TEXT_HEAD`` characters is counted as its head and 128 bits of
    digest, so no long text is the key of a shuffle or sort; ``whole_texts`` brings back the few that are shown.  Without
    ``heads`` every text is its digest alone.  Counting is combined before the shuffle, so a value that fills
    a third of the rows costs one row per task.
    """
    types = {f.name: f.dataType for f in df.schema}
    cells = []
    for ordinal, name in enumerate(columns):
        c, t = ident(name), types[name]
        whole = f"CAST({c} AS BIGINT)" if num.is_integral(t) else "CAST(NULL AS BIGINT)"
        real = f"CAST({c} AS DOUBLE) + 0.0D" if num.is_fractional(t) else "CAST(NULL AS DOUBLE)"
        # A decimal is told apart by its exact text and ordered by its double.
        as_text = not num.is_number(t) or isinstance(t, T.DecimalType)
        key = text_key(text_sql(c, t) if as_text else "CAST(NULL AS STRING)", heads)
        cells.append(_named_struct({"ordinal": str(ordinal), "column": num.sql_literal(name), "whole": whole, "real": real, **key}))
    keys = ["ordinal", "column", "whole", "real", *(["txt"] if heads else []), "d0", "d1"]
    return (df.selectExpr(f"inline(array({', '.join(cells)}))")
            .filter("whole IS NOT NULL OR real IS NOT NULL OR d0 IS NOT NULL")
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))


def text_key(text: str, heads: bool = True) -> dict[str, str]:
    """A text as a key of bounded size, as expression texts: its head and a digest, which is zero for a text that is all head."""
    digests = {f"d{seed}": f"xxhash64({seed}, {text})" for seed in (0, 1)}
    if not heads:
        return {d: f"CASE WHEN {text} IS NOT NULL THEN {h} END" for d, h in digests.items()}
    return {"txt": f"left({text}, {TEXT_HEAD})"} | {
        d: f"CASE WHEN length({text}) > {TEXT_HEAD} THEN {h} WHEN {text} IS NOT NULL THEN 0L END" for d, h in digests.items()}


def text_order() -> list[Column]:
    """Total order of ``value_counts`` texts: by head, a text that is all head first, then by digest."""
    return [F.col("txt"), F.expr("d0 <> 0 OR d1 <> 0"), F.col("d0"), F.col("d1")]


def whole_texts(df: DataFrame, columns: list[str], picked: DataFrame) -> DataFrame:
    """Rows of ``value_counts`` of ``columns`` with ``value``, their whole text form.

    ``picked`` is a bounded number of rows per column: their digests are broadcast to a second scan of the columns that can hold
    long texts, which adaptive execution leaves out when no picked text is long.
    """
    types = {f.name: f.dataType for f in df.schema}
    long = [(i, text_sql(ident(c), types[c])) for i, c in enumerate(columns)
            if num.is_text(types[c]) or isinstance(types[c], (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    if not long:
        return picked.withColumn("value", value_text())
    at = ["ordinal", "d0", "d1"]
    cells = [f"CASE WHEN length({text}) > {TEXT_HEAD} THEN {_named_struct({'ordinal': str(i), **text_key(text), 'text': text})} END" for i, text in long]
    wanted = picked.filter("d0 <> 0 OR d1 <> 0").select(*at)
    found = (df.selectExpr(f"inline(array_compact(array({', '.join(cells)})))").join(F.broadcast(wanted), at, "left_semi")
             .groupBy(*at).agg(F.collect_set("text")[0].alias("text")))
    return picked.join(found, at, "left").withColumn("value", F.coalesce("text", value_text())).drop("text")


def text_sql(c: str, t: T.DataType) -> str:
    """Text form of a value of any type, as expression text."""
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        return f"to_json({c})"
    return f"hex({c})" if isinstance(t, T.BinaryType) else f"CAST({c} AS STRING)"


def value_text() -> Column:
    """Text form of a row of ``value_counts``; of a long text, its head."""
    return F.coalesce(F.col("txt"), F.col("whole").cast("string"), F.col("real").cast("string"))


def distinct_counts(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    """Distinct non-null values per column: ordinal, column, unique_count."""
    if approx:
        return long_stats(df, [{"ordinal": str(i), "column": num.sql_literal(c),
                                "unique_count": f"approx_count_distinct({ident(c)})"} for i, c in enumerate(columns)])
    return value_counts(df, columns, heads=False).groupBy("ordinal", "column").agg(F.count(F.lit(1)).alias("unique_count"))


def row_digest(df: DataFrame) -> list[Column]:
    """128 bits that stand for a whole row, so that a count of equal rows shuffles no wide rows.

    Which cells are null is part of it; signed zeros are equal; a map is its sorted entries.
    """
    cells = []
    for f in df.schema:
        c = quoted(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = c + F.lit(0.0).cast(f.dataType)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = canonical(c, f.dataType)
        cells += [c.isNull(), c]
    return [F.xxhash64(F.lit(seed), *cells).alias(f"__d{seed}") for seed in (0, 1)]


def canonical(c: Column, t: T.DataType) -> Column:
    """A nested value as text that is equal for equal values, whatever the order of map entries."""
    return F.to_json(F.array_sort(F.map_entries(c))) if isinstance(t, T.MapType) else F.to_json(c)


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: total rows and rows beyond the first of each group of equal rows."""
    groups = df.groupBy(*row_digest(df)).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"),
                      F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"))


# --- exact quantiles -------------------------------------------------------------------------------


def quantiles(df: DataFrame, columns: list[str], probs: list[float], approx: bool = False, buckets: int = BUCKETS) -> dict[str, list[float | None]]:
    """Interpolated quantiles of several numeric columns; only scalars reach the driver.

    Three passes at any size.  A sketch brackets every wanted rank.  One aggregate counts the values below
    each bracket and in it, which proves that the rank is inside (a bracket that missed it becomes the whole
    column).  The bracketed values, a few thousandths of the rows, are counted by value, and running
    counts over buckets, then over one bucket's values, end at the rank.
    Infinities are values at either end; null and NaN are none.
    """
    if not columns:
        return {}
    values = df.selectExpr(*[f"nanvl(CAST({ident(c)} AS DOUBLE), NULL) AS v{i}" for i, c in enumerate(columns)])
    if approx:
        at = ", ".join(f"{p}D" for p in probs)
        row = values.selectExpr(*[f"percentile_approx(v{i}, array({at}), {_APPROX_ACCURACY}) AS q{i}" for i in range(len(columns))]).first()
        return {c: list(row[f"q{i}"] or [None] * len(probs)) for i, c in enumerate(columns)}
    seen = _sketched(values, len(columns), probs)
    wanted, found = {}, {}
    for i, row in enumerate(seen):
        for rank in sorted({r for p in probs for r in (math.floor((row["n"] - 1) * p), math.ceil((row["n"] - 1) * p))}) if row["n"] else ():
            inner = rank - row["low"]
            if inner < 0 or inner >= row["finite"]:
                found[i, rank] = -math.inf if inner < 0 else math.inf
            else:
                wanted[i, rank] = (inner, _bracket(row, inner))
    found |= _order_statistics(values, wanted, [(row["lo"], row["hi"]) for row in seen], buckets)
    result: dict[str, list[float | None]] = {}
    for i, (c, row) in enumerate(zip(columns, seen)):
        at = [(row["n"] - 1) * p for p in probs]
        result[c] = [_between(found[i, math.floor(x)], found[i, math.ceil(x)], x - math.floor(x)) for x in at] if row["n"] else [None] * len(probs)
    return result


def _between(low: float, high: float, part: float) -> float:
    """Linear interpolation; between a number and an infinity lies that infinity."""
    if low == high or not part:
        return low
    return low if low == -math.inf else low + (high - low) * part


def _sketched(values: DataFrame, n: int, probs: list[float]) -> list[dict]:
    """Per column: rows, rows of minus infinity, finite rows, their ends, and sketched values around each probability."""
    grid = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-_SKETCH_ERROR, _SKETCH_ERROR)})
    ranks = ", ".join(f"{g!r}D" for g in grid)
    aggs, reads = [], []
    for i in range(n):
        finite = f"CASE WHEN abs(v{i}) < double('Infinity') THEN v{i} END"
        aggs += [f"count(v{i}) AS n{i}", f"count_if(v{i} = double('-Infinity')) AS low{i}", f"count({finite}) AS finite{i}", f"min({finite}) AS lo{i}", f"max({finite}) AS hi{i}",
                 f"kll_sketch_agg_double({finite}, {_SKETCH_K}) AS s{i}"]
        reads += [*(f"{c}{i}" for c in ("n", "low", "finite", "lo", "hi")), f"CASE WHEN finite{i} > 0 THEN kll_sketch_get_quantile_double(s{i}, array({ranks})) END AS at{i}"]
    row = values.selectExpr(*aggs).selectExpr(*reads).first()
    return [{c: row[f"{c}{i}"] for c in ("n", "low", "finite", "lo", "hi")} | {"at": list(zip(grid, row[f"at{i}"] or ()))} for i in range(n)]


def _bracket(row: dict, rank: int) -> tuple[float, float]:
    """The sketched values that most likely enclose a rank among the finite ones."""
    share = rank / max(row["finite"] - 1, 1)
    below = [v for g, v in row["at"] if g <= share - _SKETCH_ERROR / 2]
    above = [v for g, v in row["at"] if g >= share + _SKETCH_ERROR / 2]
    return (below[-1] if below else row["lo"]), (above[0] if above else row["hi"])


def _order_statistics(values: DataFrame, wanted: dict, ends: list[tuple[float, float]], buckets: int) -> dict:
    """The value at each (column, rank); ``wanted`` maps it to its rank among finite values and a bracket."""
    if not wanted:
        return {}
    brackets = list(dict.fromkeys((t[0], *b) for t, (_, b) in wanted.items()))
    row = values.selectExpr(*[f"count_if(v{i} > double('-Infinity') AND v{i} < {lo!r}D) AS b{j}" for j, (i, lo, _) in enumerate(brackets)],
                            *[f"count_if(v{i} BETWEEN {lo!r}D AND {hi!r}D) AS m{j}" for j, (i, lo, hi) in enumerate(brackets)]).first()
    place = {}
    for t, (rank, b) in wanted.items():
        j = brackets.index((t[0], *b))
        if row[f"b{j}"] <= rank < row[f"b{j}"] + row[f"m{j}"]:
            place[t] = ((t[0], *b), rank - row[f"b{j}"])
        else:
            place[t] = ((t[0], *ends[t[0]]), rank)
    done = {t: b[1] for t, (b, _) in place.items() if b[1] == b[2]}
    place = {t: p for t, p in place.items() if t not in done}
    if not place:
        return done
    brackets = list(dict.fromkeys(b for b, _ in place.values()))
    inside = [f"v{i} BETWEEN {lo!r}D AND {hi!r}D" for i, lo, hi in brackets]
    cells = [f"CASE WHEN {test} THEN named_struct('b', {j}, 'v', v{i} + 0.0D) END" for j, ((i, lo, hi), test) in enumerate(zip(brackets, inside))]
    counted = values.filter(" OR ".join(inside)).selectExpr(f"inline(array_compact(array({', '.join(cells)})))").groupBy("b", "v").agg(F.count(F.lit(1)).alias("n"))
    bucket = " ".join(f"WHEN {j} THEN {_bucket('v', lo, hi, buckets)}" for j, (_, lo, hi) in enumerate(brackets))
    counted = stage(counted.withColumn("k", F.expr(f"CASE b {bucket} END")), "bracketed")
    # Up to as many rows as there are buckets per bracket; then the values of one bucket per rank.
    before = F.sum("n").over(Window.partitionBy("b").orderBy("k")) - F.col("n")
    totals = counted.groupBy("b", "k").agg(F.sum("n").alias("n")).withColumn("before", before)
    ranks = {t: (brackets.index(b), rank) for t, (b, rank) in place.items()}
    holds = totals.filter(" OR ".join(f"(b = {j} AND before <= {rank} AND {rank} < before + n)" for j, rank in ranks.values()))
    running = Window.partitionBy("b", "k").orderBy("v")
    chosen = counted.join(F.broadcast(holds.select("b", "k", "before")), ["b", "k"]).withColumn("start", F.col("before") + F.sum("n").over(running) - F.col("n"))
    rows = chosen.filter(" OR ".join(f"(b = {j} AND start <= {rank} AND {rank} < start + n)" for j, rank in ranks.values())).collect()
    return done | {t: next(r["v"] for r in rows if r["b"] == j and r["start"] <= rank < r["start"] + r["n"]) for t, (j, rank) in ranks.items()}


def _bucket(v: str, lo: float, hi: float, buckets: int) -> str:
    """Bucket number of a value, never falling as the value grows; halves keep the width of the widest range finite."""
    return f"CAST(floor(({v} * 0.5D - {lo * 0.5!r}D) / {hi * 0.5 - lo * 0.5!r}D * {buckets}) AS INT)"

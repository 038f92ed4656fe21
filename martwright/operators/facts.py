"""Facts derived from a built mart: rankings, correlations, quadrants, composite index, histogram, findings.

A mart has one row per spine key.  Medians and bounds are found first, by one aggregate and one
quantile search, and enter the plan as literals: a few numbers, whatever the size.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.functions import numeric as num
from martwright.operators import stats

N_BINS = 6


def ends(rows: DataFrame, columns: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """Smallest and largest value of each column, by one aggregate, and the number of rows under ``""``."""
    seen = rows.agg(F.count(F.lit(1)).alias("n"), *[f(F.col(c).cast("double")).alias(f"{tag}{i}") for i, c in enumerate(columns) for tag, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: (seen[f"lo{i}"], seen[f"hi{i}"]) for i, c in enumerate(columns)} | {"": (seen["n"], seen["n"])}


def medians(rows: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact median of each column; only these numbers reach the driver."""
    return {c: q[0] for c, q in stats.quantiles(rows, columns, [0.5]).items()}


def _above(column: str, value: float | None) -> Column:
    return F.lit(False) if value is None else F.col(column) > F.lit(value)


def complete(mart: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where none of the columns is missing."""
    return mart.dropna(subset=columns)


def ranked(mart: DataFrame, column: str, key: str, k: int, largest: bool = True) -> DataFrame:
    """Top or bottom k rows; ties keep spine order."""
    order = F.desc(column) if largest else F.asc(column)
    return mart.orderBy(order, F.asc(key)).limit(k)


def top_bottom(mart: DataFrame, measure: str, spend: str, key: str, k: int = 3) -> DataFrame:
    """Highest and lowest spend and highest measure: list, key, value."""
    rows = complete(mart, [measure, spend])
    lists = [("top_spend", spend, True), ("bottom_spend", spend, False), ("top_measure", measure, True)]
    parts = [ranked(rows, c, key, k, largest).select(F.lit(name).alias("list"), key, F.col(c).alias("value"))
             for name, c, largest in lists]
    return reduce(DataFrame.unionByName, parts)


def correlation(mart: DataFrame, a: str, b: str, digits: int = 3) -> DataFrame:
    """Pearson r over complete rows, when there are more than two: n, r."""
    r = F.expr(stats.pearson_sql(stats.ident(a), stats.ident(b)))
    return complete(mart, [a, b]).agg(F.count(F.lit(1)).alias("n"), r.alias("r")).select(
        "n", F.when(F.col("n") > 2, F.round("r", digits)).alias("r"))


def pairwise(mart: DataFrame, columns: list[str], spend: str, digits: int = 3) -> DataFrame:
    """r of every pair of measures once, over rows complete in all of them: a, b, r."""
    rows = complete(mart, [*columns, spend])
    pairs = [{"a": num.sql_literal(a), "b": num.sql_literal(b), "r": stats.pearson_sql(stats.ident(a), stats.ident(b))}
             for a, b in combinations(columns, 2)]
    return stats.long_stats(rows, pairs).withColumn("r", F.round("r", digits))


def quadrant(mart: DataFrame, measure: str, spend: str) -> DataFrame:
    """Keys above the median measure and below the median spend."""
    rows = complete(mart, [measure, spend])
    middle = medians(rows, [measure, spend])
    return rows.filter(_above(measure, middle[measure]) & (F.lit(False) if middle[spend] is None else F.col(spend) < F.lit(middle[spend])))


def composite(mart: DataFrame, columns: list[str], spend: str, digits: int | None = 1) -> DataFrame:
    """Complete rows with ``burden_index``: the mean of the measures, each scaled to 0..100 (50 if constant).

    Empty unless there are two measures and three complete rows.
    """
    rows = complete(mart, [*columns, spend])
    seen = ends(rows, columns)
    scaled = [(F.col(c) - F.lit(seen[c][0])) / F.lit(seen[c][1] - seen[c][0]) * 100.0 if seen[""][0] and seen[c][0] != seen[c][1] else F.lit(50.0) for c in columns]
    index = reduce(lambda a, b: a + b, scaled) / F.lit(float(len(columns)))
    return rows.filter(F.lit(len(columns) >= 2 and seen[""][0] >= 3)).withColumn("burden_index", index if digits is None else F.round(index, digits))


def hotspots(mart: DataFrame, columns: list[str], spend: str) -> DataFrame:
    """Keys above the median of every measure at once."""
    rows = complete(mart, [*columns, spend])
    middle = medians(rows, columns)
    above = [_above(c, middle[c]) for c in columns]
    return rows.filter(reduce(lambda a, b: a & b, above))


def scatter(mart: DataFrame, x: str, spend: str, key: str) -> DataFrame:
    """Points of measure against spend: key, x, y, hi, x_median, y_median.

    ``hi`` compares the unrounded x with the unrounded median.
    """
    rows = complete(mart, [x, spend])
    middle = medians(rows, [x, spend])
    x_median, y_median = (F.lit(middle[c]).cast("double") for c in (x, spend))
    return rows.filter(F.lit(ends(rows, [])[""][0] >= 2)).select(
        key, F.round(x, 2).alias("x"), F.round(spend, 2).alias("y"), _above(x, middle[x]).alias("hi"),
        F.round(x_median, 2).alias("x_median"), F.round(y_median, 2).alias("y_median"))


def histogram(points: DataFrame, key: str | None = None, bins: int = N_BINS) -> DataFrame:
    """Equal-width bins of ``x``: bin, lo, hi, members_count and, with a key, the members' keys.

    A point's bin is found by the same bound tests that define the bins (the last bin
    is closed), so float edges fall exactly where the bounds say.  Empty bins are kept.
    """
    spark = points.sparkSession
    seen = ends(points.filter(F.col("x").isNotNull()), ["x"])
    n, (least, most) = seen[""][0], seen["x"]
    low, high = F.lit(least).cast("double"), F.lit(most).cast("double")
    width = F.lit((most - least or 1.0) / bins if n else 1.0)

    def lower(i: int) -> Column:
        return low + F.lit(float(i)) * width

    place = F.coalesce(*[F.when((F.col("x") >= lower(i)) & (F.col("x") < lower(i + 1)), F.lit(i)) for i in range(bins - 1)],
                       F.when((F.col("x") >= lower(bins - 1)) & (F.col("x") <= high), F.lit(bins - 1)))
    aggs = [F.count(F.lit(1)).alias("n")]
    if key:
        aggs.append(F.array_join(F.sort_array(F.collect_list(F.col(key).cast("string"))), ",").alias("members"))
    counted = points.filter(F.col("x").isNotNull()).groupBy(place.alias("bin")).agg(*aggs)
    frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    upper = F.when(F.col("bin") == bins - 1, high).otherwise(low + (F.col("bin") + 1).cast("double") * width)
    out = [F.col("bin"), F.round(low + F.col("bin").cast("double") * width, 1).alias("lo"), F.round(upper, 1).alias("hi"),
           F.coalesce("n", F.lit(0)).alias("members_count")]
    if key:
        out.append(F.coalesce("members", F.lit("")).alias("members"))
    return frame.filter(F.lit(n >= 4)).join(counted, "bin", "left").select(*out)


def anomalies(points: DataFrame, key: str, k: int = 3) -> DataFrame:
    """Points above both rounded medians, the largest ``x + y`` first."""
    high = points.filter((F.col("x") > F.col("x_median")) & (F.col("y") > F.col("y_median")))
    return (high.withColumn("total", F.round(F.col("x") + F.col("y"), 2))
            .orderBy(F.desc("total"), F.asc(key)).limit(k).select(key, "x", "y", "total"))


def direction(r: Column) -> Column:
    """Wording of a correlation."""
    return F.when(r >= 0.3, "rises with").when(r <= -0.3, "falls as").otherwise("barely tracks")


def findings(mart: DataFrame, columns: list[str], spend: str, key: str) -> DataFrame:
    """Rule-based findings of the composite view, in order: ordinal, kind, subject, value."""
    index = composite(mart, columns, spend)
    leader = ranked(index, "burden_index", key, 1).select(
        F.lit(1).alias("ordinal"), F.lit("leader").alias("kind"), F.col(key).cast("string").alias("subject"),
        F.col("burden_index").alias("value"))
    trend = correlation(index, "burden_index", spend).filter("r is not null").select(
        F.lit(2).alias("ordinal"), F.lit("trend").alias("kind"), direction(F.col("r")).alias("subject"), F.col("r").alias("value"))
    hot = hotspots(mart, columns, spend).agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(
        F.lit(3).alias("ordinal"), F.lit("hotspots").alias("kind"), F.lit("").alias("subject"), F.col("n").cast("double").alias("value"))
    order = {pair: i for i, pair in enumerate(combinations(columns, 2))}
    position = F.coalesce(*[F.when((F.col("a") == a) & (F.col("b") == b), F.lit(i)) for (a, b), i in order.items()])
    pair = (pairwise(mart, columns, spend).filter(F.abs("r") >= 0.6).orderBy(position).limit(1)
            .select(F.lit(4).alias("ordinal"), F.lit("pair").alias("kind"), F.concat_ws(" and ", "a", "b").alias("subject"), F.col("r").alias("value")))
    return reduce(DataFrame.unionByName, [leader, trend, hot, pair])


def measure_findings(mart: DataFrame, measure: str, spend: str, key: str) -> DataFrame:
    """Rule-based findings of the single-measure view, in order: ordinal, kind, subject, value."""
    rows = complete(mart, [measure, spend])

    def first(ordinal: int, kind: str, column: str, digits: int | None) -> DataFrame:
        value = F.col(column) if digits is None else F.round(column, digits)
        return ranked(rows, column, key, 1).select(F.lit(ordinal).alias("ordinal"), F.lit(kind).alias("kind"),
                                                   F.col(key).cast("string").alias("subject"), value.alias("value"))

    trend = correlation(mart, measure, spend).filter("r is not null").select(
        F.lit(3).alias("ordinal"), F.lit("trend").alias("kind"), direction(F.col("r")).alias("subject"), F.col("r").alias("value"))
    watch = quadrant(mart, measure, spend).agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(
        F.lit(4).alias("ordinal"), F.lit("watch_quadrant").alias("kind"), F.lit("").alias("subject"), F.col("n").cast("double").alias("value"))
    return reduce(DataFrame.unionByName, [first(1, "leader", measure, None), first(2, "top_spend", spend, 0), trend, watch])

"""The reporting mart: one row per spine key, and the checks and metadata that go with it."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright import rules
from martwright.functions import numeric as num
from martwright.functions import text as txt
from martwright.operators import joins, stats


@dataclass(frozen=True)
class MartSpec:
    """What to build: measures, the years they may come from, labels."""

    measures: tuple[str, ...] = tuple(m[0] for m in rules.DEFAULT_MEASURES)
    years: tuple[int, ...] = rules.MEASURE_YEARS
    primary_measure: str = ""
    focus: str = "payer"
    title: str = "Custom State Health Mart"
    payment_year: int = 2024
    sample_fraction: float | None = None

    @property
    def primary(self) -> str:
        return self.primary_measure or self.measures[0]


@dataclass
class MartInputs:
    """Source tables and the columns that play each part."""

    spine: DataFrame
    key: str
    population: DataFrame
    observations: DataFrame
    payments: DataFrame
    question: str = "question_id"
    year: str = "yr"
    value: str = "value"
    suppressed: Column | None = None
    payee: str = "npi"
    amount: str = "payment"
    excluded: tuple = field(default_factory=tuple)


def prevalence_column(measure: str) -> str:
    return f"{txt.measure_slug(measure)}_prevalence_pct"


def vintage_column(measure: str) -> str:
    return f"{txt.measure_slug(measure)}_vintage"


def usable(observations: DataFrame, key: str, value: str, excluded=(), suppressed: Column | None = None) -> DataFrame:
    """Rows with a real value for a real key."""
    kept = observations.filter(F.col(value).isNotNull() & F.col(key).isNotNull())
    if suppressed is not None:
        kept = kept.filter(~F.coalesce(suppressed, F.lit(False)))
    return joins.drop_codes(kept, key, excluded) if excluded else kept


def latest_value(observations: DataFrame, keys: list[str], year: str, value: str, years) -> DataFrame:
    """Newest value per key within the given years, with its year; ties take the smallest value.

    One conditional minimum per year keeps this a hash aggregate with combining
    before the shuffle: no sort, no per-key list, no row number.
    """
    newest = sorted(years, reverse=True)
    per_year = observations.filter(F.col(year).isin(*newest)).groupBy(*keys).agg(
        *[F.min(F.when(F.col(year) == y, F.col(value))).alias(f"__{y}") for y in newest])
    found = [F.col(f"__{y}") for y in newest]
    vintage = F.coalesce(*[F.when(c.isNotNull(), F.lit(y)) for c, y in zip(found, newest)])
    return (per_year.select(*keys, F.coalesce(*found).alias("value"), vintage.alias("vintage"))
            .filter(F.col("value").isNotNull()))


def measures_wide(observations: DataFrame, key: str, question: str, year: str, value: str, measures, years) -> DataFrame:
    """All requested measures side by side per key, from one aggregate: value and vintage of each."""
    newest = sorted(years, reverse=True)
    rows = observations.filter(F.col(question).isin(*measures) & F.col(year).isin(*newest))
    cells = [F.min(F.when((F.col(question) == m) & (F.col(year) == y), F.col(value))).alias(f"__{i}_{y}")
             for i, m in enumerate(measures) for y in newest]
    wide = rows.groupBy(key).agg(*cells)
    out = [F.col(key)]
    for i, m in enumerate(measures):
        found = [F.col(f"__{i}_{y}") for y in newest]
        out.append(F.coalesce(*found).alias(prevalence_column(m)))
        out.append(F.coalesce(*[F.when(c.isNotNull(), F.lit(y)) for c, y in zip(found, newest)]).alias(vintage_column(m)))
    return wide.select(*out)


def build(inputs: MartInputs, spec: MartSpec) -> DataFrame:
    """Spine, population, measures, payments and derived ratios: one row per spine key, one lazy plan.

    Every source is reduced to one row per key before it is joined, so no join is
    larger than the spine.
    """
    key = inputs.key
    observations = usable(inputs.observations, key, inputs.value, inputs.excluded, inputs.suppressed)
    measures = measures_wide(observations, key, inputs.question, inputs.year, inputs.value, spec.measures, spec.years)
    payments = inputs.payments if spec.sample_fraction is None else inputs.payments.sample(spec.sample_fraction, seed=7)
    paid = joins.group_sum_distinct(joins.drop_codes(payments, key, inputs.excluded) if inputs.excluded else payments,
                                    key, inputs.amount, inputs.payee, "total_payment", "provider_count")
    # Measures and payments are grouped by the key; only the population could hold a key twice.
    mart = joins.spine_join(inputs.spine, inputs.population, key)
    mart = reduce(lambda left, right: joins.spine_join(left, right, key, checked=False), [measures, paid], mart)
    return with_ratios(mart.withColumn("payment_year", F.lit(spec.payment_year)))


def with_ratios(mart: DataFrame) -> DataFrame:
    """Spend per head and providers per 100 000."""
    return mart.withColumns({
        "spend_per_capita": num.ratio(F.col("total_payment"), F.col("population"), 1, 2),
        "providers_per_100k": num.ratio(F.col("provider_count"), F.col("population"), 100_000, 1)})


def coverage(mart: DataFrame, measures, below: int = rules.LOW_COVERAGE_BELOW) -> DataFrame:
    """Measures that cover fewer keys than required: question_id, keys_covered."""
    rows = [{"question_id": F.lit(m), "keys_covered": F.count(prevalence_column(m))} for m in measures]
    return stats.long_stats(mart, rows).filter(F.col("keys_covered") < below)


def grain(mart: DataFrame, key: str, excluded=()) -> DataFrame:
    """One row of facts the mart's grain must satisfy: rows, distinct keys, excluded keys present."""
    present = F.count_if(F.col(key).isin(*excluded)) if excluded else F.lit(0).cast("long")
    return mart.agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct(key).alias("key_count"), present.alias("excluded_keys"))


def assert_grain(mart: DataFrame, key: str, expected: int, excluded=()) -> None:
    """Raise unless the mart has exactly one row per expected key."""
    seen = grain(mart, key, excluded).first()
    if (seen["row_count"], seen["key_count"], seen["excluded_keys"]) != (expected, expected, 0):
        raise ValueError(f"mart grain broken: {seen.asDict()}, expected {expected} keys")

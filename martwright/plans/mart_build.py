"""Build a mart, check it, derive its facts and persist it."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.operators import facts, joins, mart as marts, quality
from martwright.session import stage
from martwright.sources import tables

SPEND = "spend_per_capita"


@dataclass
class BuiltMart:
    """A mart written once, and what was derived from it."""

    table: DataFrame
    key: str
    spec: marts.MartSpec
    columns: list[str]
    metadata: dict[str, object]
    #: Rows per source, counted when the mart is saved.
    sources: DataFrame | None = None

    @property
    def primary(self) -> str:
        return marts.prevalence_column(self.spec.primary)

    def checks(self) -> DataFrame:
        """General and mart-specific checks together."""
        bands = [marts.prevalence_column(m) for m in self.spec.measures]
        own = quality.mart_checks(self.table, self.metadata["spine_rows"], "population", bands, SPEND, [*bands, SPEND, "population"])
        return quality.scorecard(self.table).unionByName(own)

    def facts(self) -> dict[str, DataFrame]:
        """Every fact table of the report."""
        out = {"top_bottom": facts.top_bottom(self.table, self.primary, SPEND, self.key),
               "correlation": facts.correlation(self.table, self.primary, SPEND),
               "quadrant": facts.quadrant(self.table, self.primary, SPEND)}
        if len(self.columns) >= 2:
            index = facts.composite(self.table, self.columns, SPEND)
            out |= {"composite": index, "composite_top": facts.ranked(index, "burden_index", self.key, 3),
                    "hotspots": facts.hotspots(self.table, self.columns, SPEND),
                    "pairwise": facts.pairwise(self.table, self.columns, SPEND),
                    "findings": facts.findings(self.table, self.columns, SPEND, self.key)}
        points = facts.scatter(self.table, self.primary, SPEND, self.key)
        return out | {"scatter": points, "histogram": facts.histogram(points, self.key), "anomalies": facts.anomalies(points, self.key)}

    def save(self, folder: str, name: str) -> None:
        behind = self.sources.orderBy("table_name").collect() if self.sources is not None else []
        tables.load_table(self.table, name, folder)
        tables.write_artifact(self.table, folder, name, self.metadata | {"source_rows": ",".join(f"{r['table_name']}:{r['n_rows']}" for r in behind)})


def build(inputs: marts.MartInputs, spec: marts.MartSpec, external: list[DataFrame] | None = None,
          low_coverage_below: int = 40) -> BuiltMart:
    """One job builds and stages the mart; its facts then read the small staged table."""
    plan = marts.build(inputs, spec)
    plan = reduce(lambda left, right: joins.spine_join(left, right, inputs.key), external or [], plan)
    table = stage(plan, "mart")
    spine_rows = inputs.spine.count()
    marts.assert_grain(table, inputs.key, spine_rows, inputs.excluded)
    low = marts.coverage(table, spec.measures, low_coverage_below).collect()
    metadata = {"built_at": datetime.now(timezone.utc).isoformat(), "measures": ",".join(spec.measures),
                "sample_mode": spec.sample_fraction is not None, "spine_rows": spine_rows,
                "low_coverage_measures": ",".join(f"{r['question_id']}:{r['keys_covered']}" for r in low)}
    extra = [c for df in external or [] for c in df.columns if c != inputs.key]
    return BuiltMart(table, inputs.key, spec, [marts.prevalence_column(m) for m in spec.measures] + extra, metadata, source_rows(inputs))


def source_rows(inputs: marts.MartInputs) -> DataFrame:
    """Rows behind a mart, per source."""
    return tables.row_counts({"population": inputs.population, "observations": inputs.observations, "payments": inputs.payments})


def title_rows(points: DataFrame, column: str, key: str, names: DataFrame, k: int = 12, whole: bool = False) -> DataFrame:
    """Ranking bars: top k by a column with looked-up names, and the ``hi`` flag."""
    value = F.round(column, 0).cast("long") if whole else F.col(column)
    return facts.ranked(joins.crosswalk_join(points, names, key), column, key, k).select(
        key, "name", value.alias("value"), "hi")

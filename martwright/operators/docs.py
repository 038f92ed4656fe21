"""Data dictionary, logical schema and lineage of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martwright.functions import numeric as num
from martwright.functions import text as txt
from martwright.operators import profile, stats


def data_dictionary(df: DataFrame, samples: int = 3, descriptions: dict[str, str] | None = None) -> DataFrame:
    """One row per column: type, nullability, counts, the smallest distinct values as samples, description."""
    facts = profile.column_facts(df, ()).join(profile.value_facts(df, top=0, samples=samples).select("ordinal", "unique_count", "samples"), "ordinal", "left")
    given = descriptions or {}
    described = F.coalesce(*[F.when(F.col("column") == c, F.lit(d)) for c, d in given.items()], txt.describe_column(F.col("column")))
    return facts.select("ordinal", F.col("column").alias("column_name"), F.col("dtype").alias("data_type"),
                        (F.col("null_count") > 0).alias("nullable"), "null_count", F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
                        F.coalesce(F.array_join(F.transform("samples", lambda x: x["value"]), ", "), F.lit("")).alias("sample_values"),
                        described.alias("description"))


def logical_schema(df: DataFrame) -> DataFrame:
    """Columns with logical type and nullability found in the data."""
    df = stats.normalize_nan(df)
    return stats.long_stats(df, [
        {"ordinal": str(i), "column_name": num.sql_literal(f.name), "data_type": num.sql_literal(num.type_family(f.dataType)),
         "nullable": f"count_if({stats.ident(f.name)} IS NULL) > 0", "row_count": "count(1)"}
        for i, f in enumerate(df.schema)])


def type_counts(schema: DataFrame) -> DataFrame:
    """Columns per logical type."""
    return schema.groupBy("data_type").agg(F.count(F.lit(1)).alias("n_columns"))


def lineage_nodes(log: DataFrame, source: str, table: str, rows_in: int, rows_out: int, mart: str | None = None,
                  run_id: str | None = None) -> DataFrame:
    """The path of a dataset: source, each transform step, table and, if given, mart."""
    spark = log.sparkSession
    run = F.lit(run_id or table).alias("run_id")
    steps = log.select(run, F.col("step").alias("ordinal"), F.lit("transform").alias("kind"), F.col("action").alias("title"),
                       F.lit(None).cast("long").alias("n_rows"))
    ends = [(0, "source", source, rows_in), (1000, "table", table, rows_out)]
    if mart:
        ends.append((1001, "mart", mart, None))
    outer = spark.createDataFrame(ends, "ordinal int, kind string, title string, n_rows long")
    return outer.select(run, "*").unionByName(steps)


def lineage_edges(nodes: DataFrame) -> DataFrame:
    """Edges between neighbouring nodes of each run (a run has a handful of nodes)."""
    following = F.lead("title").over(Window.partitionBy("run_id").orderBy("ordinal"))
    return nodes.select("run_id", "ordinal", F.col("title").alias("from_node"), following.alias("to_node")).filter("to_node IS NOT NULL")

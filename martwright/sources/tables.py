"""Tables, catalogue listings, read-through cache, exports and the append-only call log."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright.functions import numeric as num
from martwright.functions import text as txt
from martwright.session import rows_seen, shared_warehouse, stage

AUDIT_SCHEMA = ("ts timestamp, task string, provider string, model string, latency_s double, prompt_chars long, "
                "redaction_count long, success boolean")

# Log times keep their microseconds.
_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def cached_pull(spark: SparkSession, folder: str, name: str, pull: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """Read the cached parquet, or pull, write and read back.  An empty cache never counts as a hit.

    A pull runs once: it is written without asking first whether it is empty.
    """
    path = f"{folder.rstrip('/')}/{name}.parquet"
    if not refresh and path_exists(spark, f"{path}/_SUCCESS"):
        cached = spark.read.parquet(path)
        if not cached.isEmpty():
            return cached
    pull().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_table(df: DataFrame, name: str, folder: str | None = None) -> int:
    """Create or replace a table and return the rows written, counted by the write itself.

    The rows go to a new version beside the old one, and the table is switched only once they are there: a failed
    write leaves the old table, and a table can be rebuilt from itself.  A table of the same columns is switched in one step
    and there at every moment; the version before stays for readers that opened it.  The default place is the warehouse,
    which must be shared by all executors.
    """
    spark = df.sparkSession
    seen = Observation()
    home = f"{(folder or shared_warehouse(spark)).rstrip('/')}/{name}_versions"
    version = f"{home}/{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(version)
    count = rows_seen(seen)
    before = _location(spark, name, df.schema)
    if before is not None:
        spark.sql(f"ALTER TABLE `{name}` SET LOCATION '{version}'")
        spark.catalog.refreshTable(f"`{name}`")
    else:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        spark.catalog.createTable(f"`{name}`", path=version, source="parquet", schema=df.schema)
    _keep_only(spark, home, {version.rsplit("/", 1)[-1], (before or "").rstrip("/").rsplit("/", 1)[-1]})
    return count


def _location(spark: SparkSession, name: str, schema: T.StructType) -> str | None:
    """Where a table's rows are, if it has just these columns and is not partitioned."""
    def plain(columns: T.StructType) -> list[tuple[str, str]]:
        return [(f.name, f.dataType.simpleString()) for f in columns]

    if not spark.catalog.tableExists(f"`{name}`") or plain(spark.table(f"`{name}`").schema) != plain(schema):
        return None
    told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED `{name}`").collect()}
    return told.get("Location") if told.get("Type") == "EXTERNAL" and told.get("Provider") == "parquet" and "# Partition Information" not in told else None


def _keep_only(spark: SparkSession, home: str, kept: set[str]) -> None:
    """Delete the other versions of a table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(home)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.listStatus(path):
        if status.getPath().getName() not in kept:
            store.delete(status.getPath(), True)


def drop_dataset(spark: SparkSession, name: str, history: DataFrame, history_path: str) -> DataFrame:
    """Drop a table and write the run history without its rows to a new path."""
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    history.filter(F.coalesce(F.col("table_name") != name, F.lit(True))).write.parquet(history_path)
    return spark.read.parquet(history_path)


def write_artifact(df: DataFrame, folder: str, name: str, metadata: Mapping[str, object]) -> None:
    """A parquet artifact and its build metadata as a one-row JSON table."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    row = df.sparkSession.range(1).select(*[F.lit(str(v)).alias(k) for k, v in metadata.items()])
    row.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}_build_meta.json")


def export_csv(df: DataFrame, path: str) -> None:
    """RFC 4180: quotes doubled, missing values empty."""
    (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("nullValue", "").option("emptyValue", '""').option("lineSep", "\n").csv(path))


# --- catalogue -----------------------------------------------------------------------------------


def schema_of(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Column listing of several tables, from their schemas alone: table_name, ordinal, column_name, data_type."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, i, f.name, num.type_family(f.dataType)) for t, df in tables.items() for i, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, data_type string")


def list_tables(spark: SparkSession) -> DataFrame:
    """Names in the session catalogue."""
    return spark.createDataFrame([(t.name,) for t in spark.catalog.listTables()], "table_name string")


def describe_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(f"DESCRIBE TABLE `{name}`")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table: table_name, n_rows.  Reads no column data."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def footer_counts(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Rows per parquet table from file footers: the count is pushed into the scan.

    The settings this takes are those of a session of its own; the result's plan keeps them.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return row_counts({t: own.read.parquet(p) for t, p in paths.items()})


def table_catalog(counts: DataFrame, reserved=("reporting_state_health",), hidden=("pipeline_runs",), labels: DataFrame | None = None) -> DataFrame:
    """Tables with kind and label: marts first, then by name; bookkeeping tables are hidden."""
    kind = F.when(F.col("table_name").isin(*reserved) | F.col("table_name").startswith("mart_"), "mart").otherwise("source")
    listed = counts.filter(~F.col("table_name").isin(*hidden))
    if labels is not None:
        listed = listed.join(labels, "table_name", "left").withColumn("label", F.coalesce("label", "table_name"))
    else:
        listed = listed.withColumn("label", F.col("table_name"))
    return listed.withColumn("kind", kind).select("table_name", "label", "kind", "n_rows").orderBy(F.col("kind") != "mart", F.lower("table_name"))


def described_schema(schema: DataFrame, counts: DataFrame) -> DataFrame:
    """Column listing with a description of each column and the rows of its table."""
    return (schema.join(counts, "table_name", "left")
            .select("table_name", "ordinal", "column_name", "data_type", "n_rows",
                    txt.describe_column(F.col("column_name")).alias("description")))


def volume_funnel(counts: DataFrame) -> DataFrame:
    """Rows per source with the total and the number of non-empty sources.

    The counts, a row per source, are staged, so that no table is counted twice.
    """
    counts = stage(counts, "counts")
    seen = counts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total"), F.count_if(F.col("n_rows") > 0).alias("filled")).first()
    return counts.select("table_name", "n_rows", F.lit(seen["total"]).cast("long").alias("total_rows"), F.lit(seen["filled"]).cast("long").alias("non_empty_sources"))


# --- call log --------------------------------------------------------------------------------------


def append_calls(calls: DataFrame, folder: str) -> None:
    """Append call records to the JSON-lines log."""
    calls.write.mode("append").options(**_MICROS).json(folder)


def read_calls(spark: SparkSession, folder: str, limit: int = 100, *, tie: str | None = None, schema: str = AUDIT_SCHEMA) -> DataFrame:
    """Newest call records first; broken lines are skipped."""
    if not path_exists(spark, folder):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").options(**_MICROS).json(folder)
    return rows.orderBy(F.desc("ts"), *([F.desc(tie)] if tie else [])).limit(limit)

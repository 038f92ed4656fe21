"""Run history, artifacts, registry and drift between two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martwright.functions import numeric as num

RUN_SCHEMA = ("run_id string, dataset_name string, source_name string, started_at string, duration_s double, rows_in bigint, "
              "rows_out bigint, grade string, score double, gate_blocked boolean, table_name string")
TOP_NULL_DELTAS = 10


def record_run(spark: SparkSession, folder: str, run: dict, artifacts: dict[str, DataFrame] | None = None) -> str:
    """Append one run row and its artifact tables, each in the run's own partition."""
    row = spark.createDataFrame([run], RUN_SCHEMA)
    row.write.mode("append").partitionBy("dataset_name").parquet(f"{folder}/runs")
    for name, table in (artifacts or {}).items():
        save_artifact(table, folder, run["run_id"], name)
    return run["run_id"]


def save_artifact(table: DataFrame, folder: str, run_id: str, name: str) -> None:
    """Write or replace one artifact of one run; other runs' partitions stay."""
    (table.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id").parquet(f"{folder}/artifacts/{name}"))


def load_artifact(spark: SparkSession, folder: str, run_id: str, name: str) -> DataFrame:
    """One artifact of one run; only its partition is read."""
    return spark.read.parquet(f"{folder}/artifacts/{name}").filter(F.col("run_id") == run_id)


def read_artifacts(spark: SparkSession, folder: str, name: str, *run_ids: str) -> DataFrame:
    """One artifact of several runs, with their ids; other runs' partitions are not read."""
    return spark.read.parquet(f"{folder}/artifacts/{name}").filter(F.col("run_id").isin(*run_ids))


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).parquet(f"{folder}/runs")


def list_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    """Newest runs first."""
    return runs.orderBy(F.desc("started_at"), F.asc("run_id")).limit(limit)


def latest_per(runs: DataFrame, key: str) -> DataFrame:
    """The newest run of each key.  Only one candidate row per key and task is shuffled."""
    newest = Window.partitionBy(key).orderBy(F.desc("started_at"), F.asc("run_id"))
    return runs.withColumn("__rank", F.row_number().over(newest)).filter("__rank = 1").drop("__rank")


def live_runs(runs: DataFrame, live: DataFrame, reserved=("reporting_state_health", "pipeline_runs")) -> DataFrame:
    """Latest run of every table that still exists and is neither reserved nor a mart."""
    named = runs.filter((F.col("table_name") != "") & ~F.col("table_name").isin(*reserved) & ~F.col("table_name").startswith("mart_"))
    return latest_per(named.join(live, "table_name", "left_semi"), "table_name")


def upsert_registry(old: DataFrame, new: DataFrame, key: str = "table_name") -> DataFrame:
    """New entries replace old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def overview(runs: DataFrame) -> DataFrame:
    """One row of headline figures over all runs, in one pass."""
    loaded = ~F.col("gate_blocked")
    letter = num.grade(F.col("score"))
    counts = {g: F.count_if(loaded & (letter == g)).alias(f"grade_{g.lower()}") for g in "ABCF"}
    seen = runs.agg(F.count(F.lit(1)).alias("total_runs"), F.count_if(loaded).alias("loaded_runs"),
                    F.round(F.coalesce(F.avg(F.when(loaded & (F.col("score") != 0), F.col("score"))), F.lit(0.0)), 1).alias("avg_score"),
                    F.max("started_at").alias("last_run"), *counts.values())
    most = F.greatest(*[F.col(f"grade_{g.lower()}") for g in "ABCF"])
    top = F.when(most == 0, F.lit("—")).otherwise(F.coalesce(*[F.when(F.col(f"grade_{g.lower()}") == most, F.lit(g)) for g in "ABCF"]))
    return seen.withColumn("top_grade", top)


def freshness(built: Column, as_of: Column, stale_after_days: int = 7) -> dict[str, Column]:
    """Whole days since a build and whether that is stale."""
    age = num.age_days(built, as_of)
    return {"age_days": age, "is_stale": age > stale_after_days}


# --- drift -----------------------------------------------------------------------------------------


def _matched(before: DataFrame, after: DataFrame) -> DataFrame:
    a = before.select("column", F.col("dtype").alias("from_type"), F.col("null_pct").alias("from_pct"), F.lit(True).alias("in_a"))
    b = after.select("column", F.col("dtype").alias("to_type"), F.col("null_pct").alias("to_pct"), F.lit(True).alias("in_b"))
    return a.join(b, "column", "full_outer")


def drift_columns(before: DataFrame, after: DataFrame) -> DataFrame:
    """Every column of either profile with its change: added, removed or common."""
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").otherwise("common")
    return _matched(before, after).select("column", change.alias("change"))


def drift_types(before: DataFrame, after: DataFrame) -> DataFrame:
    """Shared columns whose type changed."""
    return _matched(before, after).filter("from_type <> to_type").select("column", "from_type", "to_type")


def drift_nulls(before: DataFrame, after: DataFrame, top: int = TOP_NULL_DELTAS) -> DataFrame:
    """Shared columns whose null rate changed, largest change first."""
    delta = F.round(F.col("to_pct") - F.col("from_pct"), 2)
    return (_matched(before, after).withColumn("delta", delta).filter(F.abs("delta") > 1e-9)
            .orderBy(F.desc(F.abs("delta")), F.asc("column")).limit(top).select("column", "from_pct", "to_pct", "delta"))


def drift_summary(before: DataFrame, after: DataFrame, score_before: DataFrame, score_after: DataFrame) -> DataFrame:
    """One row: counts of schema changes, row and score change, grade change, and whether the shape drifted.

    Row or score changes alone are not drift.
    """
    profiles = before.withColumn("side", F.lit("a")).unionByName(after.withColumn("side", F.lit("b")))
    scores = score_before.withColumn("side", F.lit("a")).unionByName(score_after.withColumn("side", F.lit("b")))
    return _drift(profiles, scores, "side", "a", "b")


def drift_of_runs(spark: SparkSession, folder: str, before: str, after: str) -> DataFrame:
    """``drift_summary`` of two recorded runs, from what they stored; only their partitions are read and nothing is profiled again.

    A run that is not there, or stored no columns, counts as one without columns; its row and score changes are null.
    """
    stored = read_artifacts(spark, folder, "columns", before, after)
    runs = read_runs(spark, folder).filter(F.col("run_id").isin(before, after))
    return _drift(stored, runs, "run_id", before, after)


def _drift(profiles: DataFrame, scores: DataFrame, side: str, a: str, b: str) -> DataFrame:
    """Both sides in one grouping by column; figures of whole runs ride along, and no side is read twice."""
    def on(which: str, c: str) -> Column:
        return F.max(F.when(F.col(side) == which, F.col(c)))

    matched = profiles.groupBy("column").agg(
        *[on(which, c).alias(f"{name}_{which_name}") for which, which_name in ((a, "a"), (b, "b")) for c, name in (("dtype", "type"), ("null_pct", "pct"), ("row_count", "rows"))])
    changes = {
        "added_columns": F.col("type_a").isNull(), "removed_columns": F.col("type_b").isNull(), "type_changes": F.col("type_a") != F.col("type_b"),
        "null_rate_changes": F.abs(F.round(F.col("pct_b") - F.col("pct_a"), 2)) > 1e-9}
    shape = matched.agg(*[F.count_if(test).alias(name) for name, test in changes.items()], (F.max("rows_b") - F.max("rows_a")).alias("row_delta"))
    score_a, score_b, grade_a, grade_b = (on(which, c) for c in ("score", "grade") for which in (a, b))
    score = scores.agg(F.struct(F.round(score_b - score_a, 2).alias("delta"),
                                F.when(grade_a != grade_b, F.concat(grade_a, F.lit("→"), grade_b)).alias("grade")).alias("s")).scalar()
    drifted = sum((F.col(name) for name in changes), F.lit(0)) > 0
    return shape.select("*", score["delta"].alias("score_delta"), score["grade"].alias("grade_change"), drifted.alias("has_drift"))

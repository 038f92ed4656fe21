"""Streams over the append-only call log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from martwright import rules
from martwright.operators import audit
from martwright.sources.tables import AUDIT_SCHEMA


def read_calls(spark: SparkSession, folder: str, schema: str = AUDIT_SCHEMA, files_per_trigger: int = 1000) -> DataFrame:
    """New log files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def running_metrics(calls: DataFrame) -> DataFrame:
    """Audit metrics over everything seen so far; five counters of state.  Use complete mode."""
    return audit.with_shares(calls.groupBy().agg(*audit.metric_columns()))


def calls_in_last_minute(calls: DataFrame, user: str = "user_id", limit: int = rules.CALLS_PER_MINUTE,
                         slide: str = "10 seconds", lateness: str = "1 minute") -> DataFrame:
    """Calls per user in sliding 60-second windows; calls later than ``lateness`` are dropped, state is bounded by it."""
    return (calls.withWatermark("ts", lateness).groupBy(F.window("ts", "60 seconds", slide), user)
            .agg(F.count(F.lit(1)).alias("calls"))
            .select(user, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "calls",
                    (F.col("calls") > limit).alias("over_limit")))


def calls_per_day(calls: DataFrame, user: str = "user_id", limit: int = rules.CALLS_PER_DAY, lateness: str = "1 hour") -> DataFrame:
    """Calls per user and day."""
    return (calls.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), user)
            .agg(F.count(F.lit(1)).alias("calls"))
            .select(user, F.to_date("window.start").alias("day"), "calls", (F.col("calls") > limit).alias("over_limit")))


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all available input into parquet, then stop."""
    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).format("parquet").start(path))


def run_once_updating(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process all available input; every batch appends what it changed, open windows included, under its number.

    State stays bounded by the watermark; ``newest`` reads the result.  A batch that is run again replaces its own rows.
    """
    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(add).start())


def newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of each key, from the batch with the highest number."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


def run_once_replacing(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process all available input; each batch replaces the result (complete mode)."""
    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return (stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(replace).start())

"""The exact sliding minute as a stream: every call's own last 60 seconds, equal to its batch twin.

Windowed stream aggregates answer for fixed slides only.  Here each batch of new calls meets the calls of the minutes before it,
which are kept as a small table beside the checkpoint, so a call counts those up to it to the microsecond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from martwright import rules
from martwright.operators import audit
from martwright.session import drop_path, stage, stage_scope
from martwright.sources.tables import path_exists

WINDOW_MICROS = 60_000_000


def _add(batch: DataFrame, number: int, path: str, history: str, user: str, ts: str, limit: int, lateness_micros: int) -> None:
    spark = batch.sparkSession
    with stage_scope(spark):
        micros = F.unix_micros(F.col(ts).cast("timestamp"))
        fresh = stage(batch.where(F.col(ts).isNotNull()).groupBy(user, ts).agg(F.count(F.lit(1)).alias("calls")).withColumn("micros", micros), "fresh_calls")
        before = f"{history}/batch={number - 1}"
        known = spark.read.parquet(before) if number and path_exists(spark, f"{before}/_SUCCESS") else fresh.limit(0)
        newest = known.agg(F.max("micros")).first()[0]
        # Calls up to here are too late: what they would change has been told, and the calls before them are forgotten.
        closed = None if newest is None else newest - lateness_micros
        late = F.lit(False) if closed is None else F.col("micros") <= closed
        fresh.where(late).drop("micros").write.mode("overwrite").parquet(f"{path}_late/batch={number}")
        fresh = fresh.where(~late)
        every = stage(known.unionByName(fresh).groupBy(user, ts, "micros").agg(F.sum("calls").alias("calls")), "kept_calls")

        # A new call changes its own minute and that of every call less than 60 seconds after it.
        told = audit.sliding_minute(every.select(user, ts, "calls"), user, ts, limit)
        least = fresh.agg(F.min("micros")).first()[0]
        changed = told.where(micros >= F.lit(least)) if least is not None else told.limit(0)
        changed.write.mode("overwrite").parquet(f"{path}/batch={number}")

        last = every.agg(F.max("micros")).first()[0]
        kept = every.where(F.col("micros") > F.lit(last) - (lateness_micros + WINDOW_MICROS)) if last is not None else every
        kept.write.mode("overwrite").parquet(f"{history}/batch={number}")
    drop_path(spark, f"{history}/batch={number - 2}")


def run_sliding_minute(calls: DataFrame, path: str, checkpoint: str, user: str = "user_id", ts: str = "ts", limit: int = rules.CALLS_PER_MINUTE,
                       lateness_seconds: int = 60) -> StreamingQuery:
    """Process all available calls: ``user``, ``ts``, ``calls``, ``last_minute``, ``over_limit`` per instant, under the batch that told it.

    ``newest`` reads the result.  A call may come ``lateness_seconds`` behind the newest call of earlier batches; later ones are
    written to ``{path}_late`` and not counted.  Kept beside the checkpoint are the instants of the last minute and the lateness, per user,
    whatever the length of the log.  A null user is a user; calls without a time are passed over.  A batch that is run again
    replaces its own rows and reads the history of the batch before it, so it tells the same.
    """
    def add(batch: DataFrame, number: int) -> None:
        _add(batch, number, path, f"{checkpoint}_history", user, ts, limit, lateness_seconds * 1_000_000)

    return calls.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()

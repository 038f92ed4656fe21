"""Call-audit metrics and call-rate checks; the batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright import rules
from martwright.functions import numeric as num

_MINUTE_MICROS = 60_000_000


def is_local(provider: Column) -> Column:
    return F.coalesce(F.lower(provider).isin(*rules.LOCAL_PROVIDERS), F.lit(False))


def is_cloud(provider: Column) -> Column:
    """Neither a local provider nor no provider at all."""
    return ~F.lower(F.coalesce(provider, F.lit(""))).isin(*rules.LOCAL_PROVIDERS, *rules.NO_PROVIDERS)


def metric_columns() -> list[Column]:
    """Aggregates of the call audit; usable on a table and on a stream."""
    provider = F.col("provider")
    return [F.count(F.lit(1)).alias("total_calls"), F.count_if(is_local(provider)).alias("local_calls"),
            F.count_if(is_cloud(provider)).alias("cloud_calls"),
            F.coalesce(F.sum("redaction_count"), F.lit(0)).alias("total_redactions"),
            F.coalesce(F.sum(F.when(is_cloud(provider), F.col("prompt_chars"))), F.lit(0)).alias("cloud_prompt_chars")]


def with_shares(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns({"local_pct": num.percentage(F.col("local_calls"), F.col("total_calls"), 1),
                                "cloud_pct": num.percentage(F.col("cloud_calls"), F.col("total_calls"), 1)})


def metrics(calls: DataFrame) -> DataFrame:
    """One row: calls by place, shares, redactions, and characters that left the machine (cloud calls only)."""
    return with_shares(calls.agg(*metric_columns()))


def calls_last_minute(calls: DataFrame, user: str, ts: str, limit: int = rules.CALLS_PER_MINUTE) -> DataFrame:
    """Calls of a user in the 60 seconds up to each call time, and whether the limit is exceeded.

    Calls at one instant are counted first.  Each count then belongs to its own minute
    slot and, as history, to the next one; the sliding sum runs inside (user, slot), so
    even a user with most of the traffic is spread over as many groups as minutes.
    """
    return sliding_minute(calls.groupBy(user, ts).agg(F.count(F.lit(1)).alias("calls")), user, ts, limit)


def sliding_minute(instants: DataFrame, user: str, ts: str, limit: int = rules.CALLS_PER_MINUTE) -> DataFrame:
    """``calls_last_minute`` of calls that are counted per instant (``calls``) already."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    slot = F.floor(micros / _MINUTE_MICROS)
    slots = F.explode(F.array(F.struct(slot.alias("slot"), F.lit(True).alias("own")),
                              F.struct((slot + 1).alias("slot"), F.lit(False).alias("own"))))
    spread = instants.select(user, ts, "calls", micros.alias("micros"), slots.alias("x")).select(user, ts, "calls", "micros", "x.*")
    last_minute = Window.partitionBy(user, "slot").orderBy("micros").rangeBetween(-(_MINUTE_MICROS - 1), 0)
    return (spread.withColumn("last_minute", F.sum("calls").over(last_minute)).filter("own")
            .select(user, ts, "calls", "last_minute", (F.col("last_minute") > limit).alias("over_limit")))


def calls_per_day(calls: DataFrame, user: str, ts: str, limit: int = rules.CALLS_PER_DAY) -> DataFrame:
    """Calls per user and calendar day, and whether the daily limit is exceeded."""
    return (calls.groupBy(user, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("calls"))
            .withColumn("over_limit", F.col("calls") > limit))

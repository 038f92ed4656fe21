"""Queries that run the streams over the call log to completion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.catalogue.base import Bench, query
from martwright.session import stage_path
from martwright.sources import tables
from martwright.streaming import calls, sliding

_SCHEMA = "event_id long, ts timestamp, task string, provider string, prompt_chars long, redaction_count long, user_id long"


def _log(t: Bench) -> DataFrame:
    path = stage_path(t.spark, "call-log")
    tables.append_calls(t.audit.withColumn("ts", t.audit["ts"].cast("timestamp")), path)
    return calls.read_calls(t.spark, path, _SCHEMA)


@query("stream_audit_metrics", """SELECT count(*) AS total_calls, count(*) FILTER (WHERE lower(provider) IN ('ollama', 'gemma', 'local')) AS local_calls,
count(*) FILTER (WHERE lower(provider) NOT IN ('ollama', 'gemma', 'local', 'none', '')) AS cloud_calls, CAST(sum(redaction_count) AS BIGINT) AS total_redactions,
CAST(sum(CASE WHEN lower(provider) NOT IN ('ollama', 'gemma', 'local', 'none', '') THEN prompt_chars END) AS BIGINT) AS cloud_prompt_chars,
round(count(*) FILTER (WHERE lower(provider) IN ('ollama', 'gemma', 'local')) * 100.0E0 / count(*), 1) AS local_pct,
round(count(*) FILTER (WHERE lower(provider) NOT IN ('ollama', 'gemma', 'local', 'none', '')) * 100.0E0 / count(*), 1) AS cloud_pct FROM audit""")
def stream_audit_metrics(t: Bench) -> DataFrame:
    out = stage_path(t.spark, "audit-metrics")
    calls.run_once_replacing(calls.running_metrics(_log(t)), out, stage_path(t.spark, "audit-checkpoint")).awaitTermination()
    return t.spark.read.parquet(out)


def _updated(t: Bench, stream: DataFrame, keys: list[str]) -> DataFrame:
    out = stage_path(t.spark, "updates")
    calls.run_once_updating(stream, out, stage_path(t.spark, "updates-checkpoint")).awaitTermination()
    return calls.newest(t.spark.read.parquet(out), keys)


@query("stream_calls_per_day", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS calls, count(*) > 200 AS over_limit FROM audit GROUP BY user_id, CAST(ts AS DATE)")
def stream_calls_per_day(t: Bench) -> DataFrame:
    return _updated(t, calls.calls_per_day(_log(t)), ["user_id", "day"])


@query("stream_calls_sliding", """WITH e AS (SELECT user_id, time_bucket(INTERVAL '10 seconds', ts, TIMESTAMP '1970-01-01 00:00:00') AS slot FROM audit),
w AS (SELECT user_id, slot - k * INTERVAL '10 seconds' AS window_start FROM e, range(6) r(k))
SELECT user_id, window_start, window_start + INTERVAL '60 seconds' AS window_end, count(*) AS calls, count(*) > 20 AS over_limit FROM w GROUP BY user_id, window_start""")
def stream_calls_sliding(t: Bench) -> DataFrame:
    found = _updated(t, calls.calls_in_last_minute(_log(t), limit=20), ["user_id", "window_start", "window_end"])
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("stream_last_minute", """WITH i AS (SELECT user_id, ts, count(*) AS calls FROM audit GROUP BY user_id, ts)
SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, calls, CAST(sum(calls) OVER w AS BIGINT) AS last_minute, sum(calls) OVER w > 5 AS over_limit FROM i
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '59.999999 seconds' PRECEDING AND CURRENT ROW)""")
def stream_last_minute(t: Bench) -> DataFrame:
    """The log arrives in three pieces by time; the stream goes on where it stopped."""
    log, out, mark = (stage_path(t.spark, label) for label in ("call-log", "last-minute", "last-minute-checkpoint"))
    entries = t.audit.withColumn("ts", t.audit["ts"].cast("timestamp"))
    ends = entries.agg(F.percentile_approx(F.unix_micros("ts"), [0.3, 0.7])).first()[0]
    piece = F.when(F.unix_micros("ts") < ends[0], 0).when(F.unix_micros("ts") < ends[1], 1).otherwise(2)
    for k in range(3):
        tables.append_calls(entries.where(piece == k), log)
        sliding.run_sliding_minute(calls.read_calls(t.spark, log, _SCHEMA), out, mark).awaitTermination()
    return calls.newest(t.spark.read.parquet(out), ["user_id", "ts"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))

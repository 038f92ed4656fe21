"""Queries over run history, registry, drift and the call audit."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.catalogue.base import Bench, query
from martwright.catalogue.profiles import _DIRTY_TYPES, _ONBOARDED, _SUMMARY, SCORECARD, _columns_sql, _completeness_sql, _duplicates_sql, _mix_sql, _nulls_sql, _ranges_sql, _unique_sql
from martwright.operators import audit, history, profile, quality
from martwright.plans import onboard as onboarding
from martwright.session import stage, stage_path
from martwright.sources import versions

_GRADE = "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'F' END"


@query("latest_run", """SELECT table_name, run_id, dataset_name, started_at, rows_in, score, gate_blocked FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY started_at DESC, run_id) AS k FROM runs) WHERE k = 1""")
def latest_run(t: Bench) -> DataFrame:
    return history.latest_per(t.runs, "table_name").select("table_name", "run_id", "dataset_name", "started_at", "rows_in", "score", "gate_blocked")


@query("list_runs", "SELECT run_id, dataset_name, started_at, rows_in, score FROM runs ORDER BY started_at DESC, run_id LIMIT 50")
def list_runs(t: Bench) -> DataFrame:
    return history.list_runs(t.runs, 50).select("run_id", "dataset_name", "started_at", "rows_in", "score")


@query("live_runs", """SELECT table_name, run_id, started_at FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY started_at DESC, run_id) AS k FROM runs
WHERE table_name <> '' AND table_name IN (SELECT concat('t_', CAST(n_nationkey AS VARCHAR)) FROM nation WHERE n_nationkey <> 3) AND table_name <> 't_5') WHERE k = 1""")
def live_runs(t: Bench) -> DataFrame:
    live = t.nation.filter("n_nationkey <> 3").select(F.concat(F.lit("t_"), F.col("n_nationkey").cast("string")).alias("table_name"))
    return history.live_runs(t.runs, live, reserved=("t_5",)).select("table_name", "run_id", "started_at")


@query("run_overview", f"""WITH g AS (SELECT *, {_GRADE} AS grade FROM runs), c AS (SELECT count(*) AS total_runs, count(*) FILTER (WHERE NOT gate_blocked) AS loaded_runs,
round(coalesce(avg(score) FILTER (WHERE NOT gate_blocked AND score <> 0), 0), 1) AS avg_score, max(started_at) AS last_run, count(*) FILTER (WHERE NOT gate_blocked AND grade = 'A') AS grade_a,
count(*) FILTER (WHERE NOT gate_blocked AND grade = 'B') AS grade_b, count(*) FILTER (WHERE NOT gate_blocked AND grade = 'C') AS grade_c, count(*) FILTER (WHERE NOT gate_blocked AND grade = 'F') AS grade_f FROM g)
SELECT *, CASE greatest(grade_a, grade_b, grade_c, grade_f) WHEN grade_a THEN 'A' WHEN grade_b THEN 'B' WHEN grade_c THEN 'C' ELSE 'F' END AS top_grade FROM c""")
def run_overview(t: Bench) -> DataFrame:
    return history.overview(t.runs)


@query("record_run", f"""WITH {_ONBOARDED} SELECT 'orders' AS dataset_name, (SELECT count(*) FROM dirty_orders) AS rows_in, (SELECT count(*) FROM cleaned) AS rows_out, grade, score,
grade <> 'A' AS gate_blocked, CASE WHEN grade <> 'A' THEN '' ELSE 'orders' END AS table_name, total_checks AS checks_recorded FROM summary""")
def record_run(t: Bench) -> DataFrame:
    folder = stage_path(t.spark, "history")
    result = onboarding.onboard(t.spark, t.dirty_orders, "orders", "orders.csv", minimum_grade="A", load=False)
    run_id = onboarding.record(t.spark, result, folder)
    recorded = history.load_artifact(t.spark, folder, run_id, "scorecard").agg(F.count(F.lit(1)).alias("x")).scalar()
    return history.list_runs(history.read_runs(t.spark, folder)).select(
        "dataset_name", "rows_in", "rows_out", "grade", "score", "gate_blocked", "table_name", recorded.alias("checks_recorded"))


@query("run_artifact", "SELECT o_orderpriority, count(*) AS n, 'run_b' AS run_id FROM orders GROUP BY o_orderpriority")
def run_artifact(t: Bench) -> DataFrame:
    """An artifact is read back by its run; another run's of the same name stays apart."""
    folder = stage_path(t.spark, "artifacts")
    counted = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    for run_id, table in (("run_a", counted.limit(1)), ("run_b", counted)):
        history.save_artifact(table, folder, run_id, "counts")
    return history.load_artifact(t.spark, folder, "run_b", "counts")


@query("registry_upsert", """SELECT * FROM registry_new UNION ALL SELECT * FROM registry_old WHERE table_name NOT IN (SELECT table_name FROM registry_new)""")
def registry_upsert(t: Bench) -> DataFrame:
    return history.upsert_registry(t.registry_old, t.registry_new).orderBy(F.desc("built_at"), "table_name")


@query("registry_stored", """SELECT *, 2 AS version FROM registry_new UNION ALL
SELECT *, 2 FROM registry_old WHERE table_name NOT IN (SELECT table_name FROM registry_new)
UNION ALL SELECT *, 1 FROM registry_old""")
def registry_stored(t: Bench) -> DataFrame:
    """Both versions of a registry that was stored, upserted and read back."""
    home = stage_path(t.spark, "registry")
    for entries in (t.registry_old, t.registry_new):
        versions.upsert(entries, home)
    return versions.read(t.spark, home, 1).withColumn("version", F.lit(1)).unionByName(versions.read(t.spark, home).withColumn("version", F.lit(2)))


# --- drift -----------------------------------------------------------------------------------------------

_AFTER_TYPES = (("order_id", "INTEGER"), ("total_price", "FLOAT"), ("line_count", "FLOAT"), ("priority", "VARCHAR"), ("qty_text", "FLOAT"),
                ("order_date", "TIMESTAMP"), ("priority_length", "INTEGER"))
_DRIFT = f"""a AS ({_columns_sql('dirty_orders', _DIRTY_TYPES)}), b AS ({_columns_sql('drift_after', _AFTER_TYPES)}),
m AS (SELECT coalesce(a."column", b."column") AS "column", a.dtype AS from_type, b.dtype AS to_type, a.null_pct AS from_pct, b.null_pct AS to_pct,
a."column" IS NOT NULL AS in_a, b."column" IS NOT NULL AS in_b FROM a FULL OUTER JOIN b ON a."column" = b."column")"""
_AFTER_COLUMNS = tuple(c for c, _ in _AFTER_TYPES)
_AFTER_SCORECARD = " UNION ALL ".join([
    _completeness_sql("drift_after", _AFTER_COLUMNS), _duplicates_sql("drift_after", _AFTER_COLUMNS), _nulls_sql("drift_after", _AFTER_COLUMNS),
    _mix_sql("drift_after", ((3, "priority"),)),
    _ranges_sql("drift_after", ((0, "order_id"), (1, "total_price"), (2, "line_count"), (4, "qty_text"), (6, "priority_length")), ("line_count",)),
    _unique_sql("drift_after", 0, "order_id")])


def _profiles(t: Bench) -> tuple[DataFrame, DataFrame]:
    return profile.columns(t.dirty_orders), profile.columns(t.drift_after)


@query("drift_columns", f"""WITH {_DRIFT} SELECT "column", CASE WHEN NOT in_a THEN 'added' WHEN NOT in_b THEN 'removed' ELSE 'common' END AS change FROM m""")
def drift_columns(t: Bench) -> DataFrame:
    return history.drift_columns(*_profiles(t))


@query("drift_types", f"""WITH {_DRIFT} SELECT "column", from_type, to_type FROM m WHERE from_type <> to_type""")
def drift_types(t: Bench) -> DataFrame:
    return history.drift_types(*_profiles(t))


@query("drift_nulls", f"""WITH {_DRIFT} SELECT "column", from_pct, to_pct, round(to_pct - from_pct, 2) AS delta FROM m WHERE abs(round(to_pct - from_pct, 2)) > 1e-9
ORDER BY abs(round(to_pct - from_pct, 2)) DESC, "column" LIMIT 10""")
def drift_nulls(t: Bench) -> DataFrame:
    return history.drift_nulls(*_profiles(t))


_DRIFT_SUMMARY = f"""{_DRIFT}, c AS ({SCORECARD}), {_SUMMARY}, c2 AS ({_AFTER_SCORECARD}), {_SUMMARY.replace('summary AS', 'summary2 AS').replace('FROM c)', 'FROM c2)')},
s AS (SELECT count(*) FILTER (WHERE NOT in_a) AS added_columns, count(*) FILTER (WHERE NOT in_b) AS removed_columns, count(*) FILTER (WHERE from_type <> to_type) AS type_changes,
count(*) FILTER (WHERE abs(round(to_pct - from_pct, 2)) > 1e-9) AS null_rate_changes FROM m)
SELECT *, (SELECT max(row_count) FROM b) - (SELECT max(row_count) FROM a) AS row_delta, round((SELECT score FROM summary2) - (SELECT score FROM summary), 2) AS score_delta,
CASE WHEN (SELECT grade FROM summary) <> (SELECT grade FROM summary2) THEN concat((SELECT grade FROM summary), '→', (SELECT grade FROM summary2)) END AS grade_change,
added_columns + removed_columns + type_changes + null_rate_changes > 0 AS has_drift FROM s"""


def _recorded(t: Bench, *views: str) -> tuple[str, list[str]]:
    """A history folder with one recorded run per view."""
    folder = stage_path(t.spark, "history")
    return folder, [onboarding.snapshot(t.spark, t.table(v), "orders", folder) for v in views]


@query("drift_summary", f"WITH {_DRIFT_SUMMARY}")
def drift_summary(t: Bench) -> DataFrame:
    folder, (before, after) = _recorded(t, "dirty_orders", "drift_after")
    return history.drift_of_runs(t.spark, folder, before, after)


@query("drift_flag", f"""WITH {_DRIFT} SELECT 'typed' AS pair, count(*) FILTER (WHERE NOT in_a OR NOT in_b OR from_type <> to_type OR abs(round(to_pct - from_pct, 2)) > 1e-9) > 0 AS has_drift FROM m
UNION ALL SELECT 'same', FALSE""")
def drift_flag(t: Bench) -> DataFrame:
    before, after = (stage(p, "profile") for p in _profiles(t))
    score = t.spark.createDataFrame([(0.0, "F")], "score double, grade string")
    pairs = [("typed", after), ("same", before)]
    parts = [history.drift_summary(before, other, score, score).select(F.lit(name).alias("pair"), "has_drift") for name, other in pairs]
    return parts[0].unionByName(parts[1])


# --- call audit --------------------------------------------------------------------------------------------


@query("audit_metrics", """SELECT count(*) AS total_calls, count(*) FILTER (WHERE lower(provider) IN ('ollama', 'gemma', 'local')) AS local_calls,
count(*) FILTER (WHERE lower(provider) NOT IN ('ollama', 'gemma', 'local', 'none', '')) AS cloud_calls, CAST(sum(redaction_count) AS BIGINT) AS total_redactions,
CAST(sum(CASE WHEN lower(provider) NOT IN ('ollama', 'gemma', 'local', 'none', '') THEN prompt_chars END) AS BIGINT) AS cloud_prompt_chars,
round(count(*) FILTER (WHERE lower(provider) IN ('ollama', 'gemma', 'local')) * 100.0E0 / count(*), 1) AS local_pct,
round(count(*) FILTER (WHERE lower(provider) NOT IN ('ollama', 'gemma', 'local', 'none', '')) * 100.0E0 / count(*), 1) AS cloud_pct FROM audit""")
def audit_metrics(t: Bench) -> DataFrame:
    return audit.metrics(t.audit)


@query("calls_last_minute", """WITH i AS (SELECT user_id, ts, count(*) AS calls FROM audit GROUP BY user_id, ts)
SELECT user_id, ts, calls, CAST(sum(calls) OVER w AS BIGINT) AS last_minute, sum(calls) OVER w > 5 AS over_limit FROM i
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '59.999999' SECOND PRECEDING AND CURRENT ROW)""")
def calls_last_minute(t: Bench) -> DataFrame:
    return audit.calls_last_minute(t.audit, "user_id", "ts")


@query("calls_per_day", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS calls, count(*) > 200 AS over_limit FROM audit GROUP BY user_id, CAST(ts AS DATE)")
def calls_per_day(t: Bench) -> DataFrame:
    return audit.calls_per_day(t.audit, "user_id", "ts")



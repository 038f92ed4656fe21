"""Onboarding: profile, transform, check, document, load; a gate may refuse the load."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright import rules
from martwright.functions import text as txt
from martwright.operators import clean, docs, history, profile, quality
from martwright.session import stage, stage_scope
from martwright.sources import files, tables

Progress = Callable[[str, str], None]


class Documents:
    """Documentation of a cleaned dataset, computed when first asked for."""

    def __init__(self, clean_df: DataFrame, profiled: profile.Profile, checks: DataFrame, lineage: DataFrame):
        self._clean, self._profile, self._checks, self.lineage = clean_df, profiled, checks, lineage

    @cached_property
    def dictionary(self) -> DataFrame:
        return docs.data_dictionary(self._clean)

    @cached_property
    def schema(self) -> DataFrame:
        return docs.logical_schema(self._clean)

    @cached_property
    def triage(self) -> DataFrame:
        return quality.triage(self._profile.issues, self._checks)


@dataclass
class OnboardResult:
    """What one onboarding produced.  Every table is a DataFrame."""

    table_name: str
    profile: profile.Profile
    clean: DataFrame
    counts: dict[str, int]
    log: DataFrame
    checks: DataFrame
    summary: DataFrame
    docs: Documents
    grade: str
    score: float
    gate_blocked: bool
    rows_loaded: int | None = None
    run: dict = field(default_factory=dict)


def _silent(step: str, status: str) -> None:
    return None


def onboard(spark: SparkSession, df: DataFrame, dataset: str, source_name: str = "", minimum_grade: str | None = None,
            load: bool = True, folder: str | None = None, loaded_at: datetime | None = None, progress: Progress = _silent,
            approx: bool = False) -> OnboardResult:
    """Run every stage on one dataset.

    Profiles describe the raw rows, checks the cleaned ones (load metadata included), which are staged: checks, dictionary
    and load read them several times, and parsing and stripping their texts costs more than all of that.
    A grade below ``minimum_grade`` skips the load but keeps all documentation.
    """
    started, clock = datetime.now(timezone.utc), time.monotonic()
    progress("profile", "starting")
    profiled = profile.Profile(df, approx)
    progress("profile", "done")
    progress("transform", "starting")
    with stage_scope(spark) as keep:
        cleaned = clean.transform(df, dataset, loaded_at, approx)
        cleaned = replace(cleaned, df=keep(stage(cleaned.df, "cleaned")))
    log = clean.transform_log(spark, cleaned.counts, dataset, loaded_at)
    progress("transform", "done")
    progress("quality", "starting")
    checks = stage(quality.scorecard(cleaned.df), "checks")
    summary = quality.summarize(checks)
    verdict = summary.first()
    progress("quality", "done")
    blocked = minimum_grade is not None and rules.GRADE_RANK[verdict["grade"]] < rules.GRADE_RANK.get(minimum_grade, 0)
    progress("document", "starting")
    name = txt.table_name_of(dataset)
    documents = Documents(cleaned.df, profiled, checks, docs.lineage_nodes(
        log, source_name or dataset, name, cleaned.counts["rows_before"], cleaned.counts["rows_after"]))
    progress("document", "done")
    rows_loaded = None
    if load and not blocked:
        progress("load", "starting")
        rows_loaded = tables.load_table(cleaned.df, name, folder)
        progress("load", "done")
    run = {"run_id": _run_id(started), "dataset_name": dataset, "source_name": source_name,
           "started_at": started.isoformat(), "duration_s": time.monotonic() - clock, "rows_in": cleaned.counts["rows_before"],
           "rows_out": cleaned.counts["rows_after"], "grade": verdict["grade"], "score": verdict["score"],
           "gate_blocked": blocked, "table_name": "" if blocked else name}
    return OnboardResult(name, profiled, cleaned.df, cleaned.counts, log, checks, summary, documents, verdict["grade"],
                         verdict["score"], blocked, rows_loaded, run)


def record(spark: SparkSession, result: OnboardResult, folder: str) -> str:
    """Append the run and its artifacts to the history folder."""
    artifacts = {"profile": result.profile.as_facts(), "columns": result.profile.columns, "scorecard": result.checks, "dictionary": result.docs.dictionary}
    return history.record_run(spark, folder, result.run, artifacts)


def snapshot(spark: SparkSession, df: DataFrame, dataset: str, folder: str, run_id: str | None = None) -> str:
    """Record what drift is told from, columns and score of ``df`` as it is, as a run of its own; nothing is cleaned or loaded."""
    started, clock = datetime.now(timezone.utc), time.monotonic()
    run_id = run_id or _run_id(started)
    columns = profile.columns(df)
    with stage_scope(spark):
        history.save_artifact(columns, folder, run_id, "columns")
        verdict = quality.summarize(quality.scorecard(df)).first()
    rows = history.load_artifact(spark, folder, run_id, "columns").agg(F.max("row_count").alias("n")).first()["n"] or 0
    return history.record_run(spark, folder, {
        "run_id": run_id, "dataset_name": dataset, "source_name": dataset, "started_at": started.isoformat(), "duration_s": time.monotonic() - clock,
        "rows_in": rows, "rows_out": rows, "grade": verdict["grade"], "score": verdict["score"], "gate_blocked": False, "table_name": ""})


def _run_id(started: datetime) -> str:
    return f"run_{started:%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"


def onboard_files(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Onboard several files; one result or error row per file: dataset, rows_in, rows_out, grade, score, error."""
    rows = []
    for path in paths:
        extract = files.load(spark, path)
        error = extract.error or ("file is empty" if extract.df.isEmpty() else None)
        if error:
            rows.append((extract.name, None, None, None, None, error))
            continue
        run = onboard(spark, extract.df, extract.name, source_name=path, **options).run
        rows.append((extract.name, run["rows_in"], run["rows_out"], run["grade"], run["score"], None))
    return spark.createDataFrame(rows, "dataset string, rows_in long, rows_out long, grade string, score double, error string")


def summary_row(result: OnboardResult) -> DataFrame:
    """One row of the outcome."""
    run = result.run
    return result.summary.select(
        F.lit(run["dataset_name"]).alias("dataset_name"), F.lit(result.table_name).alias("table_name"),
        F.lit(run["rows_in"]).cast("long").alias("rows_in"), F.lit(run["rows_out"]).cast("long").alias("rows_out"),
        "total_checks", "checks_passed", "score", "grade", F.lit(result.gate_blocked).alias("gate_blocked"))

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from martwright.operators import audit, history, keywords, profile, quality
from martwright.plans import console, onboard
from martwright.streaming import calls as streams
from tests.conftest import as_set


def test_gate_blocks_the_load_and_keeps_documents(spark, tmp_path):
    df = spark.createDataFrame([(-i, -float(i), -1.5, -i) for i in range(1, 11)], "report_id int, age double, rate double, count int")
    steps = []
    result = onboard.onboard(spark, df, "bad data", minimum_grade="A", folder=str(tmp_path), progress=lambda s, st: steps.append((s, st)))
    assert result.gate_blocked and result.rows_loaded is None and not spark.catalog.tableExists("bad_data")
    assert result.docs.dictionary.count() == 6 and ("load", "starting") not in steps and ("document", "done") in steps


def test_onboard_loads_records_and_lists(spark, encounters, tmp_path):
    folder = str(tmp_path)
    result = onboard.onboard(spark, encounters, "Demo encounters", "enc.csv", minimum_grade="C", folder=folder)
    assert result.rows_loaded == 19 and spark.table("demo_encounters").count() == 19
    run_id = onboard.record(spark, result, folder)
    listed = history.list_runs(history.read_runs(spark, folder)).collect()
    assert [(r["run_id"], r["rows_in"], r["rows_out"], r["table_name"]) for r in listed] == [(run_id, 20, 19, "demo_encounters")]
    history.save_artifact(spark.range(1), folder, "other_run", "scorecard_note")
    history.save_artifact(spark.range(2), folder, run_id, "scorecard_note")
    history.save_artifact(spark.range(3), folder, run_id, "scorecard_note")
    assert history.load_artifact(spark, folder, run_id, "scorecard_note").count() == 3
    assert history.load_artifact(spark, folder, "other_run", "scorecard_note").count() == 1
    assert history.load_artifact(spark, folder, run_id, "scorecard").count() == result.checks.count()


def test_batch_of_files(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "empty.csv").write_text("a,b\n")
    got = {r["dataset"]: r for r in onboard.onboard_files(spark, [str(tmp_path / f) for f in ("good.csv", "empty.csv", "none.csv")], load=False).collect()}
    assert got["good"]["rows_out"] == 2 and got["good"]["error"] is None
    assert got["empty"]["error"] == "file is empty" and got["none"]["error"]


def test_drift(spark):
    a = spark.createDataFrame([(1, "1", "x"), (2, None, "x")], "id int, v string, gone string")
    b = spark.createDataFrame([(1, 1.0, 5), (2, 2.0, 6), (3, 3.0, 7)], "id int, v double, fresh int")
    pa, pb = profile.columns(a), profile.columns(b)
    assert as_set(history.drift_columns(pa, pb), "column", "change") == {("id", "common"), ("v", "common"), ("gone", "removed"), ("fresh", "added")}
    assert as_set(history.drift_types(pa, pb), "column", "from_type", "to_type") == {("v", "VARCHAR", "FLOAT")}
    assert as_set(history.drift_nulls(pa, pb), "column", "delta") == {("v", -50.0)}
    score = [spark.createDataFrame([(s, g)], "score double, grade string") for s, g in ((80.0, "B"), (95.5, "A"))]
    row = history.drift_summary(pa, pb, *score).first()
    assert (row["row_delta"], row["score_delta"], row["grade_change"], row["has_drift"]) == (1, 15.5, "B→A", True)
    same = history.drift_summary(pa, pa, *score).first()
    assert not same["has_drift"] and same["score_delta"] == 15.5


def test_registry_and_live_runs(spark):
    schema = "table_name string, built_at int"
    merged = history.upsert_registry(spark.createDataFrame([("a", 1), ("b", 1)], schema), spark.createDataFrame([("b", 2), ("c", 2)], schema))
    assert as_set(merged, "table_name", "built_at") == {("a", 1), ("b", 2), ("c", 2)}
    runs = spark.createDataFrame([("r1", "t", "2024-01-01"), ("r2", "t", "2024-01-02"), ("r3", "mart_x", "2024-01-03"), ("r4", "dead", "2024-01-03"), ("r5", "", "2024-01-03")],
                                 "run_id string, table_name string, started_at string")
    live = spark.createDataFrame([("t",), ("mart_x",), ("",)], "table_name string")
    assert as_set(history.live_runs(runs, live), "run_id") == {("r2",)}


def test_triage_order(spark):
    issues = spark.createDataFrame([(0, "a", "constant_column", "info", ""), (1, "b", "high_null_rate", "critical", ""), (2, "c", "high_null_rate", "warning", "")],
                                   "ordinal int, column string, issue string, severity string, detail string")
    checks = spark.createDataFrame([(5, "null_rate_b", False), (6, "uniqueness_id", True), (7, "overall_completeness", False)], "ordinal int, check string, passed boolean")
    assert [(r["rank"], r["check_name"]) for r in quality.triage(issues, checks).collect()] == [
        (0, "high_null_rate_b"), (0, "null_rate_b"), (0, "overall_completeness"), (1, "high_null_rate_c"), (2, "constant_column_a")]
    assert [r["check"] for r in quality.triage_top(checks).collect()] == ["overall_completeness", "null_rate_b"]


# --- call audit ------------------------------------------------------------------------------------------


def test_audit_metrics(spark):
    df = spark.createDataFrame([("ollama", 10, 1), ("Gemini", 100, 2), ("none", 5, 0), (None, 7, 0)], "provider string, prompt_chars long, redaction_count long")
    row = audit.metrics(df).first()
    assert (row["total_calls"], row["local_calls"], row["cloud_calls"], row["total_redactions"], row["cloud_prompt_chars"], row["local_pct"]) == (4, 1, 1, 3, 100, 25.0)
    assert audit.metrics(df.limit(0)).first()["local_pct"] == 0.0


def test_last_minute_equals_brute_force_with_one_hot_user(spark):
    start = datetime(2024, 1, 1)
    seconds = [0, 0, 1, 59, 60, 61, 119, 120, 120, 179, 180, 181, 240] + [300 + i * 0.5 for i in range(60)]
    events = [("hot", start + timedelta(seconds=s)) for s in seconds] + [("cold", start + timedelta(seconds=30))]
    df = spark.createDataFrame(events, "user_id string, ts timestamp_ntz")
    got = {(r["user_id"], r["ts"]): (r["last_minute"], r["over_limit"]) for r in audit.calls_last_minute(df, "user_id", "ts").collect()}
    for user, ts in events:
        n = sum(1 for u, t in events if u == user and timedelta(0) <= ts - t < timedelta(seconds=60))
        assert got[user, ts] == (n, n > 5)


def test_streams_equal_the_batch_twins(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, 0, i % 50), "chat", "ollama" if i % 2 else "gemini", i, i % 3, f"u{i % 2}") for i in range(40)]
    schema = "ts timestamp, task string, provider string, prompt_chars long, redaction_count long, user_id string"
    df = spark.createDataFrame(rows, schema)
    df.repartition(4).write.json(str(tmp_path / "in"))
    stream = streams.read_calls(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    streams.run_once_replacing(streams.running_metrics(stream), str(tmp_path / "m"), str(tmp_path / "c1")).awaitTermination()
    want = audit.metrics(df).first().asDict()
    assert spark.read.parquet(str(tmp_path / "m")).first().asDict() == want
    late = df.unionByName(spark.createDataFrame([(datetime(2024, 1, 1, 1), "chat", "x", 0, 0, "end")], schema))
    late.write.json(str(tmp_path / "in2"))
    window = streams.calls_in_last_minute(streams.read_calls(spark, str(tmp_path / "in2"), schema), slide="60 seconds")
    streams.run_once(window, str(tmp_path / "w"), str(tmp_path / "c2")).awaitTermination()
    assert as_set(spark.read.parquet(str(tmp_path / "w")), "user_id", "calls", "over_limit") == {("u0", 20, True), ("u1", 20, True)}


# --- requests --------------------------------------------------------------------------------------------


def test_measure_picks_equal_brute_force(spark):
    import re
    catalog = [("DIA01", 0, "Diabetes among adults", "Diabetes"), ("NPW14", 1, "Obesity among adults", "Weight"), ("AST01", 2, "Asthma now", "Breathing"), ("XX", 3, "abc", "de")]
    asked = ["obese people and asthma", "DIABETES in adulthood", "nothing here", "breathingxasthma", ""]
    synonyms = {"diabetes": "DIA01", "obese": "NPW14", "obesity": "NPW14"}
    got: dict = {}
    df = spark.createDataFrame(list(enumerate(asked)), "id int, text string")
    cat = spark.createDataFrame(catalog, "question_id string, ordinal long, question string, topic string")
    for r in keywords.pick_measures(df, ["id"], "text", cat, ["DIA01", "AST01"]).orderBy("id", "position").collect():
        got.setdefault(r["id"], []).append(r["question_id"])
    for i, text in enumerate(asked):
        low, picked = text.lower(), []
        for term, q in synonyms.items():
            if term in low and q not in picked:
                picked.append(q)
        for q, _, question, topic in catalog:
            if any(w in low for w in re.findall("[a-z]{4,}", f"{question} {topic}".lower())) and q not in picked:
                picked.append(q)
        assert got[i] == (picked[:6] or ["DIA01", "AST01"]), text


def test_overlap_and_suggestions(spark):
    df = spark.createDataFrame([(1, "medicare spending"), (2, "asthma?"), (3, "zzz"), (4, "")], "id int, text string")
    cat = spark.createDataFrame([("AST01", 0, "Asthma now", "Breathing")], "question_id string, ordinal long, question string, topic string")
    assert as_set(keywords.matches_catalog(df, ["id"], "text", cat), "id", "matched") == {(1, True), (2, True), (3, False), (4, False)}
    metrics = spark.createDataFrame([("ext::t::asthma_rate::mean", 0, "asthma_rate average asthma rate per state")], "metric_id string, ordinal long, meaning string")
    assert as_set(keywords.suggest_metrics(df, ["id"], "text", metrics), "id", "metric_id") == {(2, "ext::t::asthma_rate::mean")}


def test_valid_measures(spark):
    df = spark.createDataFrame([(1, 0, " dia01 "), (1, 1, "NOPE"), (1, 2, "DIA01"), (1, 3, "tob04"), (2, 0, "NOPE")], "r int, o int, m string")
    cat = spark.createDataFrame([("DIA01",), ("TOB04",)], "question_id string")
    assert as_set(keywords.valid_measures(df, "r", "o", "m", cat), "r", "position", "question_id", "is_primary") == {(1, 1, "DIA01", True), (1, 2, "TOB04", False)}


# --- console ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def people(spark):
    return {"people": spark.range(600).select(F.col("id"), (F.col("id") % 3).alias("g"))}


def test_console_runs_selects(spark, people):
    result = console.run_readonly(spark, "```sql\nSELECT * FROM people;\n```", people)
    assert result.ok and result.row_count == 600 and result.rows.count() == 500 and result.columns == ["id", "g"]
    assert console.run_readonly(spark, "WITH x AS (SELECT g, count(*) n FROM people GROUP BY g) SELECT * FROM x", people).row_count == 3
    assert not spark.catalog.tableExists("people")


@pytest.mark.parametrize("sql", ["DROP TABLE people", "SELECT 1 -- DELETE", "WITH a AS (SELECT 1 AS id) MERGE INTO people USING a ON true WHEN MATCHED THEN DELETE",
                                 "SELECT TRANSFORM(id) USING 'cat' AS x FROM people", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM parquet.`/etc/x`",
                                 "SELECT * FROM csv . `/etc/passwd`", "SELECT java_method('java.util.UUID', 'randomUUID')", "",
                                 "SELECT `reflect`('java.lang.System', 'nanoTime')", "SELECT `java_method`('java.util.UUID', 'randomUUID')",
                                 "SELECT reflect/**/('java.util.UUID', 'randomUUID')", "SELECT * FROM `text`.`/etc/hostname`", "SELECT * FROM text/**/.`/etc/hostname`",
                                 "SELECT (SELECT `reflect`('java.util.UUID', 'randomUUID'))", "WITH x AS (SELECT * FROM `text`.`/etc/hostname`) SELECT * FROM x",
                                 "SELECT * FROM people WHERE id IN (SELECT `try_reflect`('java.util.UUID', 'randomUUID'))", "SELECT no_such_function(id) FROM people",
                                 "SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.home')", "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'getProperty', 'user.home')",
                                 "SELECT * FROM people |> SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.home')", "SELECT * FROM IDENTIFIER('people')",
                                 "SELECT raise_error('x')", "SELECT current_user()", "SELECT id FROM people ORDER BY java_method('java.util.UUID', 'randomUUID')",
                                 "SELECT transform(array(1), x -> reflect('java.util.UUID', 'randomUUID'))", "SELECT system.builtin.reflect('java.util.UUID', 'randomUUID')",
                                 "SELECT sum(id) FILTER (WHERE assert_true(id > 0) IS NULL) FROM people", "SELECT * FROM people |> EXTEND version() AS v"])
def test_console_refuses(spark, people, sql):
    result = console.run_readonly(spark, sql, people)
    assert not result.ok and result.rejected and result.reason


def test_console_runs_plain_queries(spark, people):
    for sql, n in (("SELECT g, count(*) AS n FROM people GROUP BY g HAVING count(*) > 0 ORDER BY g", 3), ("SELECT p.*, q.* FROM people p JOIN people q ON p.id = q.id LIMIT 2", 2),
                   ("SELECT * FROM people WHERE id IN (SELECT max(id) FROM people)", 1), ("SELECT id, row_number() OVER (PARTITION BY g ORDER BY id) AS r FROM people", None),
                   ("SELECT 1 AS a UNION ALL SELECT 2", 2), ("SELECT explode(array(1, 2)) AS x", 2), ("SELECT * FROM VALUES (1), (2) t(a)", 2),
                   ("SELECT CAST(id AS DECIMAL(9, 2)) + 1.5, left(CAST(id AS STRING), 2), date_add(DATE '2024-01-01', CAST(id AS INT)), year(DATE '2024-01-01' + INTERVAL 1 MONTH) FROM people", 600),
                   ("SELECT g, transform(collect_list(id), x -> x + 1)[0] AS a, percentile_approx(id, 0.5), lag(max(id)) OVER (ORDER BY g) FROM people GROUP BY g", 3),
                   ("SELECT * FROM range(5) r JOIN people p ON p.id = r.id WHERE EXISTS (SELECT 1 FROM people q WHERE q.id = p.id) AND p.id BETWEEN 1 AND 3", 3),
                   ("SELECT CASE WHEN g LIKE '1%' THEN 'a' ELSE concat_ws('-', 'b', g) END AS k, named_struct('a', 1).a, map('x', id)['x'] FROM people LIMIT 4", 4),
                   ("SELECT g, try_divide(sum(id), count(*)) AS m, round(avg(id), 2) FROM people GROUP BY GROUPING SETS ((g), ())", 4)):
        result = console.run_readonly(spark, sql, people)
        assert result.ok, (sql, result.reason)
        assert n is None or result.row_count == n
    ordered = console.run_readonly(spark, "SELECT id FROM people ORDER BY id DESC", people)
    ids = [r["id"] for r in ordered.rows.collect()]
    assert ids == sorted(ids, reverse=True)


def test_console_reports_engine_errors_apart(spark, people):
    result = console.run_readonly(spark, "SELECT nope FROM people", people)
    assert not result.ok and not result.rejected and result.reason.startswith("Spark error")


def test_drift_of_recorded_runs_reads_only_what_they_stored(spark, tmp_path):
    folder = str(tmp_path / "history")
    first = spark.createDataFrame([(1, "a", None), (2, "b", 1.0)], "id int, name string, cost double")
    second = spark.createDataFrame([(1, 5.0, 2.0), (2, 6.0, 1.0), (3, None, 1.0)], "id int, name double, price double")
    a, b, c = (onboard.snapshot(spark, df, "d", folder) for df in (first, second, first))
    row = history.drift_of_runs(spark, folder, a, b).first()
    assert (row["added_columns"], row["removed_columns"], row["type_changes"], row["null_rate_changes"], row["row_delta"], row["has_drift"]) == (1, 1, 1, 1, 1, True)
    same = history.drift_of_runs(spark, folder, a, c).first()
    assert not same["has_drift"] and same["row_delta"] == 0 and same["score_delta"] == 0.0 and same["grade_change"] is None
    gone = history.drift_of_runs(spark, folder, a, "none").first()
    assert gone["removed_columns"] == 3 and gone["row_delta"] is None and gone["score_delta"] is None
    plan = history.drift_of_runs(spark, folder, a, b)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [run_id" in plan

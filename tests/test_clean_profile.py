import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from martwright.operators import clean, docs, profile, quality
from tests.conftest import as_set


def test_transform_fixture(encounters):
    result = clean.transform(encounters, "enc")
    df, counts = result.df, result.counts
    assert df.columns == ["patient_i_d", "age", "state", "diagnosis", "visit_date", "cost_usd", "_loaded_at", "_source"]
    assert (counts["rows_before"], counts["rows_after"]) == (20, 19)
    assert dict(df.dtypes)["visit_date"] == "timestamp_ntz"
    assert {r[0] for r in df.select("state").distinct().collect()} == {"ca", "ny"}
    # Filled with Unknown, then lower-cased as a low-cardinality column.
    assert df.filter("diagnosis = 'unknown'").count() == 3
    assert {r[0] for r in df.select("_source").distinct().collect()} == {"enc"}


def test_minority_text_becomes_null_then_median(spark):
    df = spark.createDataFrame([("1",), ("2",), ("4",), ("N/A",)], "amount string")
    result = clean.transform(df, "x")
    assert sorted(r["amount"] for r in result.df.collect()) == [1.0, 2.0, 2.0, 4.0]
    assert result.counts["cells_coerced"] == 1


def test_half_or_less_numeric_stays_text(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x",), ("y",)], "a string")
    assert dict(clean.convert_types(df).df.dtypes)["a"] == "string"


def test_dates_need_a_hint_in_the_name(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-01")], "visit_date string, other string")
    assert dict(clean.convert_types(df).df.dtypes) == {"visit_date": "timestamp_ntz", "other": "string"}


def test_integer_median_with_a_half_becomes_double(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    filled = clean.handle_nulls(df).df
    assert sorted(r["a"] for r in filled.collect()) == [1.0, 1.5, 2.0]
    whole = clean.handle_nulls(spark.createDataFrame([(1,), (3,), (None,)], "a int")).df
    assert dict(whole.dtypes)["a"] == "int" and sorted(r["a"] for r in whole.collect()) == [1, 2, 3]


def test_all_missing_number_and_flags_stay(spark):
    df = spark.createDataFrame([(None, None, None)], "a double, b boolean, c timestamp")
    assert clean.handle_nulls(df).df.first() == (None, None, None)


def test_many_distinct_values_keep_their_case(spark):
    df = spark.range(150).select(F.concat(F.lit(" Name "), F.col("id").cast("string")).alias("n"), F.lit(" Yes ").alias("y"))
    cleaned = clean.clean_text_columns(df).df
    assert cleaned.filter("n LIKE 'Name %'").count() == 150 and cleaned.filter("y = 'yes'").count() == 150


@pytest.mark.parametrize("n,expected", [(99, "v"), (100, "V")])
def test_case_limit_is_exact(spark, n, expected):
    df = spark.range(n).select(F.concat(F.lit("V"), F.col("id").cast("string")).alias("n"))
    assert {r[0][0] for r in clean.clean_text_columns(df).df.collect()} == {expected}


def test_dedupe_is_idempotent(encounters):
    once = clean.remove_duplicates(encounters)
    assert clean.remove_duplicates(once).count() == once.count() == 19


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert clean.transform(df, "x").df.count() == 0
    assert profile.overview(df).first()["completeness"] == 0.0
    assert quality.summarize(quality.scorecard(df)).first()["total_checks"] > 0


def test_numeric_profile_equals_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(10, 3, 500), "b": rng.exponential(2, 500)})
    pdf.loc[::7, "a"] = np.nan
    got = {r["column"]: r for r in profile.numeric(spark.createDataFrame(pdf)).collect()}
    for c in pdf:
        s = pdf[c].dropna()
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        outside = ((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum()
        assert got[c]["outlier_count"] == outside
        for metric, value in (("mean", s.mean()), ("median", s.median()), ("std", s.std()), ("q1", q1), ("q3", q3), ("skewness", s.skew())):
            assert got[c][metric] == pytest.approx(value, abs=6e-5)


def test_issues(spark):
    df = spark.range(100).select(F.when(F.col("id") < 40, F.col("id")).alias("mostly_null"), F.when(F.col("id") < 75, 1.5).alias("some_null"),
                                 F.lit("x").alias("same"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    assert as_set(profile.issues(df), "column", "issue", "severity") == {
        ("mostly_null", "high_null_rate", "critical"), ("some_null", "high_null_rate", "warning"), ("some_null", "constant_column", "info"),
        ("same", "constant_column", "info"), ("key", "possible_id_column", "info")}


def test_pii(spark):
    df = spark.createDataFrame([("a@b.org", "123-45-6789", 5.0, "Texas", "Mary Watson", "Smith 22")], "email_addr string, record_number string, cost_usd double, state_name string, last_name string, first_code string")
    assert as_set(profile.pii_columns(df), "column", "reason", "confidence") == {
        ("email_addr", "name_hint:email", "high"), ("record_number", "value_pattern:ssn", "medium"), ("last_name", "name_hint:name", "medium")}


def test_profile_object_matches_the_single_operators(encounters):
    p = profile.Profile(encounters)
    for section, direct in (("columns", profile.columns(encounters)), ("issues", profile.issues(encounters)), ("strings", None),
                            ("pii_columns", profile.pii_columns(encounters))):
        if direct is not None:
            assert sorted(map(tuple, getattr(p, section).collect())) == sorted(map(tuple, direct.collect()))
    assert as_set(p.top_values.filter("rank = 1 and column = 'state'"), "value", "occurrences") == {("CA", 10)}
    assert p.as_facts().filter("section = 'overview' and metric = 'duplicate_rows'").first()["value"] == "1"


def test_correlations(spark):
    df = spark.range(50).select(F.col("id").alias("a"), (F.col("id") * -2.0).alias("b"), F.lit(3).alias("constant"))
    assert [tuple(r) for r in profile.correlations(df).collect()] == [("a", "b", -1.0)]


def test_constant_columns_do_not_break_the_numeric_profile(spark):
    row = profile.numeric(spark.range(20).select(F.lit(0.1).alias("flat"), F.col("id"))).first()
    assert row["std"] == 0.0 and row["skewness"] in (None, 0.0) and row["outlier_count"] == 0


def test_checks(spark):
    df = spark.createDataFrame([(i, -1.0 if i == 3 else 1.0, "7" if i % 2 else "x", None) for i in range(40)], "row_id int, avg_rate double, mixed string, gone string")
    checks = {r["check"]: r for r in quality.scorecard(df).collect()}
    assert not checks["no_negatives_avg_rate"]["passed"] and checks["no_negatives_avg_rate"]["value"] == "1"
    assert not checks["extreme_outliers_avg_rate"]["passed"]
    assert not checks["type_consistency_mixed"]["passed"] and "type_consistency_gone" not in checks
    assert not checks["null_rate_gone"]["passed"] and checks["uniqueness_row_id"]["passed"]
    assert checks["overall_completeness"]["value"] == "75.0" and checks["duplicate_rows"]["passed"]


def test_missing_identifier_breaks_uniqueness(spark):
    df = spark.range(100).select(F.when(F.col("id") > 0, F.col("id")).alias("row_id"))
    check = quality.uniqueness(df).first()
    assert (check["passed"], check["value"], check["threshold"]) == (False, "99", "100")


def test_score_and_dimensions(spark):
    checks = spark.createDataFrame([(0, "overall_completeness", True), (1, "null_rate_a", False), (2, "null_rate_b", True), (3, "uniqueness_c", True)],
                                   "ordinal int, check string, passed boolean")
    summary = quality.summarize(checks).first()
    assert (summary["score"], summary["grade"], summary["checks_failed"]) == (75.0, "B", 1)
    assert as_set(quality.by_dimension(checks), "dimension", "passed", "total") == {("Completeness", 1, 1), ("Missing values", 1, 2), ("Uniqueness", 1, 1)}


def test_dictionary_and_schema(encounters):
    rows = {r["column_name"]: r for r in docs.data_dictionary(encounters).collect()}
    assert rows["diagnosis"]["nullable"] and rows["diagnosis"]["null_count"] == 3
    assert rows["age"]["sample_values"] == "-5, 21, 22" and rows["age"]["description"] == "Age in years"
    schema = docs.logical_schema(encounters)
    assert as_set(docs.type_counts(schema), "data_type", "n_columns") == {("VARCHAR", 4), ("INTEGER", 1), ("FLOAT", 1)}


def test_correlations_of_a_wide_table_take_one_pass(spark):
    wide = spark.range(40).selectExpr("id", *[f"CAST((id * {k} + id * id * {k % 7}) % 101 AS DOUBLE) AS c{k}" for k in range(1, 500)])
    pairs = {(r.column_1, r.column_2) for r in profile.correlations(wide.withColumn("twice", F.col("c3") * 2)).collect()}
    assert ("c3", "twice") in pairs


def test_infinities_do_not_stop_profiles_and_checks(spark):
    df = spark.sql("SELECT * FROM VALUES (1.0D, 'a'), (2.0D, 'b'), (3.0D, 'c'), (double('Infinity'), 'd'), (double('-Infinity'), 'e') t(rate, s)")
    row = profile.numeric(df).first()
    assert (row["min"], row["max"], row["mean"], row["median"], row["outlier_count"]) == (float("-inf"), float("inf"), 2.0, 2.0, 2)
    assert {r["check"]: r["passed"] for r in quality.scorecard(df).collect()}["extreme_outliers_rate"] is False
    assert quality.summarize(quality.scorecard(clean.transform(df, "x").df)).count() == 1


def test_profiles_without_a_kind_of_column_are_empty(spark):
    numbers = spark.range(3)
    assert profile.strings(numbers).count() == profile.moments_in_time(numbers).count() == profile.top_values(numbers).count() == 0
    assert profile.numeric(spark.createDataFrame([("a",)], "s string")).count() == 0


def test_maps_are_deduplicated(spark):
    df = spark.sql("SELECT * FROM VALUES (1, map('a', 1, 'b', 2)), (1, map('b', 2, 'a', 1)), (2, map('a', 1)) t(id, m)")
    assert clean.remove_duplicates(df).count() == 2 and clean.remove_duplicates(df).columns == ["id", "m"]


def test_correlations_of_columns_with_gaps_are_of_complete_rows(spark):
    """500 columns, each with gaps of its own, against pandas; far from zero and on any scale."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 1))
    cells = 1e6 + np.where(rng.random((300, 500)) < 0.5, base, rng.normal(size=(300, 500))) * 10.0 ** rng.integers(-3, 3, 500)
    cells[rng.random(cells.shape) < 0.2] = np.nan
    frame = pd.DataFrame(cells, columns=[f"c{i}" for i in range(500)])
    expected = frame.corr().to_numpy()
    got = {(r.column_1, r.column_2): r.correlation for r in profile.correlations(spark.createDataFrame(frame), above=0.3, digits=6).collect()}
    want = {(f"c{i}", f"c{j}"): expected[i, j] for i in range(500) for j in range(i + 1, 500) if abs(expected[i, j]) > 0.3}
    close = {k for k, r in want.items() if abs(r) - 0.3 < 1e-6}
    assert got.keys() ^ want.keys() <= close and all(abs(got[k] - want[k]) < 2e-6 for k in got.keys() & want.keys())


def test_correlations_leave_out_what_has_no_r(spark):
    inf = float("inf")
    rows = [(1.0, 2.0, 5.0, None, 1.0), (2.0, 4.0, 5.0, 1.0, inf), (3.0, 6.0, 5.0, 1.0, 3.0), (4.0, 8.0, 5.0, 1.0, None), (None, 1.0, 5.0, 7.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, constant double, `constant beside a` double, endless double")
    found = {(r.column_1, r.column_2) for r in profile.correlations(df, above=0.0).collect()}
    assert ("a", "b") in found and ("b", "constant beside a") in found
    assert not any("constant" in p or "endless" in p for p in found) and ("a", "constant beside a") not in found

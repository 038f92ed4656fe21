import pytest
from pyspark.sql import functions as F

from martwright.functions import numeric as num
from martwright.functions import text as txt
from martwright.operators import joins


def values(spark, rows, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_safe_numeric_takes_plain_numbers_only(spark):
    assert values(spark, ["1", " 2.5 ", "-3e2", ".5", "7.", "1d", "1f", "1_000", "abc", "", None, "inf"], num.safe_numeric) == [
        1.0, 2.5, -300.0, 0.5, 7.0, None, None, None, None, None, None, float("inf")]


def test_safe_numeric_text_form_agrees(spark):
    rows = ["1", " 2.5 ", "-3e2", "1d", "N/A", None]
    df = spark.createDataFrame([(v,) for v in rows], "v string")
    assert df.select(num.safe_numeric(F.col("v")).eqNullSafe(F.expr(num.safe_numeric_sql("v"))).alias("same")).filter("not same").isEmpty()


def test_safe_timestamp(spark):
    got = values(spark, ["2024-02-03", "2024-02-03 04:05:06", "02/03/2024", "nope", None], num.safe_timestamp)
    assert [str(g) if g else None for g in got] == ["2024-02-03 00:00:00", "2024-02-03 04:05:06", "2024-02-03 00:00:00", None, None]


def test_grade_bands(spark):
    df = spark.createDataFrame([(100.0,), (90.0,), (89.99,), (75.0,), (60.0,), (59.9,)], "s double")
    assert [r[0] for r in df.select(num.grade(F.col("s"))).collect()] == ["A", "A", "B", "B", "C", "F"]


def test_ratio_by_zero_is_null(spark):
    row = spark.range(1).select(num.ratio(F.lit(5), F.lit(0), 1, 2).alias("a"), num.ratio(F.lit(1), F.lit(3), 100_000, 1).alias("b")).first()
    assert row["a"] is None and row["b"] == 33333.3


def test_age_days_are_elapsed(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 12:00:00' AS a, timestamp_ntz'2024-01-09 11:59:59' AS b")
    assert df.select(num.age_days(F.col("a"), F.col("b"))).first()[0] == 7


def test_strip_handles_unicode_spaces(spark):
    assert values(spark, ["  A b ", "\tx\n"], txt.strip_lower) == ["a b", "x"]


def test_snake_names():
    assert txt.snake_names(["PatientID", "BMI", "state code", "a", "a", "A_2"]) == ["patient_i_d", "b_m_i", "state_code", "a", "a_2", "a_2_2"]


def test_table_names(spark):
    assert values(spark, ["Test Fixture.csv", "__x--y__"], txt.table_name) == ["test_fixture_csv", "x_y"]
    assert txt.table_name_of("Test Fixture.csv") == "test_fixture_csv"


def test_mart_slug(spark):
    df = spark.createDataFrame([("Diabetes vs Medicare spend", "DIA01"), ("", "DIA01_TOB04"), ("Untitled mart", "X1"), (None, "")], "t string, f string")
    assert [r[0] for r in df.select(txt.mart_slug(F.col("t"), F.col("f"))).collect()] == [
        "mart_diabetes_vs_medicare_spend", "mart_dia01_tob04", "mart_x1", "mart_custom"]
    assert joins.external_column("My Table", "avg cost ($)") == "ext_my_table_avg_cost"


@pytest.mark.parametrize("text,expected,kinds", [
    ("mail a.b@c.org now", "mail [REDACTED:email] now", {"email": 1}),
    ("call (555) 123-4567 or +1 555-123-4567", "call [REDACTED:phone] or [REDACTED:phone]", {"phone": 2}),
    ("ssn 123-45-6789", "ssn [REDACTED:ssn]", {"ssn": 1}),
    ("npi 1234567890", "npi [REDACTED:npi]", {"npi": 1}),
    ("longer 12345678901 stays", "longer 12345678901 stays", {}),
])
def test_scrub(spark, text, expected, kinds):
    df = spark.createDataFrame([(text,)], "t string")
    counts = txt.scrub_counts(F.col("t"))
    row = df.select(txt.scrub(F.col("t")).alias("clean"), *[c.alias(k) for k, c in counts.items()]).first()
    assert row["clean"] == expected
    assert {k: row[k] for k in counts if row[k]} == kinds
    again = df.select(txt.scrub(txt.scrub(F.col("t"))).alias("twice")).first()
    assert again["twice"] == expected


@pytest.mark.parametrize("raw,clean", [
    ("```sql\nSELECT 1;\n```", "SELECT 1"),
    ("```duckdb\nselect a\n from t\n```", "select a from t"),
    ("Sure! WITH x AS (SELECT 1) SELECT * FROM x; DROP TABLE x", "WITH x AS (SELECT 1) SELECT * FROM x"),
    ("no statement", "no statement"), ("", ""),
])
def test_clean_sql(spark, raw, clean):
    assert values(spark, [raw], txt.clean_sql) == [clean]


@pytest.mark.parametrize("sql,ok", [
    ("SELECT 1", True), ("with a as (select 1) select * from a", True), ("SELECT drop_count FROM t", True), ("", False), ("EXPLAIN SELECT 1", False),
    *[(f"SELECT 1 {w.lower()} x", False) for w in ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "ATTACH", "COPY", "PRAGMA", "INSTALL",
                                                  "LOAD", "EXPORT", "CALL")],
    ("SELECT 1; SELECT 2", False)])
def test_sql_rejection(spark, sql, ok):
    assert (values(spark, [sql], txt.sql_rejection) == [""]) is ok


def test_scope_caveat(spark):
    got = values(spark, ["rank states by spend", "do the same people have both conditions", "diabetes among women", None], txt.scope_caveat)
    assert got[0] is None and got[3] is None
    assert "individual records" in got[1] and "broken down by sex" in got[2]


def test_focus(spark):
    assert values(spark, ["cut cost", "patient outcomes", "public health program", "hello"], txt.focus) == ["payer", "clinical", "policy", "payer"]


def test_descriptions(spark):
    assert values(spark, ["patient_id", "order_date", "zzz"], txt.describe_column) == [
        "Unique identifier for the patient", "Date of the event or measurement", "No description available — review column contents"]


def test_check_helpers(spark):
    assert values(spark, ["null_rate_email", "overall_completeness", "extreme_outliers_x"], txt.check_column) == ["email", "—", "x"]
    assert values(spark, ["null_rate_a", "duplicate_rows", "no_negatives_a", "odd"], txt.check_dimension) == [
        "Missing values", "Duplicates", "Value ranges", "Other"]
    assert values(spark, ["overall_completeness", "uniqueness_a", "odd"], txt.check_severity) == [0, 6, 9]
    assert "median" in values(spark, ["null_rate_a"], txt.suggest_fix)[0]

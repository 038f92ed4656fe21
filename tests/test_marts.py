import pytest
from pyspark.sql import functions as F

from martwright.operators import facts, joins, keys, mart as marts, quality
from martwright.plans import mart_build
from martwright.rules import EXCLUDED_LOCATIONS
from tests.conftest import as_set

SPEND = "spend_per_capita"


@pytest.fixture(scope="module")
def inputs(spark):
    spine = joins.state_crosswalk(spark).select("state_abbr")
    codes = [r[0] for r in spine.collect()]
    population = spine.withColumn("population", F.lit(1_000_000).cast("long"))
    rows = [(s, y, m, 10.0 + i * 0.1 + (y - 2021), False) for i, s in enumerate(codes) for y in (2021, 2022, 2023) for m in ("DIA01", "NPW14", "TOB04")]
    rows = [(s, y, m, None if (s, y) == ("FL", 2023) and m == "DIA01" else (12.5 if (s, y) == ("FL", 2022) and m == "DIA01" else v), sup) for s, y, m, v, sup in rows]
    rows += [("US", 2023, "DIA01", 50.0, False), ("AL", 2023, "SPARSE", 1.0, False), ("AL", 2023, "DIA01", None, True)]
    observed = spark.createDataFrame(rows, "state_abbr string, yr int, question_id string, value double, is_suppressed boolean")
    paid = spark.createDataFrame([(s, f"n{s}", 1_000_000.0) for s in codes] + [("ZZ", "x", 5e9)], "state_abbr string, npi string, payment double")
    return marts.MartInputs(spine, "state_abbr", population, observed, paid, suppressed=F.col("is_suppressed"), excluded=EXCLUDED_LOCATIONS)


def test_mart_grain_fallback_and_ratios(inputs):
    built = mart_build.build(inputs, marts.MartSpec())
    rows = {r["state_abbr"]: r for r in built.table.collect()}
    assert len(rows) == 51 and not set(rows) & set(EXCLUDED_LOCATIONS)
    assert (rows["FL"]["diabetes_prevalence_pct"], rows["FL"]["diabetes_vintage"]) == (12.5, 2022)
    assert rows["AL"]["diabetes_vintage"] == 2023
    assert {(r[SPEND], r["providers_per_100k"], r["payment_year"]) for r in rows.values()} == {(1.0, 0.1, 2024)}
    assert built.metadata["low_coverage_measures"] == ""
    checks = {r["check"]: r["passed"] for r in built.checks().collect()}
    assert checks["mart_row_count"] and checks["mart_missing_measures_le5"]


def test_sparse_measures_are_flagged(inputs):
    built = mart_build.build(inputs, marts.MartSpec(measures=("DIA01", "SPARSE")))
    assert built.metadata["low_coverage_measures"] == "SPARSE:1"
    assert "sparse_prevalence_pct" in built.table.columns


def test_external_measure_joins_by_any_spelling(spark, inputs):
    names = joins.state_crosswalk(spark)
    onboarded = spark.createDataFrame([("alabama", 1.0), (" AL ", 3.0), ("Texas", 7.0), ("nowhere", 99.0)], "place string, score double")
    name = joins.external_column("my data", "score")
    extra = joins.external_measure(onboarded, "place", "score", "mean", names, "state_abbr", "state_abbr", "state_name", name=name)
    built = mart_build.build(inputs, marts.MartSpec(measures=("DIA01",)), [extra])
    assert as_set(built.table.filter(f"{name} is not null"), "state_abbr", name) == {("AL", 2.0), ("TX", 7.0)}
    assert built.table.count() == 51


def test_broken_grain_is_refused(spark):
    doubled = spark.createDataFrame([("AL",), ("AL",)], "k string")
    with pytest.raises(ValueError):
        marts.assert_grain(doubled, "k", 2)


@pytest.fixture(scope="module")
def simple(spark):
    return spark.createDataFrame([("AL", 15.0, 100.0), ("AR", 8.0, 200.0), ("AZ", 14.0, 90.0), ("WY", 7.0, 250.0), ("DC", None, 1.0)],
                                 f"k string, m double, {SPEND} double")


def test_report_facts(simple):
    assert as_set(facts.quadrant(simple, "m", SPEND), "k") == {("AL",), ("AZ",)}
    top = facts.top_bottom(simple, "m", SPEND, "k").filter("list = 'top_spend'").collect()
    assert [r["k"] for r in top] == ["WY", "AR", "AL"]
    assert facts.correlation(simple, "m", SPEND).first()["n"] == 4


def test_composite(spark):
    df = spark.createDataFrame([("a", 0.0, 5.0, 1.0), ("b", 10.0, 5.0, 2.0), ("c", 5.0, 5.0, 3.0), ("d", None, 5.0, 4.0)], f"k string, x double, y double, {SPEND} double")
    assert as_set(facts.composite(df, ["x", "y"], SPEND), "k", "burden_index") == {("a", 25.0), ("b", 75.0), ("c", 50.0)}
    assert facts.composite(df, ["x"], SPEND).isEmpty()
    assert facts.composite(df.limit(2), ["x", "y"], SPEND).isEmpty()
    assert facts.pairwise(df, ["x", "y"], SPEND).first()["r"] is None


def test_histogram_counts_every_point_once(spark):
    points = spark.range(101).select((F.col("id") / 10.0).alias("x"), F.col("id").alias("k"))
    bins = facts.histogram(points).orderBy("bin").collect()
    assert [b["members_count"] for b in bins] == [17, 17, 16, 17, 17, 17] and bins[5]["hi"] == 10.0
    same = facts.histogram(spark.range(5).select(F.lit(2.0).alias("x"), F.col("id").alias("k")), "k").orderBy("bin").collect()
    assert sum(b["members_count"] for b in same) == 5
    assert facts.histogram(points.limit(3)).isEmpty()


def test_latest_value_ties_and_years(spark):
    df = spark.createDataFrame([("a", 2023, 5.0), ("a", 2023, 4.0), ("a", 2030, 1.0), ("b", 2021, 9.0), ("c", 2010, 9.0)], "k string, y int, v double")
    assert as_set(marts.latest_value(df, ["k"], "y", "v", (2021, 2022, 2023)), "k", "value", "vintage") == {("a", 4.0, 2023), ("b", 9.0, 2021)}


def test_filters_keep_missing_codes(spark):
    df = spark.createDataFrame([("US",), (None,), ("AL",)], "c string")
    assert as_set(joins.drop_codes(df, "c", ("US",)), "c") == {(None,), ("AL",)}
    assert joins.where_equal(df, {"c": ""}).count() == 3 and joins.where_equal(df, {"c": "AL"}).count() == 1


def test_joinability(spark):
    names = joins.state_crosswalk(spark)
    spelled = joins.spellings(names, "state_abbr", "state_abbr", "state_name")
    health = names.select("state_name", F.lit(3.5).alias("depression_rate_pct"), F.lit(7).alias("record_id"))
    books = spark.createDataFrame([("A", "x", 3), ("B", "y", 4)], "title string, author string, units_sold int")
    sources = {"books": books, "health": health, "numbers": spark.range(5).toDF("n")}
    profiles = keys.source_profiles(sources, spelled)
    got = {r["table_name"]: r for r in profiles.collect()}
    assert got["health"]["relevant"] and got["health"]["key_column"] == "state_name" and got["health"]["n_keys"] == names.count()
    assert not got["books"]["joinable"] and got["books"]["key_column"] is None and got["numbers"]["n_rows"] == 5
    assert [r["table_name"] for r in keys.rank_profiles(profiles).collect()][0] == "health"
    assert [tuple(r) for r in keys.source_metrics(sources, profiles).collect()] == [("health", 0, "depression_rate_pct", "mean", "average depression rate pct per key")]


def test_key_candidates_trim_fold_and_skip_empty(spark):
    spelled = spark.createDataFrame([("al", 1), ("ak", 2)], "spelling string, k int")
    df = spark.createDataFrame([(" AL", None, "x" * 500), ("al ", None, "x" * 499 + "y"), ("zz", None, None)], "a string, gone string, long string")
    got = {(r["column"], r["values_n"], r["hits"]) for r in keys.key_candidates({"t": df, "none": spark.range(3).toDF("n")}, spelled).collect()}
    assert got == {("a", 2, 1), ("long", 2, 0)}
    assert keys.key_columns({"t": df}, spelled).count() == 0 and keys.key_candidates({"none": spark.range(3).toDF("n")}, spelled).count() == 0


def test_mart_checks_fail_where_they_should(spark):
    bad = spark.createDataFrame([("a", 0, 70.0, -1.0), ("b", None, None, 1.0)], "k string, population int, m double, s double")
    got = {r["check"]: r["passed"] for r in quality.mart_checks(bad, 3, "population", ["m"], "s", ["m", "s"], allowed_gaps=0).collect()}
    assert not any(got.values())


def test_spine_join_plan_has_no_cross_join_and_no_python(inputs):
    plan = marts.build(inputs, marts.MartSpec())._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


def test_facts_save(spark, inputs, tmp_path):
    built = mart_build.build(inputs, marts.MartSpec())
    out = built.facts()
    assert {"top_bottom", "composite", "histogram", "findings"} <= set(out)
    assert all(df.columns for df in out.values())
    built.save(str(tmp_path), "mart_saved")
    assert spark.table("mart_saved").count() == 51
    saved = spark.read.json(f"{tmp_path}/mart_saved_build_meta.json").first()["source_rows"]
    assert saved == ",".join(f"{name}:{getattr(inputs, name).count()}" for name in ("observations", "payments", "population"))


def test_spine_join_refuses_repeated_keys(spark):
    from martwright.operators import joins

    spine, measures = spark.range(3).toDF("k"), spark.createDataFrame([(1, 2.0), (1, 3.0)], "k long, v double")
    with pytest.raises(ValueError, match="key 1"):
        joins.spine_join(spine, measures, "k")
    assert joins.spine_join(spine, measures.limit(1), "k").count() == 3


def test_clashing_spellings_take_the_smallest_key(spark):
    from martwright.operators import joins

    dimension = spark.createDataFrame([(2, "North"), (1, " north ")], "k int, name string")
    assert {(r.spelling, r.k) for r in joins.spellings(dimension, "k", "name").collect()} == {("north", 1)}

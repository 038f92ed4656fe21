import numpy as np
import pytest

from martwright.operators import stats
from martwright.session import shared_folder


@pytest.mark.parametrize("kind", ["uniform", "ties", "heavy_edge", "wide", "constant"])
def test_quantiles_by_narrowing_equal_numpy(spark, kind):
    rng = np.random.default_rng(3)
    n = 4001
    data = {"uniform": rng.uniform(0, 1, n), "ties": rng.integers(0, 4, n).astype(float), "heavy_edge": np.where(rng.random(n) < 0.6, 1.0, rng.uniform(1, 2, n)),
            "wide": 10.0 ** rng.uniform(-200, 200, n), "constant": np.full(n, 7.0)}[kind]
    df = spark.createDataFrame([(float(x),) for x in data], "v double")
    probs = [0.0, 0.25, 0.5, 0.77, 1.0]
    for buckets in (2, 16, 4096):
        assert np.allclose(stats.quantiles(df, ["v"], probs, buckets=buckets)["v"], np.quantile(data, probs), rtol=1e-12, atol=0)


@pytest.mark.parametrize("n", [101, 50_000, 150_000])
def test_quantiles_with_infinities_are_the_same_at_every_size(spark, n):
    df = spark.range(n).selectExpr("CASE WHEN id = 0 THEN double('Infinity') WHEN id = 1 THEN double('-Infinity') WHEN id = 2 THEN double('NaN') ELSE CAST(id AS DOUBLE) END AS v",
                                   "double('Infinity') AS w")
    data = np.array([-np.inf, *range(3, n), np.inf])
    got = stats.quantiles(df, ["v", "w"], [0.0, 0.25, 0.5, 1.0])
    assert got == {"v": [-np.inf, float(np.quantile(data, 0.25)), float(np.quantile(data, 0.5)), np.inf], "w": [np.inf] * 4}


def test_decimals_keep_their_digits(spark):
    df = spark.sql("SELECT CAST(v AS DECIMAL(38,18)) AS d FROM VALUES ('1.000000000000000001'), ('1.000000000000000002'), ('1.000000000000000002') t(v)")
    assert stats.distinct_counts(df, ["d"]).first()["unique_count"] == 2


def test_row_digests_tell_nulls_and_maps_apart(spark):
    df = spark.sql("SELECT * FROM VALUES (NULL, 1, map('a', 1, 'b', 2)), (1, NULL, map('a', 1)), (1, NULL, map('a', 1)), (NULL, 1, map('b', 2, 'a', 1)) t(a, b, m)")
    assert tuple(stats.duplicate_count(df).first()) == (4, 2)


def test_quantiles_skip_missing_and_handle_empty(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    for limits in ({}, {"buckets": 4}):
        got = stats.quantiles(df, ["a", "b"], [0.5], **limits)
        assert got == {"a": [2.0], "b": [None]}


def test_distinct_counts_ignore_missing_nan_and_signed_zero(spark):
    df = spark.createDataFrame([(1, 0.0, "x"), (1, -0.0, None), (2, float("nan"), "x"), (None, 2.0, "")], "a long, b double, c string")
    got = {r["column"]: r["unique_count"] for r in stats.distinct_counts(stats.normalize_nan(df), ["a", "b", "c"]).collect()}
    assert got == {"a": 2, "b": 2, "c": 2}
    approx = {r["column"]: r["unique_count"] for r in stats.distinct_counts(stats.normalize_nan(df), ["a", "b", "c"], approx=True).collect()}
    assert approx == got


def test_duplicates_count_rows_beyond_the_first(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "a")], "a int, b string")
    assert tuple(stats.duplicate_count(df).first()) == (4, 2)


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], ["x`y", "it's a \\ name"])
    got = {r["column"]: r["unique_count"] for r in stats.distinct_counts(df, df.columns).collect()}
    assert got == {"x`y": 2, "it's a \\ name": 1}


def test_broadcast_only_when_small(spark, monkeypatch):
    df = spark.range(1000)
    assert "ResolvedHint" in stats.small_side(df)._jdf.queryExecution().analyzed().toString() or \
        "broadcast" in stats.small_side(df)._jdf.queryExecution().analyzed().toString().lower()
    monkeypatch.setattr(stats, "BROADCAST_BYTES", 10)
    assert "broadcast" not in stats.small_side(df)._jdf.queryExecution().analyzed().toString().lower()


def test_stages_go_to_the_folder_the_session_names(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_folder(spark) == named


def _long_texts(spark):
    same = "x" * stats.TEXT_HEAD
    rows = [(1, same + "a", "s"), (2, same + "b", None), (3, same + "b", "s"), (4, same, "t"), (5, None, ""), (6, same * 50, "t"), (7, same * 50, "s"), (8, same + "b", "s")]
    return spark.createDataFrame(rows, "id long, body string, word string"), same


def test_long_texts_are_counted_by_digest_and_shown_whole(spark):
    from martwright.operators import profile

    df, same = _long_texts(spark)
    assert {r["column"]: r["unique_count"] for r in stats.distinct_counts(df, df.columns).collect()} == {"id": 8, "body": 4, "word": 3}
    top = [(r["rank"], r["value"], r["occurrences"]) for r in profile.top_values(df, 4).filter("column = 'body'").orderBy("rank").collect()]
    assert top[:2] == [(1, same + "b", 3), (2, same * 50, 2)] and {v for _, v, _ in top[2:]} == {same, same + "a"}
    facts = {r["column"]: r for r in profile.value_facts(df).collect()}
    assert [(v["value"], v["n"]) for v in facts["body"]["top"]] == [(v, n) for _, v, n in top]
    assert facts["body"]["samples"][0]["value"] == same and facts["body"]["filled_count"] == 7
    assert [v["value"] for v in facts["word"]["samples"]] == ["", "s", "t"] and [v["value"] for v in facts["id"]["samples"]] == ["1", "2", "3"]


def test_nested_and_binary_values_are_shown_whole(spark):
    from martwright.operators import profile

    df = spark.sql("SELECT sequence(1, 60) AS many, unhex(repeat('ab', 80)) AS bytes, CAST(NULL AS STRING) AS nothing")
    facts = {r["column"]: r["top"][0]["value"] for r in profile.value_facts(df).collect()}
    assert facts == {"many": "[" + ",".join(map(str, range(1, 61))) + "]", "bytes": "AB" * 80}


def test_no_text_is_shuffled_to_profile_strings(spark):
    from martwright.operators import profile

    df, _ = _long_texts(spark)
    plan = profile.strings(df)._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert keys and not any("body#" in line or "word#" in line or "txt#" in line for line in keys)

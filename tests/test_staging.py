import os
import re
import time

from pyspark.sql import functions as F

from martwright.llm import components as components_module
from martwright.llm.components import components
from martwright.session import SHUFFLES_GO_KEY, drop_staged, stage, stage_folder, stage_scope


def staged_tables(spark):
    return set(os.listdir(re.sub("^file:(//)?", "", stage_folder(spark))))


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def test_shuffle_files_of_a_staged_table_go_with_its_query(spark):
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLES_GO_KEY, None)
    table = stage(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "counted")
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 100 and spark.conf.get(SHUFFLES_GO_KEY, None) == setting


def test_rounds_of_components_leave_one_table(spark):
    before = staged_tables(spark)
    found = components(spark.range(40).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    assert {(r.u, r.root) for r in found.collect()} == {(k, 0) for k in range(1, 41)}
    assert [name.rsplit("-", 1)[0] for name in staged_tables(spark) - before] == ["small_star"]


def test_few_edges_take_no_rounds(spark, monkeypatch):
    labels, staged = [], components_module.stage
    monkeypatch.setattr(components_module, "stage", lambda df, label: labels.append(label) or staged(df, label))
    edges = spark.createDataFrame([(k, k + 1) for k in range(-3, 30)] + [(50, 40), (50, 60), (7, 7), (None, 3), (1, 2)], "u long, v long")
    expected = {(k, -3) for k in range(-2, 31)} | {(50, 40), (60, 40)}
    assert {(r.u, r.root) for r in components(edges).collect()} == expected
    assert labels == ["edges", "small_star"]
    monkeypatch.setattr(components_module, "CLOSED_AT_ONCE", 10)
    assert {(r.u, r.root) for r in components(edges).collect()} == expected
    assert "large_star" in labels


def test_kept_tables_go_with_the_scope_around(spark):
    before, outside = staged_tables(spark), spark.range(3)
    with stage_scope(spark) as outer:
        with stage_scope(spark) as keep:
            stage(spark.range(1), "gone")
            kept = keep(stage(spark.range(2), "kept"))
            assert keep(outside) is outside
        assert kept.count() == 2 and len(staged_tables(spark) - before) == 1
        last = outer(stage(spark.range(4), "last"))
    assert last.count() == 4 and len(staged_tables(spark) - before) == 1
    drop_staged(outside)
    drop_staged(last)
    assert staged_tables(spark) == before

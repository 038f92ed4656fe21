"""Stored tables switch as a whole, keep what readers opened, and lose no commit."""

import pytest
from pyspark.sql import functions as F

from martwright.sources import tables, versions
from tests.conftest import as_set

SCHEMA = "table_name string, score int"


def _entries(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_registry_is_stored_and_read_back(spark, tmp_path):
    home = str(tmp_path / "registry")
    assert versions.read(spark, home) is None and versions.numbers(spark, home) == []
    assert versions.upsert(_entries(spark, ("a", 1), ("b", 1)), home) == 1
    before = versions.read(spark, home)
    assert versions.upsert(_entries(spark, ("b", 2), ("c", 2)), home) == 2
    assert as_set(versions.read(spark, home), "table_name", "score") == {("a", 1), ("b", 2), ("c", 2)}
    # A reader keeps the version it opened.
    assert as_set(before, "table_name", "score") == {("a", 1), ("b", 1)}
    versions.upsert(_entries(spark).limit(0), home)
    assert as_set(versions.read(spark, home, 2), "table_name") == as_set(versions.read(spark, home), "table_name") == {("a",), ("b",), ("c",)}


def test_old_versions_go(spark, tmp_path):
    home = str(tmp_path / "t")
    for i in range(versions.KEPT + 2):
        versions.commit(_entries(spark, ("a", i)), home)
    assert versions.numbers(spark, home) == [3, 4, 5]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("rows-")]) == versions.KEPT


def test_a_commit_that_fails_leaves_the_table(spark, tmp_path, monkeypatch):
    home = str(tmp_path / "t")
    versions.commit(_entries(spark, ("a", 1)), home)
    broken = _entries(spark, ("a", 2)).withColumn("score", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        versions.commit(broken, home)

    def fail(*_):
        raise OSError("store is gone")

    with monkeypatch.context() as patch:
        patch.setattr(versions, "_switch", fail)
        with pytest.raises(OSError, match="gone"):
            versions.commit(_entries(spark, ("a", 3)), home)
    assert versions.numbers(spark, home) == [1] and as_set(versions.read(spark, home), "score") == {(1,)}
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("rows-")]) == 1


def test_two_commits_after_the_same_version(spark, tmp_path):
    home = str(tmp_path / "t")
    versions.commit(_entries(spark, ("a", 1)), home)
    versions.commit(_entries(spark, ("b", 2)), home, after=1)
    with pytest.raises(versions.Conflict):
        versions.commit(_entries(spark, ("c", 3)), home, after=1)
    # An upsert that lost the race merges with the winner.
    raced = []

    def merge(old, new, key):
        if not raced:
            raced.append(versions.commit(versions.history.upsert_registry(old, _entries(spark, ("d", 4)), key), home))
        return versions.history.upsert_registry(old, new, key)

    assert versions.upsert(_entries(spark, ("e", 5)), home, merge=merge) == 4
    assert as_set(versions.read(spark, home), "table_name") == {("b",), ("d",), ("e",)}


def test_table_of_the_same_columns_is_never_absent(spark, tmp_path, monkeypatch):
    tables.load_table(spark.range(3), "switched_t", str(tmp_path))
    asked = []
    plain = type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **kw: (asked.append(text), plain(self, text, *a, **kw))[1])
    opened = spark.table("switched_t")
    assert tables.load_table(spark.range(7), "switched_t", str(tmp_path)) == 7
    monkeypatch.undo()
    assert not [t for t in asked if t.startswith("DROP")]
    assert spark.table("switched_t").count() == 7 and opened.count() == 3
    assert tables.load_table(spark.range(2).selectExpr("id", "'x' AS extra"), "switched_t", str(tmp_path)) == 2
    assert spark.table("switched_t").columns == ["id", "extra"] and spark.table("switched_t").count() == 2
    plain(spark, "DROP TABLE switched_t")

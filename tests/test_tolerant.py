"""Broken rows and unreadable files are reported; what can be read is whole."""

import pytest

from martwright.sources import tolerant
from tests.conftest import as_set


def test_broken_rows_of_delimited_text_are_set_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,x\n1,ann,2.5\nbad,bob,1\n3,cy\n4,dee,7,extra\n5,,\n\n")
    (tmp_path / "b.csv").write_text("id,name,x\n6,eve,0\n")
    got = tolerant.read_delimited(spark, str(tmp_path), "id int, name string, x double")
    assert as_set(got.rows, "id", "name", "x") == {(1, "ann", 2.5), (5, None, None), (6, "eve", 0.0)}
    assert as_set(got.quarantined, "record") == {("bad,bob,1",), ("3,cy",), ("4,dee,7,extra",)}
    assert {r["file"].rsplit("/", 1)[1] for r in got.quarantined.collect()} == {"a.csv"}
    assert (got.n_rows, got.n_broken) == (3, 3) and got.failures.isEmpty()
    # Fewer columns asked for, the same rows.
    assert as_set(got.rows, "name") == {("ann",), (None,), ("eve",)} and got.rows.count() == 3


def test_broken_lines_of_json_are_set_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "_broken": "mine"}\n{"id": "x"}\n{"id": 2\nnonsense\n{"other": 3}\n')
    got = tolerant.read_json_lines(spark, str(tmp_path), "id int, _broken string")
    assert as_set(got.rows, "id", "_broken") == {(1, "mine"), (None, None)}
    assert as_set(got.quarantined, "record") == {('{"id": "x"}',), ('{"id": 2',), ("nonsense",)}
    assert (got.n_rows, got.n_broken) == (2, 3)


def test_nothing_broken_and_nothing_there(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id\n")
    got = tolerant.read_delimited(spark, str(tmp_path), "id int")
    assert got.rows.isEmpty() and got.quarantined.isEmpty() and (got.n_rows, got.n_broken) == (0, 0)


@pytest.fixture
def parts(spark, tmp_path):
    folder = tmp_path / "t"
    spark.range(0, 20_000, numPartitions=2).selectExpr("id", "sha2(cast(id as string), 256) AS text", "map('k', id) AS m").write.parquet(str(folder))
    spark.range(0).selectExpr("id", "'' AS text", "map('k', id) AS m").write.mode("append").parquet(str(folder))
    return folder, sorted(folder.glob("part-*.parquet"), key=lambda p: -p.stat().st_size)


def test_parquet_without_footer_fails_as_a_file(spark, parts):
    folder, found = parts
    whole = found[0].read_bytes()
    (folder / "part-cut.parquet").write_bytes(whole[: len(whole) // 2])
    (folder / "part-none.parquet").write_bytes(b"")
    got = tolerant.read_parquet(spark, str(folder))
    assert {r["file"].rsplit("/", 1)[1]: r["reason"] for r in got.failures.collect()} == dict.fromkeys(("part-cut.parquet",), "no readable footer")
    assert got.n_rows == got.rows.count() == 20_000 and got.rows.columns == ["id", "text", "m"]


def test_parquet_with_damaged_pages_fails_as_a_file(spark, parts):
    folder, found = parts
    damaged = bytearray(found[0].read_bytes())
    damaged[100 : len(damaged) // 2] = bytes(len(damaged) // 2 - 100)
    (folder / f".{found[0].name}.crc").unlink(missing_ok=True)
    found[0].write_bytes(bytes(damaged))
    got = tolerant.read_parquet(spark, str(folder))
    (failed,) = got.failures.collect()
    assert failed["file"].endswith(found[0].name) and failed["reason"].endswith("10000 rows can be read")
    assert got.n_rows == got.rows.count() == 10_000


def test_parquet_of_which_no_file_can_be_read(spark, tmp_path):
    (tmp_path / "x.parquet").write_bytes(b"not parquet")
    got = tolerant.read_parquet(spark, str(tmp_path))
    assert got.failures.count() == 1 and got.n_rows == 0 and got.rows.isEmpty()

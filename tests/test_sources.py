import json

import pytest
from pyspark.sql import functions as F

from martwright.sources import files, jdbc, landed, tables
from tests.conftest import as_set


@pytest.mark.parametrize("suffix,sep", [("csv", ","), ("csv", ";"), ("tsv", "\t"), ("csv", "|")])
def test_separator_is_found(spark, tmp_path, suffix, sep):
    path = tmp_path / f"data.{suffix}"
    path.write_text(f"id{sep}name\n1{sep}a b\n2{sep}c\n")
    extract = files.load(spark, str(path))
    assert extract.error is None and extract.df.columns == ["id", "name"]
    assert as_set(extract.counted(), "id", "name") == {(1, "a b"), (2, "c")}
    assert extract.name == "data" and extract.record_count == 2


def test_record_count_before_any_job(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text("a\n1\n")
    extract = files.load(spark, str(path))
    assert extract.metadata()["last_record_count"] == -1
    extract.counted()
    assert extract.record_count == -1


def test_latin_1_fallback(spark, tmp_path):
    path = tmp_path / "latin.csv"
    path.write_bytes("id,city\n1,Orléans\n".encode("latin-1"))
    assert files.load(spark, str(path)).df.first()["city"] == "Orléans"
    path.write_text("id,city\n1,Orléans\n", encoding="utf-8")
    assert files.load(spark, str(path)).df.first()["city"] == "Orléans"


@pytest.mark.parametrize("text", [
    '[{"id": 1, "n": "a"}, {"id": 2, "n": "b"}]', '[\n {"id": 1, "n": "a"},\n {"id": 2, "n": "b"}\n]',
    '{"id": 1, "n": "a"}\n{"id": 2, "n": "b"}\n', '{"id": [1, 2], "n": ["a", "b"]}', '{\n"id": [1, 2],\n"n": ["a", "b"]\n}'])
def test_json_shapes(spark, tmp_path, text):
    path = tmp_path / "data.json"
    path.write_text(text)
    assert as_set(files.load(spark, str(path)).df, "id", "n") == {(1, "a"), (2, "b")}


def test_parquet_and_failures(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    assert files.load(spark, path).df.count() == 3
    for bad in (str(tmp_path / "missing.csv"), str(tmp_path / "book.xlsx")):
        extract = files.load(spark, bad)
        assert extract.error and extract.df.isEmpty() and extract.record_count == -1
    broken = tmp_path / "broken.parquet"
    broken.write_text("not parquet")
    assert files.load(spark, str(broken)).error


def test_uris():
    assert files.parse_uri("S3://bucket/a/b.csv") == {"scheme": "s3", "bucket": "bucket", "key": "a/b.csv"}
    assert files.hadoop_path("s3://b/k.csv") == "s3a://b/k.csv"
    assert files.hadoop_path("az://c/k.csv", account="acct") == "abfss://c@acct.dfs.core.windows.net/k.csv"
    for bad in ("ftp://a/b", "s3://bucket", "s3:///key", "plain.csv"):
        with pytest.raises(ValueError):
            files.parse_uri(bad)


@pytest.mark.parametrize("engine,url", [
    ("sqlserver", "jdbc:sqlserver://h:1433;databaseName=d"), ("postgres", "jdbc:postgresql://h:5432/d"), ("redshift", "jdbc:postgresql://h:5439/d"),
    ("mysql", "jdbc:mysql://h:3306/d"), ("oracle", "jdbc:oracle:thin:@//h:1521/d"), ("sqlite", "jdbc:sqlite:d")])
def test_jdbc_options(engine, url):
    options = jdbc.jdbc_options(engine, "h", database="d", user="u", password="p@ss")
    assert options["url"] == url and "p@ss" not in options["url"]
    assert "p@ss" not in str(jdbc.metadata(options))


def test_jdbc_limits_are_in_the_engines_words():
    assert "TOP (5)" in jdbc.limited("sqlserver", "t", 5)
    assert "FETCH FIRST 5 ROWS ONLY" in jdbc.limited("oracle", "t", 5)
    assert jdbc.limited("postgres", "t", 5).startswith("(SELECT * FROM t LIMIT 5)")
    with pytest.raises(ValueError):
        jdbc.jdbc_options("unknown")


def strings(spark, rows):
    names = list(rows[0])
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} string" for n in names))


def test_provider_rows(spark):
    base = {"Rndrng_NPI": "0123456789", "Rndrng_Prvdr_State_Abrvtn": "TX", "Rndrng_Prvdr_State_FIPS": "08", "Rndrng_Prvdr_Cntry": "US", "Tot_Benes": "12",
            "Tot_Mdcr_Pymt_Amt": ""}
    df = landed.providers(strings(spark, [base, {**base, "Rndrng_Prvdr_Cntry": "ZZ"}, {**base, "Rndrng_Prvdr_State_Abrvtn": "PR"}]))
    row = df.collect()
    assert len(row) == 1
    assert row[0].asDict() == {"npi": "0123456789", "state": "TX", "state_fips": "08", "country": "US", "total_beneficiaries": 12.0, "total_medicare_payment": None}


def test_measure_rows(spark):
    base = {"yearstart": "2023", "locationabbr": "FL", "questionid": "DIA01", "datavaluetypeid": "CRDPREV", "datavalue": "11.5", "stratificationcategory1": "Overall",
            "datavaluefootnotesymbol": None}
    rows = [base, {**base, "locationabbr": "US"}, {**base, "datavalue": "", "datavaluefootnotesymbol": "*"}, {**base, "stratificationcategory1": "Sex"},
            {**base, "questionid": "X"}, {**base, "datavalue": ""}]
    df = landed.measures(strings(spark, rows), question_id="DIA01")
    assert sorted((r["datavalue"] is None, r["is_suppressed"]) for r in df.collect()) == [(False, False), (True, False), (True, True)]


def test_survey_rows(spark):
    base = {"year": "2023", "locationabbr": "FL", "topic": "BMI Categories", "response": "Obese (BMI 30.0 - 99.8)", "break_out": "Overall", "data_value": "30"}
    rows = [base, {**base, "locationabbr": "US"}, {**base, "locationabbr": "UW"}, {**base, "response": "Yes"}, {**base, "break_out": "Male"}]
    assert [r["data_value"] for r in landed.survey_preset(strings(spark, rows), "obesity").collect()] == [30.0]


def test_county_rows(spark):
    base = {"year": "2023", "stateabbr": "AR", "locationname": "Drew", "locationid": "05043", "measureid": "DIABETES", "datavaluetypeid": "CrdPrv", "data_value": "14.1",
            "totalpop18plus": "13000"}
    df = landed.counties(strings(spark, [base, {**base, "locationid": "05045", "data_value": ""}, {**base, "stateabbr": "US"}]))
    assert as_set(df, "locationid", "data_value", "totalpop18plus") == {("05043", 14.1, 13000), ("05045", None, 13000)}


def test_population_pages(spark):
    page = [["NAME", "B01003_001E", "state"], ["Alabama", "5000000", "01"], ["Texas", "30000000", "48"], ["Puerto Rico", "3000000", "72"]]
    df = landed.population(spark.createDataFrame([(page,)], "rows array<array<string>>"))
    assert as_set(df, "state_name", "population", "state_fips", "state_abbr") == {("Alabama", 5000000, "01", "AL"), ("Texas", 30000000, "48", "TX")}


def test_indicator_pages(spark, tmp_path):
    path = tmp_path / "page.json"
    path.write_text(json.dumps({"value": [{"SpatialDim": "IND", "TimeDim": 2020, "NumericValue": 70.5}, {"SpatialDim": "USA", "TimeDim": 2020, "NumericValue": 78.0}]}))
    pages = spark.read.json(str(path))
    assert as_set(landed.indicators(pages, "life_expectancy", ["IND"]), "country_code", "year", "value", "indicator_name") == {("IND", 2020, 70.5, "life_expectancy")}
    assert landed.indicators(pages, "XYZ").first()["indicator_name"] == "XYZ"


def test_nested_events(spark):
    event = {"safetyreportid": "1", "receivedate": "20240101", "serious": "1", "patient": {"patientonsetage": "45", "patientsex": "2", "drug": [
        {"medicinalproduct": "ASPIRIN", "openfda": {"brand_name": ["Bayer", "Ecotrin"]}}, {"medicinalproduct": "other"}],
        "reaction": [{"reactionmeddrapt": "Headache"}, {}, {"reactionmeddrapt": "Nausea"}]}}
    df = spark.createDataFrame([(json.dumps(event),), (json.dumps({"safetyreportid": "2"}),)], "j string")
    one, two = landed.flat_events(df, "j").orderBy("safety_report_id").collect()
    assert (one["drug_name"], one["brand_name"], one["reactions"], one["generic_name"]) == ("ASPIRIN", "Bayer; Ecotrin", "Headache; ; Nausea", "")
    assert set(two.asDict().values()) == {"2", ""}


def test_catalog_falls_back_to_defaults(spark):
    raw = strings(spark, [{"questionid": "A", "question": "q", "topic": "t", "datavaluetypeid": "RATE"}])
    assert [r["questionid"] for r in landed.measure_catalog(raw).collect()] == ["DIA01", "NPW14", "TOB04"]


def test_cache(spark, tmp_path):
    calls = []

    def pull(rows):
        def run():
            calls.append(1)
            return spark.range(rows)
        return run

    folder = str(tmp_path)
    assert tables.cached_pull(spark, folder, "a", pull(0)).count() == 0
    assert tables.cached_pull(spark, folder, "a", pull(3)).count() == 3  # an empty cache is no hit
    assert tables.cached_pull(spark, folder, "a", pull(9)).count() == 3 and len(calls) == 2
    assert tables.cached_pull(spark, folder, "a", pull(9), refresh=True).count() == 9


def test_load_replaces_and_counts(spark, tmp_path):
    assert tables.load_table(spark.range(5), "loaded_t", str(tmp_path)) == 5
    assert tables.load_table(spark.range(2), "loaded_t", str(tmp_path)) == 2
    assert spark.table("loaded_t").count() == 2
    assert "loaded_t" in {r[0] for r in tables.list_tables(spark).collect()}
    assert tables.describe_table(spark, "loaded_t").first()["col_name"] == "id"
    history = spark.createDataFrame([("loaded_t",), ("other",)], "table_name string")
    kept = tables.drop_dataset(spark, "loaded_t", history, str(tmp_path / "history"))
    assert [r[0] for r in kept.collect()] == ["other"] and not spark.catalog.tableExists("loaded_t")


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'say "hi", ok'), (2, "two\nlines"), (3, None), (4, "plain")]
    path = str(tmp_path / "out.csv")
    tables.export_csv(spark.createDataFrame(rows, "id int, t string"), path)
    back = files.read_delimited(spark, path, schema="id int, t string", multi_line=True, sep=",", encoding="UTF-8")
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == rows


def test_call_log_is_newest_first_and_skips_bad_lines(spark, tmp_path):
    folder = str(tmp_path / "log")
    assert tables.read_calls(spark, folder).isEmpty()
    for hour in (1, 3, 2):
        call = spark.sql(f"SELECT timestamp'2024-01-01 0{hour}:00:00.123456' AS ts, 'chat' AS task, 'ollama' AS provider, 10L AS prompt_chars")
        tables.append_calls(call, folder)
    (tmp_path / "log" / "bad.json").write_text("{not json\n")
    got = tables.read_calls(spark, folder, limit=2).collect()
    assert [r["ts"].hour for r in got] == [3, 2] and got[0]["ts"].microsecond == 123456


def test_artifact_and_metadata(spark, tmp_path):
    tables.write_artifact(spark.range(3), str(tmp_path), "m", {"measures": "A,B", "sample_mode": False})
    assert spark.read.parquet(str(tmp_path / "m.parquet")).count() == 3
    assert spark.read.json(str(tmp_path / "m_build_meta.json")).first()["measures"] == "A,B"


def test_footer_counts(spark, tmp_path):
    path = str(tmp_path / "n.parquet")
    spark.range(7).write.parquet(path)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    assert [tuple(r) for r in tables.footer_counts(spark, {"n": path}).collect()] == [("n", 7)]
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before


def test_row_cap_has_an_order(spark):
    assert [r["id"] for r in landed.row_cap(spark.range(10), 3, F.desc("id")).collect()] == [9, 8, 7]

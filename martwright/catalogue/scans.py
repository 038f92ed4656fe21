"""Queries over sources, sinks and the catalogue."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.catalogue.base import SCHEMA, TABLES, Bench, query
from martwright.functions import text as txt
from martwright.operators import clean, joins
from martwright.plans import console, onboard
from martwright.session import stage, stage_path
from martwright.sources import files, landed, tables, tolerant


def _schema_sql() -> str:
    """Column listing of the benchmark tables for the oracle."""
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST(i AS INT) AS ordinal, n AS column_name, d AS data_type FROM (VALUES {v}) x(i, n, d)"
        for t, v in _SCHEMA_VALUES.items())


_SCHEMA_VALUES = {t: ", ".join(f"({i}, '{c.split()[0]}', '{c.split()[1]}')" for i, c in enumerate(cols)) for t, cols in SCHEMA.items()}


def counts_sql(names=TABLES) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in names)


@query("scan_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv(t: Bench) -> DataFrame:
    path = stage_path(t.spark, "customer") + ".csv"
    t.customer.write.option("header", True).option("sep", ";").csv(path)
    df = files.load(t.spark, path).df
    return df.select(F.col("c_custkey").cast("long"), "c_name", F.col("c_nationkey").cast("int"), "c_acctbal", "c_mktsegment")


@query("scan_json", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_json(t: Bench) -> DataFrame:
    path = stage_path(t.spark, "nation") + ".json"
    t.nation.write.json(path)
    df = files.load(t.spark, path).df
    return df.select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))


@query("scan_parquet", """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem
WHERE l_shipdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY l_returnflag""")
def scan_parquet(t: Bench) -> DataFrame:
    df = files.load(t.spark, t.path("lineitem")).df
    return (df.filter(F.col("l_shipdate") < F.lit(datetime(1998, 1, 1)).cast("timestamp_ntz")).groupBy("l_returnflag")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")))


_URI = r"'^(http|https)://([^/]+)/(.+)$'"


@query("uri_parse", f"""SELECT page_id, CASE WHEN m THEN lower(regexp_extract(url, {_URI}, 1, 'i')) END AS scheme,
CASE WHEN m THEN regexp_extract(url, {_URI}, 2, 'i') END AS bucket, CASE WHEN m THEN regexp_extract(url, {_URI}, 3, 'i') END AS key
FROM (SELECT *, regexp_matches(url, {_URI}, 'i') AS m FROM pages)""")
def uri_parse(t: Bench) -> DataFrame:
    return t.pages.select("page_id", *files.uri_parts(F.col("url"), "http|https"))


@query("norm_provider", """SELECT Rndrng_NPI AS npi, Rndrng_Prvdr_Last_Org_Name AS provider_last_name, CAST(NULL AS VARCHAR) AS provider_first_name,
CAST(NULL AS VARCHAR) AS provider_middle_initial, Rndrng_Prvdr_Crdntls AS credentials, CAST(NULL AS VARCHAR) AS gender,
Rndrng_Prvdr_Type AS provider_specialty, Rndrng_Prvdr_State_Abrvtn AS state, Rndrng_Prvdr_State_FIPS AS state_fips,
Rndrng_Prvdr_Zip5 AS zip_code, Rndrng_Prvdr_Cntry AS country, CAST(Tot_Benes AS DOUBLE) AS total_beneficiaries,
CAST(Tot_Srvcs AS DOUBLE) AS total_services, TRY_CAST(Tot_Mdcr_Pymt_Amt AS DOUBLE) AS total_medicare_payment,
CAST(Tot_Mdcr_Stdzd_Amt AS DOUBLE) AS total_medicare_payment_std
FROM raw_providers WHERE Rndrng_Prvdr_Cntry = 'US' AND Rndrng_Prvdr_State_Abrvtn <> 'ZZ'""")
def norm_provider(t: Bench) -> DataFrame:
    return landed.providers(t.raw_providers)


@query("norm_measure", """SELECT yearstart, locationabbr, questionid, datavaluetypeid, TRY_CAST(datavalue AS DOUBLE) AS datavalue,
stratificationcategory1, datavaluefootnotesymbol, TRY_CAST(datavalue AS DOUBLE) IS NULL AND coalesce(datavaluefootnotesymbol, '') = '*' AS is_suppressed
FROM raw_measures WHERE datavaluetypeid = 'CRDPREV' AND stratificationcategory1 = 'Overall' AND locationabbr <> 'US'""")
def norm_measure(t: Bench) -> DataFrame:
    return landed.measures(t.raw_measures)


@query("norm_survey", """SELECT year, locationabbr, topic, response, break_out, TRY_CAST(data_value AS DOUBLE) AS data_value, event_id
FROM raw_survey WHERE year = '2024' AND topic = 'view' AND response = 'Yes' AND break_out = 'Overall' AND locationabbr NOT IN ('US', 'UW')""")
def norm_survey(t: Bench) -> DataFrame:
    return landed.survey(t.raw_survey, topic="view", year="2024", response="Yes")


@query("norm_county", """SELECT stateabbr, locationname, locationid, measureid, datavaluetypeid, TRY_CAST(data_value AS DOUBLE) AS data_value,
CAST(totalpop18plus AS BIGINT) AS totalpop18plus FROM raw_counties WHERE stateabbr <> 'US' AND datavaluetypeid = 'CrdPrv'""")
def norm_county(t: Bench) -> DataFrame:
    return landed.counties(t.raw_counties)


_FIPS = "lpad(CAST(n_nationkey * 3 AS STRING), 2, '0')"


@query("norm_population", """WITH fips(code, abbr) AS (VALUES ('01','AL'),('02','AK'),('04','AZ'),('05','AR'),('06','CA'),('08','CO'),('09','CT'),
('10','DE'),('11','DC'),('12','FL'),('13','GA'),('15','HI'),('16','ID'),('17','IL'),('18','IN'),('19','IA'),('20','KS'),('21','KY'),('22','LA'),
('23','ME'),('24','MD'),('25','MA'),('26','MI'),('27','MN'),('28','MS'),('29','MO'),('30','MT'),('31','NE'),('32','NV'),('33','NH'),('34','NJ'),
('35','NM'),('36','NY'),('37','NC'),('38','ND'),('39','OH'),('40','OK'),('41','OR'),('42','PA'),('44','RI'),('45','SC'),('46','SD'),('47','TN'),
('48','TX'),('49','UT'),('50','VT'),('51','VA'),('53','WA'),('54','WV'),('55','WI'),('56','WY'))
SELECT n.n_name AS state_name, CAST(n.n_nationkey * 1000 + r.r_regionkey AS BIGINT) AS population, f.code AS state_fips, f.abbr AS state_abbr
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey JOIN fips f ON f.code = lpad(CAST(n.n_nationkey * 3 AS VARCHAR), 2, '0')""")
def norm_population(t: Bench) -> DataFrame:
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    record = F.array("n_name", (F.col("n_nationkey") * 1000 + F.col("r_regionkey")).cast("string"), F.expr(_FIPS))
    header = F.array(F.lit("NAME"), F.lit("B01003_001E"), F.lit("state"))
    path = stage_path(t.spark, "population-pages")
    rows.select(F.to_json(F.array(header, record)).alias("value")).write.text(path)
    pages = t.spark.read.text(path).select(F.from_json("value", "array<array<string>>").alias("rows"))
    return landed.population(pages)


@query("norm_indicator", """SELECT event_type AS country_code, CAST(2000 + user_id % 20 AS INT) AS year, value, 'BTSX' AS dimension_1, 'SEX' AS dimension_1_type,
'life_expectancy' AS indicator_name FROM events WHERE event_type IN ('view', 'click')""")
def norm_indicator(t: Bench) -> DataFrame:
    record = F.struct(F.col("event_type").alias("SpatialDim"), (F.col("user_id") % 20 + 2000).cast("int").alias("TimeDim"),
                      F.col("value").alias("NumericValue"), F.lit("BTSX").alias("Dim1"), F.lit("SEX").alias("Dim1Type"))
    path = stage_path(t.spark, "indicator-pages")
    t.events.select(F.array(record).alias("value")).write.json(path)
    schema = "value array<struct<SpatialDim: string, TimeDim: int, NumericValue: double, Dim1: string, Dim1Type: string>>"
    return landed.indicators(t.spark.read.schema(schema).json(path), "WHOSIS_000001", ["view", "click"])


@query("flatten_nested", """SELECT CAST(o_orderkey AS VARCHAR) AS safety_report_id, strftime(o_orderdate, '%Y%m%d') AS receive_date,
CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '' END AS serious, '' AS sender_organization, CAST(o_custkey % 90 AS VARCHAR) AS patient_age,
CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '1' END AS patient_sex, '' AS patient_weight,
CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE o_orderpriority END AS drug_name, '' AS drug_indication,
CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat(o_orderpriority, '; ', o_orderstatus) END AS brand_name, '' AS generic_name,
concat(o_orderstatus, '; ', CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END) AS reactions FROM orders""")
def flatten_nested(t: Bench) -> DataFrame:
    key = F.col("o_orderkey")
    drug = F.struct(F.col("o_orderpriority").alias("medicinalproduct"),
                    F.struct(F.array("o_orderpriority", "o_orderstatus").alias("brand_name")).alias("openfda"))
    second = F.struct(F.lit("other").alias("medicinalproduct"), F.struct(F.array(F.lit("x")).alias("brand_name")).alias("openfda"))
    reaction = F.array(F.struct(F.col("o_orderstatus").alias("reactionmeddrapt")),
                       F.struct(F.when(key % 4 != 0, F.col("o_orderpriority")).alias("reactionmeddrapt")))
    patient = F.struct((F.col("o_custkey") % 90).cast("string").alias("patientonsetage"),
                       F.when(key % 3 != 0, "1").alias("patientsex"),
                       F.when(key % 10 != 0, F.array(drug, second)).alias("drug"), reaction.alias("reaction"))
    event = F.struct(key.cast("string").alias("safetyreportid"), F.date_format("o_orderdate", "yyyyMMdd").alias("receivedate"),
                     F.when(F.col("o_orderstatus") == "F", "1").alias("serious"), patient.alias("patient"))
    return landed.flat_events(t.orders.select(F.to_json(event).alias("json")), "json")


@query("measure_catalog", """SELECT DISTINCT p_brand AS questionid, concat(p_brand, ' ', p_type) AS question, p_type AS topic FROM part WHERE p_type <> 'PROMO'""")
def measure_catalog(t: Bench) -> DataFrame:
    raw = t.part.select(F.col("p_brand").alias("questionid"), F.concat_ws(" ", "p_brand", "p_type").alias("question"),
                        F.col("p_type").alias("topic"), F.when(F.col("p_type") == "PROMO", "AGEADJPREV").otherwise("CRDPREV").alias("datavaluetypeid"))
    return landed.measure_catalog(raw)


@query("row_cap", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000")
def row_cap(t: Bench) -> DataFrame:
    return landed.row_cap(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), 1000, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("load_table", """SELECT n_nationkey, n_name, n_regionkey, (SELECT count(*) FROM nation) AS rows_loaded FROM nation""")
def load_table(t: Bench) -> DataFrame:
    rows = tables.load_table(t.nation, "martwright_nation_load")
    return t.spark.table("martwright_nation_load").withColumn("rows_loaded", F.lit(rows).cast("long"))


@query("read_outcomes", """SELECT 'nation' AS name, FALSE AS failed, count(*) AS n_rows FROM nation
UNION ALL SELECT 'absent', TRUE, 0 UNION ALL SELECT 'notes', TRUE, 0""")
def read_outcomes(t: Bench) -> DataFrame:
    """A file that is there, one that isn't, and one of an unknown kind."""
    extracts = [files.load(t.spark, path) for path in (t.path("nation"), t.path("absent"), f"{t.folder}/notes.docx")]
    parts = [e.df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(e.name).alias("name"), F.lit(e.error is not None).alias("failed"), "n_rows") for e in extracts]
    return parts[0].union(parts[1]).union(parts[2])


@query("read_tolerant", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'broken row' ELSE 'row' END AS kind,
CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS custkey FROM orders
UNION ALL SELECT n_nationkey, 'row beside a cut file', n_regionkey FROM nation
UNION ALL SELECT n, 'counted', b FROM (SELECT count(*) FILTER (WHERE o_orderkey % 13 <> 0)::INT AS n, count(*) FILTER (WHERE o_orderkey % 13 = 0)::INT AS b FROM orders)
UNION ALL SELECT 1, 'unreadable file', NULL""")
def read_tolerant(t: Bench) -> DataFrame:
    """Orders as text, each thirteenth with a date for a customer, and nations beside a file that is cut off."""
    text, cut = stage_path(t.spark, "orders-text"), stage_path(t.spark, "nations")
    customer = F.when(F.col("o_orderkey") % 13 == 0, F.col("o_orderdate").cast("date").cast("string")).otherwise(F.col("o_custkey").cast("string"))
    t.orders.select(F.col("o_orderkey").alias("k"), customer.alias("custkey")).write.option("header", True).csv(text)
    t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("custkey")).write.parquet(cut)
    path = t.spark._jvm.org.apache.hadoop.fs.Path(f"{cut}/part-cut.parquet")
    out = path.getFileSystem(t.spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(b"PAR1 and no more"))
    out.close()
    orders, nations = tolerant.read_delimited(t.spark, text, "k long, custkey long"), tolerant.read_parquet(t.spark, cut)
    number, none = F.split("record", ",")[0].cast("long").alias("k"), F.lit(None).cast("long").alias("custkey")
    counted = t.spark.range(1).select(F.lit(orders.n_rows).cast("long").alias("k"), F.lit("counted").alias("kind"), F.lit(orders.n_broken).cast("long").alias("custkey"))
    return (orders.rows.select("k", F.lit("row").alias("kind"), "custkey").union(orders.quarantined.select(number, F.lit("broken row").alias("kind"), none))
            .union(nations.rows.select("k", F.lit("row beside a cut file").alias("kind"), "custkey")).union(counted)
            .union(nations.failures.groupBy().agg(F.count(F.lit(1)).cast("long").alias("k")).select("k", F.lit("unreadable file").alias("kind"), none)))


@query("cached_pull", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def cached_pull(t: Bench) -> DataFrame:
    """The second pull finds the first one's rows and asks nothing."""
    folder = stage_path(t.spark, "cache")
    tables.cached_pull(t.spark, folder, "orders", lambda: t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")))
    return tables.cached_pull(t.spark, folder, "orders", lambda: t.orders.select("o_orderpriority", F.lit(-1).cast("long").alias("n")))


@query("table_artifact", """SELECT n_nationkey, n_name, 'N' AS built_from, CAST((SELECT count(*) FROM nation) AS VARCHAR) AS rows_built FROM nation""")
def table_artifact(t: Bench) -> DataFrame:
    """A table and its build metadata, both written and read back."""
    folder = stage_path(t.spark, "artifact")
    tables.write_artifact(t.nation, folder, "nations", {"built_from": "N", "rows_built": t.nation.count()})
    meta = t.spark.read.schema("built_from string, rows_built string").json(f"{folder}/nations_build_meta.json").first()
    return t.spark.read.parquet(f"{folder}/nations.parquet").select("n_nationkey", "n_name", F.lit(meta["built_from"]).alias("built_from"), F.lit(meta["rows_built"]).alias("rows_built"))


@query("drop_dataset", """SELECT run_id, table_name, FALSE AS still_there FROM runs WHERE table_name <> 't_3'""")
def drop_dataset(t: Bench) -> DataFrame:
    """A dropped table's runs leave the history, all others stay."""
    tables.load_table(t.nation, "t_3", stage_path(t.spark, "dropped"))
    kept = tables.drop_dataset(t.spark, "t_3", t.runs, stage_path(t.spark, "kept-runs"))
    return kept.select("run_id", "table_name", F.lit(t.spark.catalog.tableExists("t_3")).alias("still_there"))


@query("extract_bookkeeping", "SELECT 'orders' AS name, 'file' AS source_type, count(*) AS last_record_count, TRUE AS has_time FROM orders")
def extract_bookkeeping(t: Bench) -> DataFrame:
    """The row count of an extract comes from the job that consumed it."""
    extract = files.load(t.spark, t.path("orders"))
    consumed = stage(extract.counted().select("o_orderkey"), "consumed")
    seen = extract.metadata()
    return consumed.agg(F.first(F.lit(seen["name"])).alias("name"), F.first(F.lit(seen["source_type"])).alias("source_type"),
                        F.first(F.lit(seen["last_record_count"]).cast("long")).alias("last_record_count"), F.first(F.lit(bool(seen["last_extract_time"]))).alias("has_time"))


@query("batch_onboarding", """SELECT 'nation' AS dataset, count(*) AS rows_in, count(*) AS rows_out, FALSE AS failed FROM nation
UNION ALL SELECT 'customer', count(*), count(*), FALSE FROM customer UNION ALL SELECT 'absent', NULL, NULL, TRUE""")
def batch_onboarding(t: Bench) -> DataFrame:
    done = onboard.onboard_files(t.spark, [t.path("nation"), t.path("customer"), t.path("absent")], load=False)
    return done.select("dataset", "rows_in", "rows_out", F.col("error").isNotNull().alias("failed"))


@query("export_csv", "SELECT page_id, url, html FROM pages")
def export_csv(t: Bench) -> DataFrame:
    path = stage_path(t.spark, "pages") + ".csv"
    tables.export_csv(t.pages, path)
    return files.read_delimited(t.spark, path, schema="page_id long, url string, html string", multi_line=True, sep=",", encoding="UTF-8",
                                lineSep="\n")


@query("audit_recent", """SELECT event_id, ts, task, provider, prompt_chars, redaction_count FROM audit ORDER BY ts DESC, event_id DESC LIMIT 100""")
def audit_recent(t: Bench) -> DataFrame:
    path = stage_path(t.spark, "audit-log")
    tables.append_calls(t.audit.select("event_id", "ts", "task", "provider", "prompt_chars", "redaction_count"), path)
    return tables.read_calls(t.spark, path, 100, tie="event_id",
                             schema="event_id long, ts timestamp_ntz, task string, provider string, prompt_chars long, redaction_count long")


@query("schema_listing", f"SELECT s.*, c.n_rows FROM ({_schema_sql()}) s JOIN ({counts_sql()}) c ON s.table_name = c.table_name")
def schema_listing(t: Bench) -> DataFrame:
    listed = {n: t.table(n) for n in TABLES}
    return tables.schema_of(listed).join(tables.row_counts(listed), "table_name")


@query("schema_described", f"""WITH s AS ({_schema_sql()}), c AS ({counts_sql()}), d(ord, pat, txt) AS (VALUES
(14,'year','Year the measurement was taken'),(15,'value','Measured numeric value for the indicator'),(18,'id','Unique record identifier'),
(19,'age','Age in years'),(20,'date','Date of the event or measurement'),(21,'name','Name field'),(22,'code','Categorical code or identifier'),
(23,'type','Category or classification type'),(24,'source','Data source or origin'),(25,'status','Current status of the record'),
(26,'count','Count or frequency of occurrences'),(27,'rate','Rate per unit (e.g., per 1000 population)'))
SELECT s.table_name, s.ordinal, s.column_name, s.data_type, c.n_rows, coalesce((SELECT arg_min(txt, ord) FROM d WHERE contains(s.column_name, d.pat)),
'No description available — review column contents') AS description FROM s JOIN c ON s.table_name = c.table_name""")
def schema_described(t: Bench) -> DataFrame:
    listed = {n: t.table(n) for n in TABLES}
    return tables.described_schema(tables.schema_of(listed), tables.row_counts(listed))


@query("column_descriptions", f"""WITH s AS (SELECT a.*, c.n_rows FROM ({_schema_sql()}) a JOIN ({counts_sql()}) c ON a.table_name = c.table_name)
SELECT column_name, data_type, n_rows, CASE
WHEN contains(column_name, '_id') OR contains(column_name, 'id_') OR contains(column_name, ' id') OR suffix(column_name, 'id') THEN 'Unique identifier field'
WHEN regexp_matches(column_name, 'date|time|day|month|year|dob') THEN 'Date or time field'
WHEN regexp_matches(column_name, 'first|last|full_name|fname|lname') THEN 'Person name field'
WHEN contains(column_name, 'name') THEN 'Name or label field' WHEN regexp_matches(column_name, 'email|mail') THEN 'Email address field'
WHEN regexp_matches(column_name, 'phone|tel|mobile') THEN 'Phone number field'
WHEN regexp_matches(column_name, 'addr|address|street|city|zip|postal') THEN 'Geographic address field'
WHEN contains(column_name, 'state') THEN 'US state abbreviation'
WHEN regexp_matches(column_name, 'amount|cost|price|fee|usd|total|revenue') THEN 'Monetary amount or cost field'
WHEN regexp_matches(column_name, 'count|qty|quantity|num_') THEN 'Count or quantity field'
WHEN regexp_matches(column_name, 'rate|pct|percent|ratio|score') THEN 'Rate, percentage, or score field'
WHEN regexp_matches(column_name, 'code|type|category|status|flag') THEN 'Categorical code or classification'
WHEN regexp_matches(column_name, 'diagnosis|condition|disease') THEN 'Medical diagnosis or condition'
WHEN contains(column_name, 'age') THEN 'Age in years' WHEN prefix(column_name, '_') THEN 'Pipeline metadata column'
WHEN data_type IN ('INTEGER', 'FLOAT') THEN 'Numeric measurement field'
ELSE 'Data field — review column contents for context' END AS description FROM s""")
def column_descriptions(t: Bench) -> DataFrame:
    listed = {n: t.table(n) for n in TABLES}
    schema = tables.schema_of(listed).join(tables.row_counts(listed), "table_name")
    return schema.select("column_name", "data_type", "n_rows", txt.describe_field_kind(F.col("column_name"), F.col("data_type")).alias("description"))


@query("footer_counts", counts_sql())
def footer_counts(t: Bench) -> DataFrame:
    return tables.footer_counts(t.spark, {n: t.path(n) for n in TABLES})


@query("table_catalog", f"""WITH c AS ({counts_sql()} UNION ALL SELECT 'mart_demo', count(*) FROM nation UNION ALL SELECT 'pipeline_runs', count(*) FROM orders)
SELECT table_name, table_name AS label, CASE WHEN prefix(table_name, 'mart_') THEN 'mart' ELSE 'source' END AS kind, n_rows FROM c
WHERE table_name <> 'pipeline_runs'""")
def table_catalog(t: Bench) -> DataFrame:
    listed = {n: t.table(n) for n in TABLES} | {"mart_demo": t.nation, "pipeline_runs": t.orders}
    return tables.table_catalog(tables.row_counts(listed))


@query("volume_funnel", f"""WITH c AS ({counts_sql()}) SELECT table_name, n_rows, CAST((SELECT sum(n_rows) FROM c) AS BIGINT) AS total_rows,
(SELECT count(*) FROM c WHERE n_rows > 0) AS non_empty_sources FROM c""")
def volume_funnel(t: Bench) -> DataFrame:
    return tables.volume_funnel(tables.row_counts({n: t.table(n) for n in TABLES}))


@query("filter_codes", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AND c_nationkey NOT IN (0, 7, 24)")
def filter_codes(t: Bench) -> DataFrame:
    kept = joins.keep_codes(t.customer, "c_mktsegment", ("BUILDING", "MACHINERY", "HOUSEHOLD"))
    return joins.drop_codes(kept, "c_nationkey", (0, 7, 24)).select("c_custkey", "c_mktsegment")


@query("filter_optional", "SELECT event_id, event_type, user_id, value FROM events WHERE event_type = 'purchase'")
def filter_optional(t: Bench) -> DataFrame:
    return joins.where_equal(t.events, {"event_type": "purchase", "user_id": None, "props": ""}).select("event_id", "event_type", "user_id", "value")


@query("add_metadata", "SELECT n_nationkey, n_name, n_regionkey, 'nations' AS _source FROM nation")
def add_metadata(t: Bench) -> DataFrame:
    return clean.add_metadata(t.nation, "nations").drop("_loaded_at")


_CONSOLE_SQL = """Here you go:
```sql
SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY o_orderpriority;
```"""


@query("sql_readonly", """SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY o_orderpriority""")
def sql_readonly(t: Bench) -> DataFrame:
    return console.run_readonly(t.spark, _CONSOLE_SQL, {"orders": t.orders, "customer": t.customer}).rows


"""Registry, benchmark tables and the derived views both engines share.

Every view covers its whole base table; expressions on ids only plant defects (nulls,
odd text, repeats) that the clean base tables lack.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.operators.mart import MartInputs, MartSpec
from martwright.session import pin_utc

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")
# Columns and logical types of the benchmark tables, for the oracles.
SCHEMA = {
    "region": ("r_regionkey INTEGER", "r_name VARCHAR"),
    "nation": ("n_nationkey INTEGER", "n_name VARCHAR", "n_regionkey INTEGER"),
    "customer": ("c_custkey INTEGER", "c_name VARCHAR", "c_nationkey INTEGER", "c_acctbal FLOAT", "c_mktsegment VARCHAR"),
    "supplier": ("s_suppkey INTEGER", "s_name VARCHAR", "s_nationkey INTEGER", "s_acctbal FLOAT"),
    "part": ("p_partkey INTEGER", "p_name VARCHAR", "p_brand VARCHAR", "p_type VARCHAR", "p_size INTEGER", "p_retailprice FLOAT"),
    "orders": ("o_orderkey INTEGER", "o_custkey INTEGER", "o_orderstatus VARCHAR", "o_totalprice FLOAT", "o_orderdate TIMESTAMP",
               "o_orderpriority VARCHAR"),
    "lineitem": ("l_orderkey INTEGER", "l_partkey INTEGER", "l_suppkey INTEGER", "l_linenumber INTEGER", "l_quantity FLOAT",
                 "l_extendedprice FLOAT", "l_discount FLOAT", "l_tax FLOAT", "l_returnflag VARCHAR", "l_linestatus VARCHAR",
                 "l_shipdate TIMESTAMP"),
    "events": ("event_id INTEGER", "ts TIMESTAMP", "user_id INTEGER", "event_type VARCHAR", "value FLOAT", "props VARCHAR"),
    "documents": ("doc_id INTEGER", "text VARCHAR", "lang VARCHAR", "source VARCHAR", "n_chars INTEGER"),
    "embeddings": ("vec_id INTEGER", "embedding VARCHAR", "label INTEGER"),
    "pages": ("page_id INTEGER", "url VARCHAR", "html VARCHAR"),
    "benchmark": ("item_id INTEGER", "text VARCHAR"),
    "labels": ("doc_id INTEGER", "quality INTEGER", "toxic INTEGER"),
    "conversations": ("conv_id INTEGER", "turn INTEGER", "role VARCHAR", "text VARCHAR"),
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MEASURES = ("M1", "M2", "M3", "M4", "M5")
YEARS = (1998, 1997, 1996)
MEASURE_COLUMNS = [f"{m.lower()}_prevalence_pct" for m in MEASURES]
SPEND = "spend_per_capita"


def _state(key: str) -> str:
    """Two-letter code of one of 25 nations."""
    return f"substr('ALAKAZARCACOCTDEFLGAHIIDILINIAKSKYLAMEMDMAMIMNMSMO', CAST({key} AS INT) * 2 + 1, 2)"


_DIRTY = """SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS total_price,
  CASE WHEN o_orderkey % 97 = 0 THEN -1.0E6 ELSE CAST(o_orderkey % 50 AS DOUBLE) END AS line_count,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat(' ', o_orderpriority, ' ') END AS priority,
  CASE WHEN o_orderkey % 5 = 0 THEN 'N/A' ELSE CAST(o_orderkey % 1000 AS STRING) END AS qty_text,
  CASE WHEN o_orderkey % 9 = 0 THEN 'bad' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS order_date,
  'v1' AS batch
FROM {orders}"""

VIEWS = {
    "population": "SELECT c_nationkey AS loc, count(*) AS population FROM {customer} GROUP BY c_nationkey",
    "provider_rows": """SELECT CASE WHEN l.l_orderkey % 50 = 0 OR s.s_nationkey = 24 THEN 99 ELSE s.s_nationkey END AS loc,
  l.l_suppkey AS npi, CASE WHEN l.l_linenumber = 7 THEN '' ELSE CAST(l.l_extendedprice AS STRING) END AS payment_text
FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey""",
    "measure_long": """SELECT c.c_nationkey AS loc, CAST(year(o.o_orderdate) AS INT) AS yr,
  concat('M', substr(o.o_orderpriority, 1, 1)) AS question_id,
  CASE WHEN (c.c_nationkey + year(o.o_orderdate)) % 5 = 0 THEN NULL ELSE round(avg(o.o_totalprice) / 5000, 2) END AS value,
  CASE WHEN (c.c_nationkey + year(o.o_orderdate)) % 5 = 0 AND c.c_nationkey % 2 = 0 THEN '*' ELSE '' END AS footnote
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
GROUP BY c.c_nationkey, year(o.o_orderdate), substr(o.o_orderpriority, 1, 1)""",
    "measure_sparse": """SELECT loc, yr, question_id, CASE WHEN question_id = 'M5' AND loc >= 10 THEN NULL ELSE value END AS value
FROM {measure_long}""",
    "dirty_orders": f"{_DIRTY}\nUNION ALL\n{_DIRTY} WHERE o_orderkey % 20 = 0",
    "runs": """SELECT concat('run_', CAST(o_orderkey AS STRING)) AS run_id, concat('ds_', CAST(o_custkey % 7 AS STRING)) AS dataset_name,
  o_orderdate AS started_at, o_orderkey % 1000 AS rows_in,
  CASE WHEN o_orderkey % 30 = 0 THEN 0.0E0 ELSE round(50.0E0 + o_orderkey % 51, 2) END AS score,
  o_orderkey % 13 = 0 AS gate_blocked,
  CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('t_', CAST(o_custkey % 7 AS STRING)) END AS table_name
FROM {orders}""",
    "audit": """SELECT event_id, ts, event_type AS task,
  CASE event_type WHEN 'view' THEN 'ollama' WHEN 'click' THEN 'gemini' WHEN 'error' THEN 'none' WHEN 'signup' THEN 'local' ELSE 'Gemini' END AS provider,
  event_id % 400 AS prompt_chars, event_id % 3 AS redaction_count, user_id
FROM {events}""",
    "statements": """SELECT conv_id, turn, CASE turn % 6
  WHEN 0 THEN concat('```sql\nSELECT ', CAST(conv_id AS STRING), ';\n```') WHEN 1 THEN 'SELECT drop_count FROM t' WHEN 2 THEN 'DELETE FROM t'
  WHEN 3 THEN 'WITH a AS (SELECT 1) SELECT * FROM a; DROP TABLE a' WHEN 4 THEN 'SELECT * FROM t WHERE CALL = 1' ELSE text END AS raw
FROM {conversations}""",
    "requests": """SELECT c.conv_id, c.turn, concat(c.text, CASE c.turn % 5 WHEN 0 THEN ' Show diabetes spend by brand.'
  WHEN 1 THEN ' Compare obese adults in the care program, by age.' WHEN 2 THEN concat(' Rank ', coalesce(p.p_name, 'none'), ' prices for females.')
  WHEN 3 THEN ' Do the same people also have both conditions?' ELSE '' END) AS request
FROM {conversations} c LEFT JOIN {part} p ON c.conv_id = p.p_partkey""",
    "catalog_rows": """SELECT CASE p_name WHEN 'small ring' THEN 'DIA01' WHEN 'red widget' THEN 'NPW14' ELSE upper(replace(p_name, ' ', '_')) END AS question_id,
  p_name AS question, min(p_type) AS topic, CAST(min(p_partkey) AS BIGINT) AS ordinal
FROM {part} GROUP BY p_name""",
    "picked": """SELECT l.l_orderkey AS request_id, l.l_linenumber AS ordinal, concat(' ', lower(p.p_type), ' ') AS measure
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "keyed_customers": """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat('nation_', CAST(c_nationkey AS STRING))
  WHEN 1 THEN concat(' NATION_', CAST(c_nationkey AS STRING), ' ') ELSE CAST(c_nationkey AS STRING) END AS raw_key,
  c_acctbal AS charge, c_mktsegment AS segment
FROM {customer}""",
    "raw_providers": f"""SELECT CAST(l.l_suppkey AS STRING) AS Rndrng_NPI, s.s_name AS Rndrng_Prvdr_Last_Org_Name, '' AS Rndrng_Prvdr_First_Name,
  '' AS Rndrng_Prvdr_MI, l.l_returnflag AS Rndrng_Prvdr_Crdntls, '' AS Rndrng_Prvdr_Gndr, l.l_linestatus AS Rndrng_Prvdr_Type,
  CASE WHEN s.s_nationkey = 24 THEN 'ZZ' ELSE {_state('s.s_nationkey')} END AS Rndrng_Prvdr_State_Abrvtn,
  lpad(CAST(s.s_nationkey AS STRING), 2, '0') AS Rndrng_Prvdr_State_FIPS, lpad(CAST(l.l_suppkey AS STRING), 5, '0') AS Rndrng_Prvdr_Zip5,
  CASE WHEN l.l_orderkey % 50 = 0 THEN 'ZZ' ELSE 'US' END AS Rndrng_Prvdr_Cntry, CAST(CAST(l.l_quantity AS INT) AS STRING) AS Tot_Benes,
  CAST(l.l_linenumber AS STRING) AS Tot_Srvcs, CASE WHEN l.l_linenumber = 7 THEN '' ELSE CAST(l.l_extendedprice AS STRING) END AS Tot_Mdcr_Pymt_Amt,
  CAST(l.l_tax AS STRING) AS Tot_Mdcr_Stdzd_Amt
FROM {{lineitem}} l JOIN {{supplier}} s ON l.l_suppkey = s.s_suppkey""",
    "raw_measures": f"""SELECT CAST(yr AS STRING) AS yearstart, CASE WHEN loc = 24 THEN 'US' ELSE {_state('loc')} END AS locationabbr,
  question_id AS questionid, CASE WHEN yr = 1995 THEN 'AGEADJPREV' ELSE 'CRDPREV' END AS datavaluetypeid,
  coalesce(CAST(value AS STRING), '') AS datavalue, CASE WHEN yr = 1996 THEN 'Sex' ELSE 'Overall' END AS stratificationcategory1,
  CASE WHEN footnote = '' THEN NULL ELSE footnote END AS datavaluefootnotesymbol
FROM {{measure_long}}""",
    "raw_survey": f"""SELECT CAST(year(ts) AS STRING) AS year,
  CASE user_id % 27 WHEN 25 THEN 'US' WHEN 26 THEN 'UW' ELSE {_state('user_id % 27')} END AS locationabbr, event_type AS topic,
  CASE WHEN event_id % 4 = 0 THEN 'No' ELSE 'Yes' END AS response, CASE WHEN event_id % 5 = 0 THEN 'Male' ELSE 'Overall' END AS break_out,
  CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(value AS STRING) END AS data_value, event_id
FROM {{events}}""",
    "raw_counties": f"""SELECT CASE WHEN c_nationkey = 24 THEN 'US' ELSE {_state('c_nationkey')} END AS stateabbr, c_name AS locationname,
  lpad(CAST(c_custkey AS STRING), 9, '0') AS locationid, c_mktsegment AS measureid,
  CASE WHEN c_custkey % 6 = 0 THEN 'AgeAdjPrv' ELSE 'CrdPrv' END AS datavaluetypeid,
  CASE WHEN c_custkey % 8 = 0 THEN '' ELSE CAST(c_acctbal AS STRING) END AS data_value, CAST(c_custkey * 10 AS STRING) AS totalpop18plus
FROM {{customer}}""",
    "drift_after": """SELECT order_id, total_price, line_count, priority,
  CASE WHEN qty_text = 'N/A' THEN NULL ELSE CAST(qty_text AS DOUBLE) END AS qty_text,
  CASE WHEN order_date = 'bad' THEN NULL ELSE CAST(order_date AS DATE) END AS order_date, length(priority) AS priority_length
FROM {dirty_orders}""",
    "registry_old": """SELECT table_name, max(started_at) AS built_at, min(score) AS score FROM {runs}
WHERE table_name <> '' AND started_at < TIMESTAMP '1998-01-01 00:00:00' GROUP BY table_name""",
    "registry_new": """SELECT table_name, max(started_at) AS built_at, max(score) AS score FROM {runs}
WHERE table_name IN ('t_1', 't_3', 't_5') GROUP BY table_name""",
}


def _inputs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


class Bench:
    """Tables and views of one benchmark folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}.parquet"

    @functools.cache  # noqa: B019  (a Bench lives for one query)
    def table(self, name: str) -> DataFrame:
        if name in VIEWS:
            text = VIEWS[name]
            return self.spark.sql(text, **{n: self.table(n) for n in _inputs(text)})
        return self.spark.read.parquet(self.path(name))

    __getattr__ = table

    def mart_inputs(self, sparse: bool = False) -> MartInputs:
        from martwright.functions import numeric as num

        paid = self.provider_rows.select("loc", "npi", num.safe_numeric(num.blank_to_null(F.col("payment_text"))).alias("payment"))
        return MartInputs(spine=self.nation.select(F.col("n_nationkey").alias("loc")), key="loc", population=self.population,
                          observations=self.measure_sparse if sparse else self.measure_long, payments=paid, excluded=(99,))

    def mart_spec(self) -> MartSpec:
        return MartSpec(measures=MEASURES, years=YEARS, payment_year=1998)


def with_views(sql: str) -> str:
    """Oracle text with the views it names as common table expressions, in dependency order."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in ordered:
            return
        for inner in _inputs(VIEWS[name]):
            if inner in VIEWS:
                need(inner)
        ordered.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            need(name)
    parts = [f"{n} AS ({VIEWS[n].format(**{i: i for i in _inputs(VIEWS[n])})})" for n in ordered]
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join([*parts, body[5:]])}" if parts else body
    return f"WITH {', '.join(parts)} {body}" if parts else body


def query(name: str, oracle: str | None = None):
    """Register a query under a key, with the SQL that must return the same rows."""
    def register(fn: Callable[[Bench], DataFrame]) -> Callable[[Bench], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            pin_utc(spark)
            return fn(Bench(spark, folder))

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn
    return register

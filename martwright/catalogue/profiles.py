"""Queries over cleaning, profiling, quality checks and documentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.catalogue.base import Bench, query
from martwright.catalogue.columns import parsed
from martwright.functions import numeric as num
from martwright.operators import clean, docs, keys, profile, quality, stats
from martwright.plans import onboard as onboarding
from martwright.session import stage

DIRTY = ("order_id", "total_price", "line_count", "priority", "qty_text", "order_date", "batch")
_DIRTY_NUMBERS = ("order_id", "total_price", "line_count")
_DIRTY_TEXTS = ("priority", "qty_text", "order_date", "batch")

# The cleaned form of dirty_orders, step by step, for the oracle.
_TYPED = f"""d1 AS (SELECT DISTINCT * FROM dirty_orders),
typed AS (SELECT order_id, total_price, line_count, priority, {parsed('qty_text')} AS qty_text,
TRY_CAST(order_date AS TIMESTAMP) AS order_date, batch FROM d1)"""
_FILLED = f"""{_TYPED}, med AS (SELECT quantile_cont(total_price, 0.5) AS tp, quantile_cont(qty_text, 0.5) AS qt FROM typed),
filled AS (SELECT order_id, coalesce(total_price, tp) AS total_price, line_count, coalesce(priority, 'Unknown') AS priority,
coalesce(qty_text, qt) AS qty_text, order_date, batch FROM typed, med)"""
_CLEANED = f"""{_FILLED}, cleaned AS (SELECT order_id, total_price, line_count, lower(trim(priority)) AS priority, qty_text, order_date, lower(batch) AS batch,
'orders' AS _source FROM filled)"""


def _distinct(c: str, source: str) -> str:
    return f"(SELECT count(DISTINCT {c}) FROM {source})"


# --- cleaning ----------------------------------------------------------------------------------------


@query("duplicate_rows", """SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM
(SELECT count(*) AS n FROM dirty_orders GROUP BY ALL)""".replace("count(*) AS n FROM dirty_orders GROUP BY ALL", f"count(*) AS n FROM dirty_orders GROUP BY {', '.join(DIRTY)}"))
def duplicate_rows(t: Bench) -> DataFrame:
    return stats.duplicate_count(t.dirty_orders)


@query("dedupe_rows", "SELECT DISTINCT * FROM dirty_orders")
def dedupe_rows(t: Bench) -> DataFrame:
    return clean.remove_duplicates(t.dirty_orders)


@query("auto_types", f"""SELECT order_id, total_price, line_count, priority, {parsed('qty_text')} AS qty_text, TRY_CAST(order_date AS TIMESTAMP) AS order_date, batch
FROM dirty_orders""")
def auto_types(t: Bench) -> DataFrame:
    return clean.convert_types(t.dirty_orders).df


@query("fill_nulls", """WITH med AS (SELECT quantile_cont(total_price, 0.5) AS tp FROM dirty_orders)
SELECT order_id, coalesce(total_price, tp) AS total_price, line_count, coalesce(priority, 'Unknown') AS priority, qty_text, order_date, batch FROM dirty_orders, med""")
def fill_nulls(t: Bench) -> DataFrame:
    return clean.handle_nulls(t.dirty_orders).df


@query("clean_text", """SELECT order_id, total_price, line_count, lower(trim(priority)) AS priority, trim(qty_text) AS qty_text, trim(order_date) AS order_date, lower(trim(batch)) AS batch
FROM dirty_orders""")
def clean_text(t: Bench) -> DataFrame:
    return clean.clean_text_columns(t.dirty_orders).df


@query("transform_all", f"WITH {_CLEANED} SELECT * FROM cleaned")
def transform_all(t: Bench) -> DataFrame:
    return clean.transform(t.dirty_orders, "orders").df.drop("_loaded_at")


@query("transform_log", f"""WITH {_TYPED}, n AS (SELECT (SELECT count(*) FROM dirty_orders) AS b, (SELECT count(*) FROM d1) AS a,
(SELECT count(*) FROM d1 WHERE qty_text = 'N/A') + (SELECT count(*) FROM d1 WHERE order_date = 'bad') AS lost)
SELECT 1 AS step, 'standardize_columns' AS action, 'Renamed 0/7 columns to snake_case' AS detail
UNION ALL SELECT 2, 'remove_duplicates', concat('Removed ', b - a, ' duplicate rows (before=', b, ', after=', a, ')') FROM n
UNION ALL SELECT 3, 'convert_types', concat('Converted 1 columns to numeric, 1 to datetime; ', lost, ' unreadable cells became null') FROM n
UNION ALL SELECT 4, 'handle_nulls', 'Applied null-fill strategy to 3 columns'
UNION ALL SELECT 5, 'clean_text_columns', 'Stripped whitespace on 2 text columns, lowercased 2 of them'
UNION ALL SELECT 6, 'add_metadata_columns', 'Added _loaded_at and _source=''orders'''""")
def transform_log(t: Bench) -> DataFrame:
    return clean.transform_log(t.spark, clean.transform(t.dirty_orders, "orders").counts, "orders").drop("timestamp")


# --- profiling ----------------------------------------------------------------------------------------


_GROUPS = f"SELECT {', '.join(DIRTY)}, count(*) AS n FROM dirty_orders GROUP BY {', '.join(DIRTY)}"
_OVERVIEW = f"""SELECT CAST(sum(n) AS BIGINT) AS row_count, 7 AS column_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
round(sum(n - 1) * 100.0 / sum(n), 2) AS duplicate_pct,
round((SELECT ({' + '.join(f'count({c})' for c in DIRTY)}) * 100.0 / (count(*) * 7) FROM dirty_orders), 2) AS completeness FROM ({_GROUPS})"""


@query("profile_overview", _OVERVIEW)
def profile_overview(t: Bench) -> DataFrame:
    return profile.overview(t.dirty_orders)


def _columns_sql(source: str, columns: tuple[tuple[str, str], ...]) -> str:
    return " UNION ALL ".join(
        f"""SELECT {i} AS ordinal, '{c}' AS "column", '{kind}' AS dtype, count(*) AS row_count, count(*) - count({c}) AS null_count,
round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct, count(DISTINCT {c}) AS unique_count FROM {source}"""
        for i, (c, kind) in enumerate(columns))


_ORDERS = (("o_orderkey", "INTEGER"), ("o_custkey", "INTEGER"), ("o_orderstatus", "VARCHAR"), ("o_totalprice", "FLOAT"),
           ("o_orderdate", "TIMESTAMP"), ("o_orderpriority", "VARCHAR"))
_CUSTOMER = (("c_custkey", "INTEGER"), ("c_name", "VARCHAR"), ("c_nationkey", "INTEGER"), ("c_acctbal", "FLOAT"), ("c_mktsegment", "VARCHAR"))
_DIRTY_TYPES = (("order_id", "INTEGER"), ("total_price", "FLOAT"), ("line_count", "FLOAT"), ("priority", "VARCHAR"), ("qty_text", "VARCHAR"),
                ("order_date", "VARCHAR"), ("batch", "VARCHAR"))


@query("profile_columns", f"{_columns_sql('orders', _ORDERS)} UNION ALL {_columns_sql('customer', _CUSTOMER)} UNION ALL {_columns_sql('dirty_orders', _DIRTY_TYPES)}")
def profile_columns(t: Bench) -> DataFrame:
    return profile.columns(t.orders).unionByName(profile.columns(t.customer)).unionByName(profile.columns(t.dirty_orders))


_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
_PART = ("p_partkey", "p_size", "p_retailprice")


def _numeric_sql(source: str, names: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"""SELECT {i} AS ordinal, '{c}' AS "column", round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS median, round(stddev_samp(v), 4) AS std,
min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.25), 4) AS q1, round(quantile_cont(v, 0.75), 4) AS q3,
round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 4) AS iqr,
(SELECT count(*) FROM {source}, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {source}) WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outlier_count,
round(skewness(v), 4) AS skewness FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {source})""" for i, c in enumerate(names))


@query("profile_numeric", f"{_numeric_sql('lineitem', _LINE)} UNION ALL {_numeric_sql('part', _PART)}")
def profile_numeric(t: Bench) -> DataFrame:
    return profile.numeric(t.lineitem).unionByName(profile.numeric(t.part))


@query("iqr_outliers", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS outlier_count FROM dirty_orders, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM dirty_orders)
WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)""" for c in _DIRTY_NUMBERS))
def iqr_outliers(t: Bench) -> DataFrame:
    return profile.numeric(t.dirty_orders).select("column", "outlier_count")


def _strings_sql(source: str, names: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"""SELECT {i} AS ordinal, '{c}' AS "column", round(avg(length({c})), 2) AS avg_length, CAST(min(length({c})) AS INT) AS min_length, CAST(max(length({c})) AS INT) AS max_length,
count(*) FILTER (WHERE {c} = '') AS empty_count, count(DISTINCT {c}) > 0.95 * count(*) AS looks_like_id FROM {source}""" for i, c in enumerate(names))


@query("profile_string", f"{_strings_sql('customer', ('c_name', 'c_mktsegment'))} UNION ALL {_strings_sql('documents', ('text', 'lang', 'source'))} UNION ALL {_strings_sql('dirty_orders', _DIRTY_TEXTS)}")
def profile_string(t: Bench) -> DataFrame:
    return profile.strings(t.customer).unionByName(profile.strings(t.documents)).unionByName(profile.strings(t.dirty_orders))


@query("profile_datetime", " UNION ALL ".join(
    f"""SELECT 0 AS ordinal, '{c}' AS "column", min({c}) AS min_date, max({c}) AS max_date, CAST(floor(epoch(max({c}) - min({c})) / 86400) AS INT) AS range_days FROM {s}"""
    for s, c in (("orders", "o_orderdate"), ("events", "ts"), ("lineitem", "l_shipdate"))))
def profile_datetime(t: Bench) -> DataFrame:
    return (profile.moments_in_time(t.orders).unionByName(profile.moments_in_time(t.events)).unionByName(profile.moments_in_time(t.lineitem)))


def _top_sql(source: str, names: tuple[str, ...]) -> str:
    each = " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS occurrences FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}""" for c in names)
    return f"""SELECT "column", rank, value, occurrences FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY occurrences DESC, value) AS INT) AS rank FROM ({each})) WHERE rank <= 5"""


@query("top_values", f"{_top_sql('orders', ('o_orderstatus', 'o_orderpriority'))} UNION ALL {_top_sql('customer', ('c_name', 'c_mktsegment'))}")
def top_values(t: Bench) -> DataFrame:
    return profile.top_values(t.orders).unionByName(profile.top_values(t.customer))


_ISSUES = f"""p AS ({_columns_sql('dirty_orders', _DIRTY_TYPES)}), r AS (SELECT *, null_count * 100.0E0 / row_count AS np FROM p),
issues AS (SELECT ordinal, "column", 'high_null_rate' AS issue, CASE WHEN np > 50 THEN 'critical' ELSE 'warning' END AS severity, concat(CAST(round(np, 1) AS VARCHAR), '% null') AS detail FROM r WHERE np > 20
UNION ALL SELECT ordinal, "column", 'constant_column', 'info', concat('Only value: ', (SELECT min(batch) FROM dirty_orders)) FROM r WHERE unique_count = 1
UNION ALL SELECT ordinal, "column", 'possible_id_column', 'info', concat(unique_count, ' unique out of ', row_count, ' rows') FROM r WHERE unique_count > 0.95 * row_count AND dtype = 'VARCHAR')"""


@query("profile_issues", f"WITH {_ISSUES} SELECT * FROM issues")
def profile_issues(t: Bench) -> DataFrame:
    return profile.issues(t.dirty_orders)


_CORRELATED = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "q2", "net", "sparse")


@query("correlations", " UNION ALL ".join(
    f"""SELECT column_1, column_2, round(r, 4) AS correlation FROM (SELECT '{a}' AS column_1, '{b}' AS column_2, corr({a}, {b}) AS r FROM (
SELECT *, l_quantity * 2 + l_tax AS q2, l_extendedprice * (1 - l_discount) AS net, CASE WHEN l_linenumber <> 3 THEN l_quantity * 3 END AS sparse FROM lineitem)) WHERE abs(r) > 0.7"""
    for i, a in enumerate(_CORRELATED) for b in _CORRELATED[i + 1:]))
def correlations(t: Bench) -> DataFrame:
    """All numeric columns, two derived ones and one with gaps."""
    df = t.lineitem.selectExpr("*", "l_quantity * 2 + l_tax AS q2", "l_extendedprice * (1 - l_discount) AS net", "CASE WHEN l_linenumber <> 3 THEN l_quantity * 3 END AS sparse")
    return profile.correlations(df)


_PII_EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
_PII_PHONE = r"(?:\+?1[\s\-.])?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}"
_PERSON = r"^[A-Z][a-z]+(?:[ \-''][A-Z][a-z]+)*$"
_PEOPLE = {
    "c_name": "c_name", "record": "concat('ref ', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'), '-12-', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0'))",
    "contact": "CASE WHEN c_custkey % 3 = 0 THEN concat('u', c_custkey, '@example.com') ELSE 'n/a' END",
    "home_address": "c_mktsegment", "state_name": "CASE WHEN c_nationkey < 20 THEN 'Texas' ELSE 'unknown' END",
    "last_name": "CASE WHEN c_custkey % 2 = 0 THEN 'Mary-Jane Watson' ELSE 'Smith' END", "first_year": "CAST(1990 + c_nationkey AS VARCHAR)",
    "tel": "CAST(5550000000 + c_custkey AS BIGINT)", "amount": "c_acctbal",
}


def _pii_sql(source: str, columns: dict[str, str]) -> str:
    def one(i: int, name: str, expr: str) -> str:
        return f"""SELECT {i} AS ordinal, '{name}' AS "column", count(v) AS n, count(*) FILTER (WHERE trim(v) <> '') AS filled,
count(*) FILTER (WHERE lower(trim(v)) IN ('texas')) AS states, count(*) FILTER (WHERE regexp_matches(trim(v), '{_PERSON}')) AS persons,
count(*) FILTER (WHERE regexp_matches(v, '{_PII_EMAIL}', 'i')) AS email, count(*) FILTER (WHERE regexp_matches(v, '{_PII_PHONE}')) AS phone,
count(*) FILTER (WHERE regexp_matches(v, '\\d{{3}}-\\d{{2}}-\\d{{4}}')) AS ssn, count(*) FILTER (WHERE regexp_matches(v, '^\\d{{10}}$')) AS npi
FROM (SELECT CAST({expr} AS VARCHAR) AS v FROM {source})"""
    strong = " ".join(f"WHEN contains(\"column\", '{h}') THEN 'name_hint:{h}'" for h in ("email", "phone", "ssn", "npi", "address", "zip", "dob"))
    weak = " ".join(f"WHEN filled > 0 AND persons >= 0.6 * filled AND contains(\"column\", '{h}') THEN 'name_hint:{h}'" for h in ("name", "first", "last"))
    value = " ".join(f"WHEN {k} > 0.1 * n THEN 'value_pattern:{k}'" for k in ("email", "phone", "ssn", "npi"))
    each = " UNION ALL ".join(one(i, n, e) for i, (n, e) in enumerate(columns.items()))
    return f"""SELECT ordinal, "column", reason, CASE WHEN regexp_matches(reason, 'name_hint:(email|phone|ssn|npi|address|zip|dob)') THEN 'high' ELSE 'medium' END AS confidence FROM
(SELECT *, CASE WHEN filled > 0 AND states >= 0.6 * filled THEN NULL {strong} {value} {weak} END AS reason FROM ({each})) WHERE reason IS NOT NULL"""


@query("pii_columns", f"""{_pii_sql('customer', _PEOPLE)} UNION ALL {_pii_sql('documents', {c: c for c in ('doc_id', 'text', 'lang', 'source', 'n_chars')})}
UNION ALL {_pii_sql('conversations', {c: c for c in ('conv_id', 'turn', 'role', 'text')})}""")
def pii_columns(t: Bench) -> DataFrame:
    people = t.spark.sql("""SELECT c_name, concat('ref ', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '-12-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) AS record,
CASE WHEN c_custkey % 3 = 0 THEN concat('u', c_custkey, '@example.com') ELSE 'n/a' END AS contact, c_mktsegment AS home_address,
CASE WHEN c_nationkey < 20 THEN 'Texas' ELSE 'unknown' END AS state_name, CASE WHEN c_custkey % 2 = 0 THEN 'Mary-Jane Watson' ELSE 'Smith' END AS last_name,
CAST(1990 + c_nationkey AS STRING) AS first_year, 5550000000 + c_custkey AS tel, c_acctbal AS amount FROM {customer}""", customer=t.customer)
    return profile.pii_columns(people).unionByName(profile.pii_columns(t.documents)).unionByName(profile.pii_columns(t.conversations))


@query("profile_all", f"""WITH o AS ({_OVERVIEW}), p AS ({_columns_sql('dirty_orders', _DIRTY_TYPES)}), {_ISSUES.split(', r AS', 1)[0].replace('p AS', 'p0 AS', 1)},
n AS ({_numeric_sql('dirty_orders', _DIRTY_NUMBERS)}), s AS ({_strings_sql('dirty_orders', _DIRTY_TEXTS)})
SELECT 'overview' AS section, '' AS "column", 'row_count' AS metric, CAST(row_count AS VARCHAR) AS value FROM o
UNION ALL SELECT 'overview', '', 'duplicate_pct', CAST(duplicate_pct AS VARCHAR) FROM o UNION ALL SELECT 'overview', '', 'completeness', CAST(completeness AS VARCHAR) FROM o
UNION ALL SELECT 'columns', "column", 'unique_count', CAST(unique_count AS VARCHAR) FROM p UNION ALL SELECT 'columns', "column", 'null_pct', CAST(null_pct AS VARCHAR) FROM p
UNION ALL SELECT 'numeric', "column", 'median', CAST(median AS VARCHAR) FROM n UNION ALL SELECT 'numeric', "column", 'outlier_count', CAST(outlier_count AS VARCHAR) FROM n
UNION ALL SELECT 'strings', "column", 'avg_length', CAST(avg_length AS VARCHAR) FROM s UNION ALL SELECT 'strings', "column", 'empty_count', CAST(empty_count AS VARCHAR) FROM s""")
def profile_all(t: Bench) -> DataFrame:
    facts = profile.Profile(t.dirty_orders).as_facts()
    shown = (("overview", "row_count"), ("overview", "duplicate_pct"), ("overview", "completeness"), ("columns", "unique_count"), ("columns", "null_pct"),
             ("numeric", "median"), ("numeric", "outlier_count"), ("strings", "avg_length"), ("strings", "empty_count"))
    wanted = [(F.col("section") == s) & (F.col("metric") == m) for s, m in shown]
    keep = wanted[0]
    for w in wanted[1:]:
        keep = keep | w
    return facts.filter(keep)


@query("numeric_minmax", " UNION ALL ".join(
    f"""SELECT {i} AS ordinal, '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean FROM {s}"""
    for s, names in (("part", _PART), ("lineitem", _LINE)) for i, c in enumerate(names)))
def numeric_minmax(t: Bench) -> DataFrame:
    return keys.numeric_summary(t.part).unionByName(keys.numeric_summary(t.lineitem))


# --- quality -------------------------------------------------------------------------------------------

_RAW_COMPLETE = f"""SELECT 0 AS ordinal, 'overall_completeness' AS "check", x >= 70 AS passed, CAST(round(x, 2) AS VARCHAR) AS value, '70.0' AS threshold,
concat(CAST(round(x, 1) AS VARCHAR), '% complete') AS detail FROM (SELECT ({{filled}}) * 100.0E0 / (count(*) * {{width}}) AS x FROM {{source}})"""


def _completeness_sql(source: str, columns: tuple[str, ...]) -> str:
    return _RAW_COMPLETE.format(filled=" + ".join(f"count({c})" for c in columns), width=len(columns), source=source)


def _duplicates_sql(source: str, columns: tuple[str, ...]) -> str:
    return f"""SELECT 1 AS ordinal, 'duplicate_rows' AS "check", d * 100.0E0 / n <= 5 AS passed, CAST(round(d * 100.0E0 / n, 2) AS VARCHAR) AS value, '5.0' AS threshold,
concat(CAST(d AS VARCHAR), ' duplicates') AS detail FROM (SELECT CAST(sum(k) AS BIGINT) AS n, CAST(sum(k - 1) AS BIGINT) AS d FROM (SELECT count(*) AS k FROM {source} GROUP BY {', '.join(columns)}))"""


def _nulls_sql(source: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"""SELECT {1000 + i} AS ordinal, 'null_rate_{c}' AS "check", x <= 20 AS passed, CAST(round(x, 2) AS VARCHAR) AS value, '20.0' AS threshold,
concat('Column ''{c}'': ', CAST(round(x, 1) AS VARCHAR), '% null') AS detail FROM (SELECT (count(*) - count({c})) * 100.0E0 / count(*) AS x FROM {source})"""
        for i, c in enumerate(columns))


def _mix_sql(source: str, columns: tuple[tuple[int, str], ...]) -> str:
    return " UNION ALL ".join(
        f"""SELECT {20000 + i} AS ordinal, 'type_consistency_{c}' AS "check", NOT (x > 0.1 AND x < 0.9) AS passed, concat(k, '/', n, ' numeric') AS value, '< 10% or > 90% numeric' AS threshold,
concat('Column ''{c}'': ', CASE WHEN x > 0.1 AND x < 0.9 THEN 'MIXED' ELSE 'consistent' END) AS detail
FROM (SELECT n, k, k * 1.0E0 / n AS x FROM (SELECT count({c}) AS n, count({parsed(c)}) AS k FROM {source}))""" for i, c in columns)


def _ranges_sql(source: str, columns: tuple[tuple[int, str], ...], positive: tuple[str, ...]) -> str:
    negative = [f"""SELECT {40000 + 2 * i} AS ordinal, 'no_negatives_{c}' AS "check", b = 0 AS passed, CAST(b AS VARCHAR) AS value, '0' AS threshold,
concat('Column ''{c}'': ', b, ' negative values found') AS detail FROM (SELECT count(*) FILTER (WHERE {c} < 0) AS b FROM {source})""" for i, c in columns if c in positive]
    return " UNION ALL ".join([*negative, _extreme_sql(source, columns)])


def _extreme_sql(source: str, columns: tuple[tuple[int, str], ...]) -> str:
    return " UNION ALL ".join(f"""SELECT {40001 + 2 * i} AS ordinal, 'extreme_outliers_{c}' AS "check", b = 0 AS passed, CAST(b AS VARCHAR) AS value, '> 5.0 std deviations' AS threshold,
concat('Column ''{c}'': ', b, ' extreme outliers') AS detail FROM (SELECT count(*) FILTER (WHERE abs(({c} - m) / s) > 5) AS b FROM {source}, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {source}))"""
                              for i, c in columns)


def _unique_sql(source: str, i: int, c: str) -> str:
    return f"""SELECT {60000 + i} AS ordinal, 'uniqueness_{c}' AS "check", k = n AS passed, CAST(k AS VARCHAR) AS value, CAST(n AS VARCHAR) AS threshold,
concat('Column ''{c}'': ', k, '/', n, ' unique') AS detail FROM (SELECT count(DISTINCT {c}) AS k, count(*) AS n FROM {source}) WHERE k > 0.9 * n"""


@query("check_completeness", _completeness_sql("dirty_orders", DIRTY))
def check_completeness(t: Bench) -> DataFrame:
    return quality.completeness(t.dirty_orders)


@query("check_duplicates", _duplicates_sql("dirty_orders", DIRTY))
def check_duplicates(t: Bench) -> DataFrame:
    return quality.duplicates(t.dirty_orders)


@query("check_null_rates", _nulls_sql("dirty_orders", DIRTY))
def check_null_rates(t: Bench) -> DataFrame:
    return quality.null_rates(t.dirty_orders)


@query("check_type_mix", _mix_sql("dirty_orders", ((3, "priority"), (4, "qty_text"), (5, "order_date"), (6, "batch"))))
def check_type_mix(t: Bench) -> DataFrame:
    return quality.type_mix(t.dirty_orders)


@query("check_no_negatives", _ranges_sql("dirty_orders", ((2, "line_count"),), ("line_count",)).split(" UNION ALL ")[0])
def check_no_negatives(t: Bench) -> DataFrame:
    return quality.no_negatives(t.dirty_orders)


@query("check_extreme", _extreme_sql("dirty_orders", ((0, "order_id"), (1, "total_price"), (2, "line_count"))))
def check_extreme(t: Bench) -> DataFrame:
    return quality.extreme_outliers(t.dirty_orders)


@query("check_uniqueness", f"{_unique_sql('dirty_orders', 0, 'order_id')} UNION ALL {_unique_sql('events', 0, 'event_id')}")
def check_uniqueness(t: Bench) -> DataFrame:
    return quality.uniqueness(t.dirty_orders).unionByName(quality.uniqueness(t.events))


SCORECARD = " UNION ALL ".join([
    _completeness_sql("dirty_orders", DIRTY), _duplicates_sql("dirty_orders", DIRTY), _nulls_sql("dirty_orders", DIRTY),
    _mix_sql("dirty_orders", ((3, "priority"), (4, "qty_text"), (5, "order_date"), (6, "batch"))),
    _ranges_sql("dirty_orders", ((0, "order_id"), (1, "total_price"), (2, "line_count")), ("line_count",)), _unique_sql("dirty_orders", 0, "order_id")])
_SUMMARY = """summary AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'F' END AS grade FROM
(SELECT count(*) AS total_checks, count(*) FILTER (WHERE passed) AS checks_passed, count(*) FILTER (WHERE NOT passed) AS checks_failed,
round(count(*) FILTER (WHERE passed) * 100.0E0 / count(*), 2) AS score FROM c))"""


@query("scorecard", SCORECARD)
def scorecard(t: Bench) -> DataFrame:
    return quality.scorecard(t.dirty_orders)


@query("scorecard_summary", f"WITH c AS ({SCORECARD}), {_SUMMARY} SELECT * FROM summary")
def scorecard_summary(t: Bench) -> DataFrame:
    return quality.summarize(quality.scorecard(t.dirty_orders))


@query("quality_dimensions", f"""WITH c AS ({SCORECARD}) SELECT CASE WHEN prefix("check", 'overall') THEN 'Completeness' WHEN prefix("check", 'duplicate') THEN 'Duplicates'
WHEN prefix("check", 'null_rate_') THEN 'Missing values' WHEN prefix("check", 'type_') THEN 'Type consistency' WHEN prefix("check", 'uniqueness_') THEN 'Uniqueness' ELSE 'Value ranges' END AS dimension,
count(*) FILTER (WHERE passed) AS passed, count(*) AS total, min(ordinal) AS first_ordinal FROM c GROUP BY 1""")
def quality_dimensions(t: Bench) -> DataFrame:
    return quality.by_dimension(quality.scorecard(t.dirty_orders))


@query("quality_details", f"""WITH c AS ({SCORECARD}), d AS (SELECT CASE WHEN prefix("check", 'overall') THEN 'Completeness' WHEN prefix("check", 'duplicate') THEN 'Duplicates'
WHEN prefix("check", 'null_rate_') THEN 'Missing values' WHEN prefix("check", 'type_') THEN 'Type consistency' WHEN prefix("check", 'uniqueness_') THEN 'Uniqueness' ELSE 'Value ranges' END AS dimension, * FROM c)
SELECT dimension, CAST(row_number() OVER (PARTITION BY dimension ORDER BY ordinal, "check") AS INT) AS place, "check", passed, detail FROM d""")
def quality_details(t: Bench) -> DataFrame:
    return quality.dimension_details(quality.scorecard(t.dirty_orders))


@query("quality_gate", """SELECT run_id, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'F' END AS grade, score < 75 AS blocked FROM runs""")
def quality_gate(t: Bench) -> DataFrame:
    graded = t.runs.select("run_id", "score", num.grade(F.col("score")).alias("grade"))
    return graded.withColumn("blocked", quality.gate_blocks(F.col("grade"), "B"))


@query("triage_issues", f"""WITH c AS ({SCORECARD}), {_ISSUES}, u AS (SELECT severity, replace(issue, '_', ' ') AS title, "column", concat(issue, '_', "column") AS check_name, 0 AS part, ordinal FROM issues
UNION ALL SELECT 'fail', replace("check", '_', ' '), CASE WHEN regexp_matches("check", '^(null_rate_|no_negatives_|extreme_outliers_|type_consistency_|uniqueness_)')
THEN regexp_replace("check", '^(null_rate_|no_negatives_|extreme_outliers_|type_consistency_|uniqueness_)', '') ELSE '—' END, "check", 1, ordinal FROM c WHERE NOT passed)
SELECT CASE severity WHEN 'critical' THEN 0 WHEN 'fail' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS rank, CASE severity WHEN 'critical' THEN 'Critical' WHEN 'fail' THEN 'Failed check' WHEN 'warning' THEN 'Warning' ELSE 'Info' END AS label,
CASE severity WHEN 'critical' THEN 'fail' WHEN 'fail' THEN 'fail' WHEN 'warning' THEN 'warn' ELSE 'info' END AS kind, title, "column", check_name, part, ordinal FROM u""")
def triage_issues(t: Bench) -> DataFrame:
    return quality.triage(profile.issues(t.dirty_orders), quality.scorecard(t.dirty_orders))


@query("triage_top", f"""WITH c AS ({SCORECARD}), s AS (SELECT CASE WHEN contains("check", 'overall_completeness') THEN 0 WHEN contains("check", 'duplicate_rows') THEN 1 WHEN contains("check", 'null_rate') THEN 2
WHEN contains("check", 'no_negatives') THEN 3 WHEN contains("check", 'extreme_outliers') THEN 4 WHEN contains("check", 'type_consistency') THEN 5 WHEN contains("check", 'uniqueness') THEN 6 ELSE 9 END AS severity,
ordinal, "check", regexp_replace("check", '^(null_rate_|no_negatives_|extreme_outliers_|type_consistency_|uniqueness_)', '') AS col FROM c WHERE NOT passed)
SELECT severity, ordinal, "check", CASE severity WHEN 0 THEN 'Many cells are missing overall; results may be biased.' WHEN 1 THEN 'Repeated rows inflate counts and totals.'
WHEN 2 THEN concat('Column ', col, ' is often missing, which shrinks the usable rows.') WHEN 3 THEN concat('Column ', col, ' should be positive but holds negative values.')
WHEN 4 THEN concat('Column ', col, ' holds extreme values that distort means and models.') WHEN 5 THEN concat('Column ', col, ' mixes numbers and text.')
ELSE 'Quality issue detected; review the affected data.' END AS explanation, CASE severity WHEN 0 THEN 'df.dropna(thresh=len(df.columns) // 2)' WHEN 1 THEN 'df.dropDuplicates()'
WHEN 2 THEN concat('df.fillna({{''', col, ''': median}})') WHEN 3 THEN concat('df.filter(F.col(''', col, ''') >= 0)') WHEN 4 THEN concat('df.filter(F.col(''', col, ''').between(p01, p99))')
WHEN 5 THEN concat('df.withColumn(''', col, ''', F.col(''', col, ''').try_cast(''double''))') ELSE 'review the column and apply a fitting clean-up' END AS suggested_fix
FROM s ORDER BY severity, ordinal LIMIT 5""")
def triage_top(t: Bench) -> DataFrame:
    return quality.triage_top(quality.scorecard(t.dirty_orders))


# --- documentation ---------------------------------------------------------------------------------------


_SAMPLES = {c: f"(SELECT string_agg(CAST(v AS VARCHAR), ', ' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM orders WHERE {c} IS NOT NULL ORDER BY v LIMIT 3))" for c, _ in _ORDERS}
_DESCRIBE = {"o_orderkey": "No description available — review column contents", "o_custkey": "No description available — review column contents",
             "o_orderstatus": "Current status of the record", "o_totalprice": "No description available — review column contents",
             "o_orderdate": "Date of the event or measurement", "o_orderpriority": "No description available — review column contents"}


@query("data_dictionary", " UNION ALL ".join(
    f"""SELECT {i} AS ordinal, '{c}' AS column_name, '{k}' AS data_type, count(*) > count({c}) AS nullable, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count,
{_SAMPLES[c]} AS sample_values, '{_DESCRIBE[c]}' AS description FROM orders""" for i, (c, k) in enumerate(_ORDERS)))
def data_dictionary(t: Bench) -> DataFrame:
    return docs.data_dictionary(t.orders)


@query("logical_schema", " UNION ALL ".join(
    f"SELECT {i} AS ordinal, '{c}' AS column_name, '{k}' AS data_type, count(*) > count({c}) AS nullable, count(*) AS row_count, CAST({sum(1 for _, x in _DIRTY_TYPES if x == k)} AS BIGINT) AS n_columns FROM dirty_orders"
    for i, (c, k) in enumerate(_DIRTY_TYPES)))
def logical_schema(t: Bench) -> DataFrame:
    schema = stage(docs.logical_schema(t.dirty_orders), "schema")
    return schema.join(docs.type_counts(schema), "data_type")


_NODES = """nodes AS (SELECT 'orders' AS run_id, * FROM (SELECT * FROM (VALUES (1, 'transform', 'standardize_columns'), (2, 'transform', 'remove_duplicates'), (3, 'transform', 'convert_types'), (4, 'transform', 'handle_nulls'),
(5, 'transform', 'clean_text_columns'), (6, 'transform', 'add_metadata_columns')) v(ordinal, kind, title), (SELECT CAST(NULL AS BIGINT) AS n_rows)
UNION ALL SELECT 0, 'source', 'orders.csv', count(*) FROM dirty_orders UNION ALL SELECT 1000, 'table', 'orders', count(*) FROM (SELECT DISTINCT * FROM dirty_orders)
UNION ALL SELECT 1001, 'mart', 'mart_orders', NULL))"""


def _nodes(t: Bench) -> DataFrame:
    counts = clean.transform(t.dirty_orders, "orders").counts
    log = clean.transform_log(t.spark, counts, "orders")
    return docs.lineage_nodes(log, "orders.csv", "orders", counts["rows_before"], counts["rows_after"], "mart_orders")


@query("lineage_nodes", f"WITH {_NODES} SELECT * FROM nodes")
def lineage_nodes(t: Bench) -> DataFrame:
    return _nodes(t)


@query("lineage_edges", f"""WITH {_NODES}, e AS (SELECT run_id, ordinal, title AS from_node, lead(title) OVER (PARTITION BY run_id ORDER BY ordinal) AS to_node FROM nodes) SELECT * FROM e WHERE to_node IS NOT NULL""")
def lineage_edges(t: Bench) -> DataFrame:
    return docs.lineage_edges(_nodes(t))


# The checks of the cleaned rows, load metadata included.
_CLEAN_COLUMNS = ("order_id", "total_price", "line_count", "priority", "qty_text", "order_date", "batch", "_loaded_at", "_source")
_CLEAN_SCORECARD = " UNION ALL ".join([
    _completeness_sql("cleaned2", _CLEAN_COLUMNS), _duplicates_sql("cleaned2", _CLEAN_COLUMNS), _nulls_sql("cleaned2", _CLEAN_COLUMNS),
    _mix_sql("cleaned2", ((3, "priority"), (6, "batch"), (8, "_source"))),
    _ranges_sql("cleaned2", ((0, "order_id"), (1, "total_price"), (2, "line_count"), (4, "qty_text")), ("line_count",)), _unique_sql("cleaned2", 0, "order_id")])
_ONBOARDED = f"""{_CLEANED}, cleaned2 AS (SELECT *, TIMESTAMP '2024-01-01' AS _loaded_at FROM cleaned), c AS ({_CLEAN_SCORECARD}), {_SUMMARY}"""


@query("onboard_summary", f"""WITH {_ONBOARDED} SELECT 'orders' AS dataset_name, 'orders' AS table_name, (SELECT count(*) FROM dirty_orders) AS rows_in, (SELECT count(*) FROM cleaned) AS rows_out,
total_checks, checks_passed, score, grade, grade = 'F' AS gate_blocked FROM summary""")
def onboard_summary(t: Bench) -> DataFrame:
    return onboarding.summary_row(onboarding.onboard(t.spark, t.dirty_orders, "orders", minimum_grade="C", load=False))

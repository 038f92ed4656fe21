"""Queries over column functions, filters, joins and keyword matching."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright import rules
from martwright.catalogue.base import Bench, query
from martwright.functions import numeric as num
from martwright.functions import text as txt
from martwright.operators import clean, history, joins, keywords

# Number text, as the oracle's regular expression.
NUM = r"'^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$'"


def parsed(c: str) -> str:
    """Oracle text of safe numeric parsing."""
    return f"CASE WHEN regexp_matches({c}, {NUM}) THEN TRY_CAST(trim({c}) AS DOUBLE) END"


@query("safe_numeric", f"""WITH v AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN '1d' WHEN 1 THEN '1_000' WHEN 2 THEN ' 12.5 ' WHEN 3 THEN '-3e2'
WHEN 4 THEN regexp_extract(props, '[0-9]+') WHEN 5 THEN 'abc' WHEN 6 THEN '.5' ELSE '7.' END AS raw FROM events)
SELECT event_id, {parsed('raw')} AS number FROM v""")
def safe_numeric(t: Bench) -> DataFrame:
    kinds = ["1d", "1_000", " 12.5 ", "-3e2", None, "abc", ".5", "7."]
    slot = F.col("event_id") % 8
    raw = F.coalesce(*[F.when(slot == i, F.lit(k) if k else F.regexp_extract("props", "[0-9]+", 0)) for i, k in enumerate(kinds)])
    return t.events.select("event_id", num.safe_numeric(raw).alias("number"))


@query("safe_datetime", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE o_orderdate END AS moment FROM orders""")
def safe_datetime(t: Bench) -> DataFrame:
    layouts = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy", "yyyy/MM/dd"]
    slot = F.col("o_orderkey") % 5
    raw = F.coalesce(*[F.when(slot == i, F.date_format("o_orderdate", f)) for i, f in enumerate(layouts)], F.lit("not a date"))
    return t.orders.select("o_orderkey", num.safe_timestamp(raw).alias("moment"))


@query("empty_to_null", """SELECT CAST(npi AS BIGINT) AS npi, count(*) AS n, count(nullif(trim(payment_text), '')) AS filled, round(sum(TRY_CAST(nullif(trim(payment_text), '') AS DOUBLE)), 2) AS payment
FROM provider_rows GROUP BY npi""")
def empty_to_null(t: Bench) -> DataFrame:
    value = num.blank_to_null(F.col("payment_text"))
    return t.provider_rows.groupBy("npi").agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("filled"),
                                             F.round(F.sum(num.safe_numeric(value)), 2).alias("payment"))


@query("text_strip_lower", "SELECT c_custkey, lower(c_name) AS name, lower(c_mktsegment) AS segment FROM customer")
def text_strip_lower(t: Bench) -> DataFrame:
    padded = F.concat(F.lit(" \t "), F.col("c_name"), F.lit(" \n"))
    return t.customer.select("c_custkey", txt.strip_lower(padded).alias("name"), txt.strip_lower(F.col("c_mktsegment")).alias("segment"))


@query("slugify", """SELECT p_partkey, regexp_replace(lower(concat(p_name, ' (', p_brand, ')')), '[^a-z0-9]+', '_', 'g').trim('_') AS table_name,
concat('mart_', substr(regexp_replace(lower(concat(p_name, ' vs ', p_type, ' spend per capita!')), '[^a-z0-9]+', '_', 'g').trim('_'), 1, 40)) AS mart_name,
substr(concat('ext_', regexp_replace(lower(concat(p_name, '_', p_brand)), '[^a-z0-9]+', '_', 'g').trim('_')), 1, 60) AS external_name FROM part""")
def slugify(t: Bench) -> DataFrame:
    title = F.concat("p_name", F.lit(" vs "), "p_type", F.lit(" spend per capita!"))
    return t.part.select("p_partkey", txt.table_name(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("table_name"),
                         txt.mart_slug(title, F.col("p_type")).alias("mart_name"),
                         txt.external_name(F.col("p_name"), F.col("p_brand")).alias("external_name"))


@query("clean_names", """SELECT order_id AS order_id, total_price AS order_i_d_2, line_count AS line_count, priority AS priority_text, qty_text AS qty_text, order_date AS order_date,
batch AS batch_2 FROM (SELECT * FROM dirty_orders)""")
def clean_names(t: Bench) -> DataFrame:
    raw = t.dirty_orders.toDF("order id", "OrderID__2", "lineCount", "Priority (text)", "qty-text", "order.date", "Batch 2")
    return clean.standardize_columns(raw)


_EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
_PHONE = r"(^|[^0-9])(?:\+?1[\s\-.])?(?:\(\d{3}\)|\d{3})[\s\-.]\d{3}[\s\-.]?\d{4}\b"
_SSN, _NPI = r"\b\d{3}-\d{2}-\d{4}\b", r"\b\d{10}\b"
_SCRUB = f"""scrubbed AS (SELECT *, regexp_replace(t1, '{_PHONE}', '\\1[REDACTED:phone]', 'g') AS t2 FROM
(SELECT *, regexp_replace(text, '{_EMAIL}', '[REDACTED:email]', 'gi') AS t1 FROM texts)),
scrubbed2 AS (SELECT *, regexp_replace(t3, '{_NPI}', '[REDACTED:npi]', 'g') AS t4 FROM
(SELECT *, regexp_replace(t2, '{_SSN}', '[REDACTED:ssn]', 'g') AS t3 FROM scrubbed))"""
_TEXTS = """texts AS (SELECT 'd' AS kind, doc_id AS id, CAST(0 AS BIGINT) AS turn, concat(text, ' id 1234567890 ssn 123-45-6789 tel (555) 123-4567') AS text FROM documents
UNION ALL SELECT 'c', conv_id, turn, text FROM conversations)"""


def _texts(t: Bench) -> DataFrame:
    planted = F.concat("text", F.lit(" id 1234567890 ssn 123-45-6789 tel (555) 123-4567"))
    docs = t.documents.select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), planted.alias("text"))
    return docs.unionByName(t.conversations.select(F.lit("c").alias("kind"), F.col("conv_id").alias("id"), "turn", "text"))


@query("pii_scrub", f"WITH {_TEXTS}, {_SCRUB} SELECT kind, id, turn, t4 AS clean_text FROM scrubbed2")
def pii_scrub(t: Bench) -> DataFrame:
    return _texts(t).select("kind", "id", "turn", txt.scrub(F.col("text")).alias("clean_text"))


@query("pii_counts", f"""WITH {_TEXTS}, {_SCRUB} SELECT kind, CAST(sum(len(regexp_extract_all(text, '{_EMAIL}', 0, 'i'))) AS BIGINT) AS email,
CAST(sum(len(regexp_extract_all(t1, '{_PHONE}'))) AS BIGINT) AS phone, CAST(sum(len(regexp_extract_all(t2, '{_SSN}'))) AS BIGINT) AS ssn,
CAST(sum(len(regexp_extract_all(t3, '{_NPI}'))) AS BIGINT) AS npi FROM scrubbed2 GROUP BY kind""")
def pii_counts(t: Bench) -> DataFrame:
    counts = txt.scrub_counts(F.col("text"))
    return _texts(t).groupBy("kind").agg(*[F.sum(c).alias(k) for k, c in counts.items()])


_CLEAN = r"""cleaned AS (SELECT conv_id, turn, trim(regexp_replace(split_part(CASE WHEN s = '' THEN f ELSE s END, ';', 1), '[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+', ' ', 'g')) AS sql FROM
(SELECT *, regexp_extract(f, '(?s)\b(?:SELECT|WITH)\b.*', 0, 'i') AS s FROM
(SELECT *, replace(regexp_replace(raw, '```[a-zA-Z]*\n?', '', 'g'), '```', '') AS f FROM statements)))"""


@query("sql_clean", f"WITH {_CLEAN} SELECT conv_id, turn, sql FROM cleaned")
def sql_clean(t: Bench) -> DataFrame:
    return t.statements.select("conv_id", "turn", txt.clean_sql(F.col("raw")).alias("sql"))


@query("sql_validate", f"""WITH {_CLEAN}, r AS (SELECT conv_id, turn, CASE WHEN sql = '' THEN 'SQL is empty after cleaning'
WHEN NOT regexp_matches(sql, '^(SELECT|WITH)', 'i') THEN 'SQL must start with SELECT or WITH'
{' '.join(f"WHEN regexp_matches(sql, '{chr(92)}b{w}{chr(92)}b', 'i') THEN 'Forbidden keyword in SQL: {w}'" for w in rules.FORBIDDEN_SQL_WORDS)}
WHEN contains(sql, ';') THEN 'Multiple statements detected ('';'' present)' ELSE '' END AS reason FROM cleaned)
SELECT conv_id, turn, reason = '' AS is_valid, reason FROM r""")
def sql_validate(t: Bench) -> DataFrame:
    reason = txt.sql_rejection(txt.clean_sql(F.col("raw")))
    return t.statements.select("conv_id", "turn", (reason == "").alias("is_valid"), reason.alias("reason"))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("scope_flags", f"""WITH f AS (SELECT conv_id, turn, regexp_matches(request, {_quote(rules.INDIVIDUAL_PATTERN)}) AS asks_individuals,
regexp_matches(request, {_quote(rules.DEMOGRAPHIC_PATTERN)}) AS asks_demographics FROM requests)
SELECT *, CASE WHEN asks_individuals OR asks_demographics THEN concat({_quote(rules.CAVEAT_LEAD)}, concat_ws(' and ', CASE WHEN asks_individuals THEN
{_quote(rules.INDIVIDUAL_CAVEAT)} END, CASE WHEN asks_demographics THEN {_quote(rules.DEMOGRAPHIC_CAVEAT)} END), {_quote(rules.CAVEAT_TAIL)}) END AS caveat FROM f""")
def scope_flags(t: Bench) -> DataFrame:
    text = F.col("request")
    return t.requests.select("conv_id", "turn", txt.asks_individuals(text).alias("asks_individuals"),
                             txt.asks_demographics(text).alias("asks_demographics"), txt.scope_caveat(text).alias("caveat"))


_FOCUS = " ".join(f"WHEN regexp_matches(lower(request), '{'|'.join(words)}') THEN '{name}'" for name, words in rules.FOCUS_KEYWORDS)


@query("focus_class", f"SELECT conv_id, turn, CASE {_FOCUS} ELSE 'payer' END AS focus FROM requests")
def focus_class(t: Bench) -> DataFrame:
    return t.requests.select("conv_id", "turn", txt.focus(F.col("request")).alias("focus"))


@query("grade_bands", """WITH s AS (SELECT d.doc_id, round(coalesce(l.quality, 0) * 55.0E0 + (1 - coalesce(l.toxic, 1)) * 25.0E0 + least(d.n_chars / 100, 20.0E0), 2) AS score
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT doc_id, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'F' END AS grade FROM s""")
def grade_bands(t: Bench) -> DataFrame:
    score = F.round(F.coalesce("quality", F.lit(0)) * 55.0 + (1 - F.coalesce("toxic", F.lit(1))) * 25.0 + F.least(F.col("n_chars") / 100, F.lit(20.0)), 2)
    scored = t.documents.join(t.labels, "doc_id", "left").select("doc_id", score.alias("score"))
    return scored.withColumn("grade", num.grade(F.col("score")))


@query("staleness", """SELECT o_orderkey, CAST(floor(epoch(TIMESTAMP '2001-08-05 12:00:00' - o_orderdate) / 86400) AS INT) AS age_days,
floor(epoch(TIMESTAMP '2001-08-05 12:00:00' - o_orderdate) / 86400) > 7 AS is_stale FROM orders""")
def staleness(t: Bench) -> DataFrame:
    as_of = F.lit(datetime(2001, 8, 5, 12)).cast("timestamp_ntz")
    return t.orders.select("o_orderkey", *[c.alias(k) for k, c in history.freshness(F.col("o_orderdate"), as_of).items()])


@query("crosswalk", """SELECT c.c_custkey, c.c_nationkey, n.n_name AS nation, r.r_name AS region FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey""")
def crosswalk(t: Bench) -> DataFrame:
    nations = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"), F.col("n_regionkey").alias("rk"))
    regions = t.region.select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("region"))
    return joins.crosswalk_join(joins.crosswalk_join(t.customer, nations, "c_nationkey"), regions, "rk").select("c_custkey", "c_nationkey", "nation", "region")


_SPELL = """spellings AS (SELECT lower(n_name) AS spelling, n_nationkey FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_nationkey FROM nation)"""


@query("norm_key_join", f"""WITH {_SPELL} SELECT c_custkey, raw_key, n_nationkey FROM keyed_customers JOIN spellings ON lower(trim(raw_key)) = spelling""")
def norm_key_join(t: Bench) -> DataFrame:
    return joins.normalize_key(t.keyed_customers, "raw_key", t.nation, "n_nationkey", "n_name", "n_nationkey").select("c_custkey", "raw_key", "n_nationkey")


_EXT = "ext_events_value"


@query("external_measure", f"""WITH {_SPELL}, e AS (SELECT concat(' Nation_', CAST(user_id % 20 AS VARCHAR)) AS raw_key, value FROM events),
a AS (SELECT n_nationkey, round(avg(value), 2) AS {_EXT} FROM e JOIN spellings ON lower(trim(raw_key)) = spelling GROUP BY n_nationkey)
SELECT n.n_nationkey, a.{_EXT} FROM nation n LEFT JOIN a ON n.n_nationkey = a.n_nationkey""")
def external_measure(t: Bench) -> DataFrame:
    onboarded = t.events.select(F.concat(F.lit(" Nation_"), (F.col("user_id") % 20).cast("string")).alias("raw_key"), "value")
    name = joins.external_column("events", "value")
    added = joins.external_measure(onboarded, "raw_key", "value", "mean", t.nation, "n_nationkey", "n_name", "n_nationkey", name=name)
    return joins.spine_join(t.nation.select("n_nationkey"), added, "n_nationkey")


@query("spine_join", """SELECT n.n_nationkey, a.customers, a.balance FROM (SELECT n_nationkey FROM nation UNION ALL SELECT r_regionkey + 100 FROM region) n
LEFT JOIN (SELECT c_nationkey, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_nationkey) a ON n.n_nationkey = a.c_nationkey""")
def spine_join(t: Bench) -> DataFrame:
    """All customers on a spine with keys that none of them has."""
    agg = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    spine = t.nation.select("n_nationkey").union(t.region.select(F.col("r_regionkey") + 100))
    return joins.spine_join(spine, agg, "n_nationkey")


@query("group_sum_distinct", """SELECT loc, round(coalesce(sum(TRY_CAST(payment_text AS DOUBLE)), 0), 2) AS total_payment, count(DISTINCT npi) AS provider_count
FROM provider_rows WHERE loc IS NOT NULL GROUP BY loc""")
def group_sum_distinct(t: Bench) -> DataFrame:
    paid = t.provider_rows.withColumn("payment", num.safe_numeric(num.blank_to_null(F.col("payment_text"))))
    out = joins.group_sum_distinct(paid, "loc", "payment", "npi", "total_payment", "provider_count")
    return out.withColumn("total_payment", F.round("total_payment", 2))


@query("group_by_op", """SELECT l_returnflag, 'avg' AS op, round(avg(l_quantity), 4) AS value FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'sum', round(sum(l_quantity), 4) FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'count', CAST(count(l_quantity) AS DOUBLE) FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'median?', round(avg(l_quantity), 4) FROM lineitem GROUP BY 1""")
def group_by_op(t: Bench) -> DataFrame:
    found = joins.group_by_ops(t.lineitem, "l_returnflag", "l_quantity", ("avg", "sum", "count", "median?"), "value")
    return found.withColumn("value", F.round("value", 4))


@query("catalog_topics", """WITH m AS (SELECT DISTINCT p_type AS topic, p_brand AS question_id FROM part)
SELECT topic, question_id, count(*) OVER (PARTITION BY topic) AS topic_measures, (SELECT count(DISTINCT topic) FROM m) AS topics FROM m""")
def catalog_topics(t: Bench) -> DataFrame:
    listed = t.part.select(F.col("p_type").alias("topic"), F.col("p_brand").alias("question_id")).distinct()
    sizes = listed.groupBy("topic").agg(F.count(F.lit(1)).alias("topic_measures"))
    topics = listed.agg(F.countDistinct("topic").alias("x")).scalar()
    return listed.join(sizes, "topic").withColumn("topics", topics).select("topic", "question_id", "topic_measures", "topics").orderBy("topic", "question_id")


_WORDS = """words AS (SELECT DISTINCT question_id, unnest(regexp_extract_all(lower(concat(question, ' ', topic)), '[a-z]{4,}')) AS word FROM catalog_rows)"""


@query("keyword_overlap", f"""WITH {_WORDS}, r AS (SELECT conv_id, turn, request, unnest(regexp_extract_all(lower(request), '[a-z]{{4,}}')) AS token FROM requests),
hit AS (SELECT DISTINCT conv_id, turn FROM r JOIN words ON token = word)
SELECT q.conv_id, q.turn, regexp_matches(lower(q.request), '{'|'.join(rules.FIXED_COLUMN_TERMS)}') OR h.conv_id IS NOT NULL AS matched
FROM requests q LEFT JOIN hit h ON q.conv_id = h.conv_id AND q.turn = h.turn""")
def keyword_overlap(t: Bench) -> DataFrame:
    return keywords.matches_catalog(t.requests, ["conv_id", "turn"], "request", t.catalog_rows)


_SYN = ", ".join(f"({i}, '{term}', '{qid}')" for i, (term, qid) in enumerate(rules.MEASURE_SYNONYMS))


@query("keyword_topk", f"""WITH {_WORDS}, lookup AS (SELECT w.word, w.question_id, c.ordinal + {len(rules.MEASURE_SYNONYMS)} AS place FROM words w JOIN catalog_rows c ON w.question_id = c.question_id
UNION ALL SELECT s.word, s.question_id, s.place FROM (VALUES {_SYN}) s(place, word, question_id) WHERE s.question_id IN (SELECT question_id FROM catalog_rows)),
found AS (SELECT r.conv_id, r.turn, l.question_id, min(l.place) AS place FROM requests r JOIN lookup l ON contains(lower(r.request), l.word) GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY place, question_id) AS INT) AS position FROM found)
SELECT conv_id, turn, position, question_id FROM ranked WHERE position <= 6
UNION ALL SELECT conv_id, turn, 1, 'DIA01' FROM requests r WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.conv_id = r.conv_id AND f.turn = r.turn)""")
def keyword_topk(t: Bench) -> DataFrame:
    return keywords.pick_measures(t.requests, ["conv_id", "turn"], "request", t.catalog_rows, ["DIA01"])


_STOP = ", ".join(f"'{w}'" for w in rules.SUGGESTION_STOP_WORDS)


@query("metric_suggestions", f"""WITH m AS (SELECT concat('ext::', question_id) AS metric_id, ordinal, unnest(list_distinct(regexp_extract_all(lower(concat(question, ' prices per ', topic)), '[a-z]{{4,}}'))) AS token FROM catalog_rows),
r AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(request), '[a-z]{{4,}}'))) AS token FROM requests),
hits AS (SELECT DISTINCT r.conv_id, r.turn, m.ordinal, m.metric_id FROM r JOIN m ON r.token = m.token WHERE r.token NOT IN ({_STOP})),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY ordinal, metric_id) AS INT) AS position FROM hits)
SELECT conv_id, turn, position, metric_id FROM ranked WHERE position <= 6""")
def metric_suggestions(t: Bench) -> DataFrame:
    metrics = t.catalog_rows.select(F.concat(F.lit("ext::"), "question_id").alias("metric_id"), "ordinal",
                                    F.concat("question", F.lit(" prices per "), "topic").alias("meaning"))
    return keywords.suggest_metrics(t.requests, ["conv_id", "turn"], "request", metrics)


@query("valid_measures", """WITH known AS (SELECT request_id, upper(trim(measure)) AS question_id, min(ordinal) AS place FROM picked
WHERE upper(trim(measure)) IN (SELECT DISTINCT p_type FROM part WHERE p_type <> 'PROMO') GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY place, question_id) AS INT) AS position FROM known)
SELECT request_id, position, question_id, position = 1 AS is_primary FROM ranked WHERE position <= 6""")
def valid_measures(t: Bench) -> DataFrame:
    catalog = t.part.select(F.col("p_type").alias("question_id")).filter("question_id <> 'PROMO'").distinct()
    return keywords.valid_measures(t.picked, "request_id", "ordinal", "measure", catalog)



"""Queries over the mart, its checks and its facts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.catalogue.base import MEASURE_COLUMNS, MEASURES, SCHEMA, SPEND, YEARS, Bench, query
from martwright.catalogue.profiles import _SUMMARY, _completeness_sql, _duplicates_sql, _extreme_sql, _nulls_sql
from martwright.operators import facts, joins, keys, mart as marts, quality
from martwright.plans import mart_build
from martwright.session import stage

KEY = "loc"
PRIMARY = MEASURE_COLUMNS[0]
_YEARS = ", ".join(str(y) for y in YEARS)


def _latest_sql(source: str) -> str:
    return f"""newest AS (SELECT loc, question_id, max(yr) AS yr FROM {source} WHERE value IS NOT NULL AND yr IN ({_YEARS}) GROUP BY loc, question_id),
latest AS (SELECT m.loc, m.question_id, min(m.value) AS value, m.yr AS vintage FROM {source} m JOIN newest n ON m.loc = n.loc AND m.question_id = n.question_id AND m.yr = n.yr
WHERE m.value IS NOT NULL GROUP BY m.loc, m.question_id, m.yr)"""


_WIDE = ", ".join(f"max(CASE WHEN question_id = '{m}' THEN value END) AS {c}, max(CASE WHEN question_id = '{m}' THEN vintage END) AS {m.lower()}_vintage"
                  for m, c in zip(MEASURES, MEASURE_COLUMNS))


def _mart_sql(source: str = "measure_long") -> str:
    """The mart as common table expressions."""
    wide = ", ".join(f"w.{c}, w.{m.lower()}_vintage" for m, c in zip(MEASURES, MEASURE_COLUMNS))
    return f"""{_latest_sql(source)}, wide AS (SELECT loc, {_WIDE} FROM latest GROUP BY loc),
paid AS (SELECT loc, coalesce(sum(TRY_CAST(payment_text AS DOUBLE)), 0) AS total_payment, count(DISTINCT npi) AS provider_count FROM provider_rows WHERE loc <> 99 GROUP BY loc),
mart AS (SELECT n.n_nationkey AS loc, p.population, {wide}, paid.total_payment, paid.provider_count, 1998 AS payment_year,
round(paid.total_payment / nullif(p.population, 0), 2) AS spend_per_capita, round(paid.provider_count * 1.0E0 / nullif(p.population, 0) * 100000, 1) AS providers_per_100k
FROM nation n LEFT JOIN population p ON p.loc = n.n_nationkey LEFT JOIN wide w ON w.loc = n.n_nationkey LEFT JOIN paid ON paid.loc = n.n_nationkey)"""


MART = _mart_sql()
_ALL = " AND ".join(f"{c} IS NOT NULL" for c in [*MEASURE_COLUMNS, SPEND])
_INDEX_TERMS = " + ".join(f"CASE WHEN (SELECT max({c}) - min({c}) FROM full_rows) = 0 THEN 50 ELSE ({c} - (SELECT min({c}) FROM full_rows)) / (SELECT max({c}) - min({c}) FROM full_rows) * 100 END"
                          for c in MEASURE_COLUMNS)
COMPOSITE = f"""{MART}, full_rows AS (SELECT * FROM mart WHERE {_ALL}), idx AS (SELECT *, round(({_INDEX_TERMS}) / {len(MEASURES)}, 1) AS burden_index FROM full_rows)"""
_SINGLE = f"{MART}, both_rows AS (SELECT * FROM mart WHERE {PRIMARY} IS NOT NULL AND {SPEND} IS NOT NULL)"
_POINTS = f"""{_SINGLE}, points AS (SELECT loc, round({PRIMARY}, 2) AS x, round({SPEND}, 2) AS y, {PRIMARY} > (SELECT median({PRIMARY}) FROM both_rows) AS hi,
round((SELECT median({PRIMARY}) FROM both_rows), 2) AS x_median, round((SELECT median({SPEND}) FROM both_rows), 2) AS y_median FROM both_rows)"""


def built(t: Bench) -> mart_build.BuiltMart:
    """The benchmark mart, built and staged once for the facts of one query."""
    return mart_build.build(t.mart_inputs(), t.mart_spec())


def flagship(t: Bench) -> DataFrame:
    """The whole mart as one lazy plan."""
    return marts.build(t.mart_inputs(), t.mart_spec()).withColumn("total_payment", F.round("total_payment", 2))


@query("mart", f"WITH {MART} SELECT * REPLACE (round(total_payment, 2) AS total_payment) FROM mart")
def mart(t: Bench) -> DataFrame:
    return flagship(t)


@query("latest_non_null", f"WITH {_latest_sql('measure_long')} SELECT loc, question_id, value, vintage FROM latest")
def latest_non_null(t: Bench) -> DataFrame:
    rows = marts.usable(t.measure_long, KEY, "value", suppressed=F.col("footnote") == "*")
    return marts.latest_value(rows, [KEY, "question_id"], "yr", "value", YEARS)


@query("mart_measures", f"WITH {_latest_sql('measure_long')} SELECT loc, {_WIDE} FROM latest GROUP BY loc")
def mart_measures(t: Bench) -> DataFrame:
    return marts.measures_wide(marts.usable(t.measure_long, KEY, "value"), KEY, "question_id", "yr", "value", MEASURES, YEARS)


@query("low_coverage", f"""WITH {_mart_sql('measure_sparse')} SELECT question_id, keys_covered FROM ({' UNION ALL '.join(
    f"SELECT '{m}' AS question_id, count({c}) AS keys_covered FROM mart" for m, c in zip(MEASURES, MEASURE_COLUMNS))}) WHERE keys_covered < 20""")
def low_coverage(t: Bench) -> DataFrame:
    wide = marts.measures_wide(marts.usable(t.measure_sparse, KEY, "value"), KEY, "question_id", "yr", "value", MEASURES, YEARS)
    return marts.coverage(joins.spine_join(t.nation.select(F.col("n_nationkey").alias(KEY)), wide, KEY), MEASURES, below=20)


@query("mart_metadata", f"""WITH {MART} SELECT 'population' AS source, count(*) AS n_rows, (SELECT count(*) FROM mart) AS mart_rows, (SELECT count(DISTINCT loc) FROM mart) AS mart_keys FROM population
UNION ALL SELECT 'observations', count(*), (SELECT count(*) FROM mart), (SELECT count(DISTINCT loc) FROM mart) FROM measure_long
UNION ALL SELECT 'payments', count(*), (SELECT count(*) FROM mart), (SELECT count(DISTINCT loc) FROM mart) FROM provider_rows""")
def mart_metadata(t: Bench) -> DataFrame:
    grain = marts.grain(built(t).table, KEY, (99,))
    rows, n_keys = grain.select("row_count").scalar(), grain.select("key_count").scalar()
    return mart_build.source_rows(t.mart_inputs()).select(F.col("table_name").alias("source"), "n_rows", rows.alias("mart_rows"), n_keys.alias("mart_keys"))


@query("derived_ratios", f"WITH {MART} SELECT loc, spend_per_capita, providers_per_100k FROM mart")
def derived_ratios(t: Bench) -> DataFrame:
    return marts.with_ratios(marts.build(t.mart_inputs(), t.mart_spec())).select(KEY, "spend_per_capita", "providers_per_100k")


_BANDS = " UNION ALL ".join(f"SELECT {80002 + i} AS ordinal, 'mart_{c}_band_0_60' AS \"check\", v = 0 AS passed, CAST(v AS VARCHAR) AS value, '0' AS threshold FROM (SELECT count(*) FILTER (WHERE {c} < 0 OR {c} > 60) AS v FROM mart)"
                            for i, c in enumerate(MEASURE_COLUMNS))


_MART_CHECKS = f"""SELECT 80000 AS ordinal, 'mart_row_count' AS "check", count(*) = 25 AS passed, CAST(count(*) AS VARCHAR) AS value, '25' AS threshold FROM mart
UNION ALL SELECT 80001, 'mart_population_positive', v = 0, CAST(v AS VARCHAR), '0' FROM (SELECT count(*) FILTER (WHERE coalesce(population, 0) <= 0) AS v FROM mart)
UNION ALL {_BANDS} UNION ALL SELECT 80100, 'mart_spend_per_capita_nonneg', v = 0, CAST(v AS VARCHAR), '0' FROM (SELECT count(*) FILTER (WHERE coalesce(spend_per_capita, 0) < 0) AS v FROM mart)
UNION ALL SELECT 80101, 'mart_missing_measures_le5', v <= 5, CAST(v AS VARCHAR), '5' FROM (SELECT count(*) FILTER (WHERE NOT ({_ALL} AND population IS NOT NULL)) AS v FROM mart)"""


@query("mart_quality", f"WITH {MART} {_MART_CHECKS}")
def mart_quality(t: Bench) -> DataFrame:
    m = built(t)
    return quality.mart_checks(m.table, m.metadata["spine_rows"], "population", MEASURE_COLUMNS, SPEND, [*MEASURE_COLUMNS, SPEND, "population"]).drop("detail")


_MART_COLUMNS = (KEY, "population", *(c for m, p in zip(MEASURES, MEASURE_COLUMNS) for c in (p, f"{m.lower()}_vintage")),
                 "total_payment", "provider_count", "payment_year", SPEND, "providers_per_100k")
_NEVER_NEGATIVE = tuple(c for c in _MART_COLUMNS if c.endswith(("_pct", "_vintage", "_count")))
# A column of one value has no extreme values and no such check.
_MART_RANGES = " UNION ALL ".join(f"{_extreme_sql('mart', ((i, c),))} WHERE (SELECT stddev_samp({c}) FROM mart) > 0" for i, c in enumerate(_MART_COLUMNS))
_MART_SIGNS = " UNION ALL ".join(f"""SELECT {40000 + 2 * i} AS ordinal, 'no_negatives_{c}' AS "check", b = 0 AS passed, CAST(b AS VARCHAR) AS value, '0' AS threshold,
concat('Column ''{c}'': ', b, ' negative values found') AS detail FROM (SELECT count(*) FILTER (WHERE {c} < 0) AS b FROM mart)""" for i, c in enumerate(_MART_COLUMNS) if c in _NEVER_NEGATIVE)
_OWN = f"""SELECT *, concat(value, CASE WHEN ordinal = 80000 THEN ' rows' WHEN ordinal = 80001 THEN ' keys with non-positive population' WHEN ordinal = 80100 THEN ' keys with negative spend'
WHEN ordinal = 80101 THEN ' keys with a missing measure' ELSE ' keys outside the sanity band' END) AS detail FROM ({_MART_CHECKS})"""


@query("mart_scorecard", f"""WITH {MART}, c AS ({' UNION ALL '.join([_completeness_sql('mart', _MART_COLUMNS), _duplicates_sql('mart', _MART_COLUMNS), _nulls_sql('mart', _MART_COLUMNS),
    _MART_SIGNS, _MART_RANGES, _OWN])}), {_SUMMARY} SELECT c.*, (SELECT score FROM summary) AS score, (SELECT grade FROM summary) AS grade FROM c""")
def mart_scorecard(t: Bench) -> DataFrame:
    """General and mart checks together, with the score and grade they make."""
    checks = stage(built(t).checks(), "mart-checks")
    summary = quality.summarize(checks)
    return checks.select("*", summary.select("score").scalar().alias("score"), summary.select("grade").scalar().alias("grade"))


@query("report_topk", f"""WITH {_SINGLE} SELECT * FROM (SELECT 'top_spend' AS list, loc, {SPEND} AS value FROM both_rows ORDER BY {SPEND} DESC, loc LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'bottom_spend', loc, {SPEND} FROM both_rows ORDER BY {SPEND}, loc LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'top_measure', loc, {PRIMARY} FROM both_rows ORDER BY {PRIMARY} DESC, loc LIMIT 3)""")
def report_topk(t: Bench) -> DataFrame:
    return facts.top_bottom(built(t).table, PRIMARY, SPEND, KEY)


@query("top_bottom_k", """SELECT list, c_custkey, value FROM (SELECT 'top' AS list, c_custkey, c_acctbal AS value FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10)
UNION ALL SELECT list, c_custkey, value FROM (SELECT 'bottom' AS list, c_custkey, c_acctbal AS value FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10)""")
def top_bottom_k(t: Bench) -> DataFrame:
    parts = [facts.ranked(t.customer, "c_acctbal", "c_custkey", 10, largest).select(F.lit(name).alias("list"), "c_custkey", F.col("c_acctbal").alias("value"))
             for name, largest in (("top", True), ("bottom", False))]
    return parts[0].unionByName(parts[1])


@query("report_corr", f"WITH {_SINGLE} SELECT count(*) AS n, round(corr({PRIMARY}, {SPEND}), 3) AS r FROM both_rows")
def report_corr(t: Bench) -> DataFrame:
    return facts.correlation(built(t).table, PRIMARY, SPEND)


@query("quadrant", f"""WITH {_SINGLE} SELECT loc, {PRIMARY}, {SPEND} FROM both_rows WHERE {PRIMARY} > (SELECT median({PRIMARY}) FROM both_rows) AND {SPEND} < (SELECT median({SPEND}) FROM both_rows)""")
def quadrant(t: Bench) -> DataFrame:
    return facts.quadrant(built(t).table, PRIMARY, SPEND).select(KEY, PRIMARY, SPEND)


@query("composite_index", f"WITH {COMPOSITE} SELECT loc, burden_index FROM idx")
def composite_index(t: Bench) -> DataFrame:
    return facts.composite(built(t).table, MEASURE_COLUMNS, SPEND).select(KEY, "burden_index")


@query("composite_top", f"WITH {COMPOSITE} SELECT loc, burden_index, {', '.join(MEASURE_COLUMNS)} FROM idx ORDER BY burden_index DESC, loc LIMIT 3")
def composite_top(t: Bench) -> DataFrame:
    index = facts.composite(built(t).table, MEASURE_COLUMNS, SPEND)
    return facts.ranked(index, "burden_index", KEY, 3).select(KEY, "burden_index", *MEASURE_COLUMNS)


@query("composite_quadrant", f"""WITH {COMPOSITE} SELECT loc, burden_index, {SPEND}, (SELECT round(corr(burden_index, {SPEND}), 3) FROM idx) AS r FROM idx
WHERE burden_index > (SELECT median(burden_index) FROM idx) AND {SPEND} < (SELECT median({SPEND}) FROM idx)""")
def composite_quadrant(t: Bench) -> DataFrame:
    index = stage(facts.composite(built(t).table, MEASURE_COLUMNS, SPEND), "composite")
    r = facts.correlation(index, "burden_index", SPEND).select("r").scalar()
    return facts.quadrant(index, "burden_index", SPEND).select(KEY, "burden_index", SPEND, r.alias("r"))


_HOT = " AND ".join(f"{c} > (SELECT median({c}) FROM full_rows)" for c in MEASURE_COLUMNS[:2])
_FULL2 = f"{MART}, full_rows AS (SELECT * FROM mart WHERE {MEASURE_COLUMNS[0]} IS NOT NULL AND {MEASURE_COLUMNS[1]} IS NOT NULL AND {SPEND} IS NOT NULL)"


@query("multi_hotspots", f"WITH {_FULL2} SELECT loc, {', '.join(MEASURE_COLUMNS[:2])} FROM full_rows WHERE {_HOT}")
def multi_hotspots(t: Bench) -> DataFrame:
    return facts.hotspots(built(t).table, MEASURE_COLUMNS[:2], SPEND).select(KEY, *MEASURE_COLUMNS[:2])


@query("pairwise_corr", f"WITH {COMPOSITE} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 3) AS r FROM full_rows" for a, b in combinations(MEASURE_COLUMNS, 2)))
def pairwise_corr(t: Bench) -> DataFrame:
    return facts.pairwise(built(t).table, MEASURE_COLUMNS, SPEND)


@query("scatter_points", f"WITH {_POINTS} SELECT * FROM points")
def scatter_points(t: Bench) -> DataFrame:
    return facts.scatter(built(t).table, PRIMARY, SPEND, KEY)


def _histogram_sql(source: str, members: str) -> str:
    return f"""b AS (SELECT i AS bin, lo, hi, (CASE WHEN hi = lo THEN 1.0E0 ELSE hi - lo END) / 6 AS w FROM (SELECT min(x) AS lo, max(x) AS hi, count(x) AS n FROM {source}), (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i) WHERE n >= 4),
bounds AS (SELECT bin, lo + bin * w AS a, CASE WHEN bin = 5 THEN hi ELSE lo + (bin + 1) * w END AS z FROM b)
SELECT CAST(bin AS INT) AS bin, round(a, 1) AS lo, round(z, 1) AS hi, count(x) AS members_count{members} FROM bounds LEFT JOIN {source} ON x >= a AND (x < z OR (bin = 5 AND x <= z)) GROUP BY bin, a, z"""


@query("histogram", f"WITH {_POINTS}, {_histogram_sql('points', ', coalesce(string_agg(CAST(loc AS VARCHAR), chr(44) ORDER BY CAST(loc AS VARCHAR)), ' + chr(39) * 2 + ') AS members')}")
def histogram(t: Bench) -> DataFrame:
    return facts.histogram(stage(facts.scatter(built(t).table, PRIMARY, SPEND, KEY), "points"), KEY)


@query("histogram_orders", f"WITH vals AS (SELECT o_totalprice AS x FROM orders), {_histogram_sql('vals', '')}")
def histogram_orders(t: Bench) -> DataFrame:
    return facts.histogram(t.orders.select(F.col("o_totalprice").alias("x")))


@query("anomalies", f"WITH {_POINTS} SELECT loc, x, y, round(x + y, 2) AS total FROM points WHERE x > x_median AND y > y_median ORDER BY round(x + y, 2) DESC, loc LIMIT 3")
def anomalies(t: Bench) -> DataFrame:
    return facts.anomalies(stage(facts.scatter(built(t).table, PRIMARY, SPEND, KEY), "points"), KEY)


def _names(t: Bench) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias(KEY), F.col("n_name").alias("name"))


@query("ranking_bar", f"WITH {_POINTS} SELECT p.loc, n.n_name AS name, p.x AS value, p.hi FROM points p JOIN nation n ON n.n_nationkey = p.loc ORDER BY p.x DESC, p.loc LIMIT 12")
def ranking_bar(t: Bench) -> DataFrame:
    return mart_build.title_rows(facts.scatter(built(t).table, PRIMARY, SPEND, KEY), "x", KEY, _names(t))


@query("spend_ranking", f"WITH {_POINTS} SELECT p.loc, n.n_name AS name, CAST(round(p.y, 0) AS BIGINT) AS value, p.hi FROM points p JOIN nation n ON n.n_nationkey = p.loc ORDER BY p.y DESC, p.loc LIMIT 12")
def spend_ranking(t: Bench) -> DataFrame:
    return mart_build.title_rows(facts.scatter(built(t).table, PRIMARY, SPEND, KEY), "y", KEY, _names(t), whole=True)


_PAIRS = " UNION ALL ".join(f"SELECT {i} AS o, '{a} and {b}' AS subject, round(corr({a}, {b}), 3) AS r FROM full_rows" for i, (a, b) in enumerate(combinations(MEASURE_COLUMNS, 2)))
_WORDING = "CASE WHEN r >= 0.3 THEN 'rises with' WHEN r <= -0.3 THEN 'falls as' ELSE 'barely tracks' END"


@query("findings", f"""WITH {COMPOSITE}, tr AS (SELECT round(corr(burden_index, {SPEND}), 3) AS r FROM idx),
hot AS (SELECT count(*) AS n FROM full_rows WHERE {' AND '.join(f'{c} > (SELECT median({c}) FROM full_rows)' for c in MEASURE_COLUMNS)}), pr AS ({_PAIRS})
SELECT * FROM (SELECT 1 AS ordinal, 'leader' AS kind, CAST(loc AS VARCHAR) AS subject, burden_index AS value FROM idx ORDER BY burden_index DESC, loc LIMIT 1)
UNION ALL SELECT 2, 'trend', {_WORDING}, r FROM tr WHERE r IS NOT NULL UNION ALL SELECT 3, 'hotspots', '', CAST(n AS DOUBLE) FROM hot WHERE n > 0
UNION ALL SELECT * FROM (SELECT 4, 'pair', subject, r FROM pr WHERE abs(r) >= 0.6 ORDER BY o LIMIT 1)""")
def findings(t: Bench) -> DataFrame:
    return facts.findings(built(t).table, MEASURE_COLUMNS, SPEND, KEY)


@query("measure_findings", f"""WITH {_SINGLE}, tr AS (SELECT round(corr({PRIMARY}, {SPEND}), 3) AS r FROM both_rows), q AS (SELECT count(*) AS n FROM both_rows
WHERE {PRIMARY} > (SELECT median({PRIMARY}) FROM both_rows) AND {SPEND} < (SELECT median({SPEND}) FROM both_rows))
SELECT * FROM (SELECT 1 AS ordinal, 'leader' AS kind, CAST(loc AS VARCHAR) AS subject, {PRIMARY} AS value FROM both_rows ORDER BY {PRIMARY} DESC, loc LIMIT 1)
UNION ALL SELECT * FROM (SELECT 2, 'top_spend', CAST(loc AS VARCHAR), round({SPEND}, 0) FROM both_rows ORDER BY {SPEND} DESC, loc LIMIT 1)
UNION ALL SELECT 3, 'trend', {_WORDING}, r FROM tr WHERE r IS NOT NULL UNION ALL SELECT 4, 'watch_quadrant', '', CAST(n AS DOUBLE) FROM q WHERE n > 0""")
def measure_findings(t: Bench) -> DataFrame:
    return facts.measure_findings(built(t).table, PRIMARY, SPEND, KEY)


# --- joinability ---------------------------------------------------------------------------------------

_SPELL = "spellings AS (SELECT lower(n_name) AS spelling FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR) FROM nation)"
# The benchmark tables and one whose keys are spelled in several ways and whose numbers are on topic.
_SOURCES = SCHEMA | {"keyed_customers": ("c_custkey INTEGER", "raw_key VARCHAR", "charge FLOAT", "segment VARCHAR")}
_TEXT_COLUMNS = {t: [c.split()[0] for c in cols if c.endswith("VARCHAR") and c != "embedding VARCHAR"] for t, cols in _SOURCES.items()}


def _candidates_sql(table: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS table_name, {i} AS ordinal, '{c}' AS "column", count(*) AS values_n, count(s.spelling) AS hits
FROM (SELECT DISTINCT lower(trim({c})) AS v FROM {table} WHERE {c} IS NOT NULL) LEFT JOIN spellings s ON s.spelling = v""" for i, c in enumerate(_TEXT_COLUMNS[table]))


_CANDIDATES = " UNION ALL ".join(_candidates_sql(n) for n in _TEXT_COLUMNS if _TEXT_COLUMNS[n])
_BEST = f"""c AS ({_CANDIDATES}), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY hits DESC, ordinal) AS k FROM c WHERE hits > 0 AND hits >= 0.6 * values_n) WHERE k = 1)"""


@query("detect_key_column", f"WITH {_SPELL}, {_BEST} SELECT table_name, ordinal, \"column\", values_n, hits FROM best")
def detect_key_column(t: Bench) -> DataFrame:
    return keys.key_columns(_sources(t), _spellings(t))


def _sources(t: Bench) -> dict[str, DataFrame]:
    return {n: t.table(n) for n in _SOURCES}


def _spellings(t: Bench) -> DataFrame:
    return joins.spellings(t.nation, "n_nationkey", "n_name", "n_nationkey")


def _profile_sql(table: str) -> str:
    topical = str(table == "keyed_customers").upper()
    return f"""SELECT '{table}' AS table_name, (SELECT count(*) FROM {table}) AS n_rows, {len(_SOURCES[table])} AS n_fields,
b."column" AS key_column, coalesce(b.values_n, 0) AS n_keys, b."column" IS NOT NULL AND coalesce(b.values_n, 0) >= 20 AS joinable,
b."column" IS NOT NULL AND coalesce(b.values_n, 0) >= 20 AND {topical} AS relevant,
CASE WHEN b."column" IS NULL THEN 'No key column detected, so it cannot be joined to the mart.'
WHEN NOT {topical} THEN 'A key column and numbers, but nothing related to the mart''s topic.'
WHEN coalesce(b.values_n, 0) < 20 THEN 'Related in content, but it covers too few keys.' ELSE 'Keys to the mart and carries metrics to aggregate per key.' END AS reason
FROM (SELECT 1) one LEFT JOIN (SELECT * FROM best WHERE table_name = '{table}') b ON TRUE"""


_PROFILES = " UNION ALL ".join(_profile_sql(n) for n in _SOURCES)


@query("source_profiles", f"WITH {_SPELL}, {_BEST} {_PROFILES}")
def source_profiles(t: Bench) -> DataFrame:
    return keys.rank_profiles(keys.source_profiles(_sources(t), _spellings(t)))


@query("source_metrics", f"""WITH {_SPELL}, {_BEST}, p AS ({_PROFILES}) SELECT p.table_name, CAST(i AS INT) AS ordinal, m.c AS "column", 'mean' AS aggregation,
concat('average ', replace(m.c, '_', ' '), ' per key') AS meaning FROM p, (VALUES (0, 'c_custkey'), (1, 'charge')) m(i, c) WHERE p.relevant AND p.table_name = 'keyed_customers'""")
def source_metrics(t: Bench) -> DataFrame:
    return keys.source_metrics(_sources(t), keys.source_profiles(_sources(t), _spellings(t)))

"""Read-only SQL: clean the text, parse it, refuse all but queries over known tables, run the rest once."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from martwright import rules
from martwright.functions import text as txt
from martwright.session import pin_utc, rows_seen, stage

# Parsed nodes a plain query consists of; anything else (commands, scripts, streams, hints on files) is refused.
_QUERY_NODES = {
    "Aggregate", "AggregateInPandas", "CTERelationDef", "Distinct", "Except", "Expand", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "Limit", "LocalLimit",
    "LocalRelation", "Offset", "OneRowRelation", "ParameterizedQuery", "Pivot", "Project", "Range", "RepartitionByExpression", "Sample", "Sort", "SubqueryAlias", "Tail", "Transpose", "Union",
    "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedOrdinal", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction",
    "UnresolvedWith", "Unpivot", "Window", "WithCTE", "WithWindowDefinition",
}
# Groups of built-in functions that compute from their arguments alone; "misc_funcs", with calls into Java and what tells of the machine, is not one.
_FUNCTION_GROUPS = {"agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs", "datetime_funcs", "generator_funcs", "hash_funcs",
                    "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "url_funcs", "variant_funcs", "window_funcs", "xml_funcs"}
_MORE_FUNCTIONS = {"typeof"}
# What a resolved query is made of besides those functions.
_EXPRESSIONS = {
    "AggregateExpression", "Alias", "AttributeReference", "Between", "Cast", "CheckOverflow", "Collate", "CommonExpressionDef", "CommonExpressionRef", "CreateNamedStruct", "CurrentRow$", "DateAddInterval", "DateAddYMInterval", "DivideDTInterval",
    "DivideYMInterval", "Exists", "ExtractIntervalDays", "GetArrayItem", "GetArrayStructFields", "GetMapValue", "GetStructField", "InSubquery", "Invoke", "KnownNotNull", "LambdaFunction", "LateralSubquery",
    "ListQuery", "Literal", "MultiplyDTInterval", "MultiplyYMInterval", "NamedLambdaVariable", "OuterReference", "RowFrame$", "RangeFrame$", "ScalarSubquery", "SortOrder", "SpecialFrameBoundary", "SpecifiedWindowFrame",
    "StaticInvoke", "SubtractDates", "SubtractTimestamps", "TimeAdd", "TimestampAddInterval", "TimestampAddYMInterval", "TryEval", "UnboundedFollowing$", "UnboundedPreceding$", "UnresolvedNamedLambdaVariable",
    "UnspecifiedFrame$", "WindowExpression", "WindowSpecDefinition", "With",
}
# What functions resolve to that are registered through builders.
_BUILT = {
    "BinaryPad", "Ceil", "Contains", "CurrentDate", "EndsWith", "Explode", "Floor", "GeneratorOuter", "Hour", "Inline", "MakeTimestamp", "Mask", "Minute", "Mode", "ParseJson", "ParseToDate", "ParseToTimestamp",
    "PercentileCont", "PercentileDisc", "PosExplode", "RoundCeil", "RoundFloor", "Second", "SecondWithFraction", "StartsWith", "StringLPad", "StringRPad", "ToCharacter", "VariantGet",
}
_PLANS = {
    "Aggregate", "CTERelationDef", "CTERelationRef", "Deduplicate", "Distinct", "Except", "Expand", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset",
    "OneRowRelation", "Project", "Range", "RepartitionByExpression", "ResolvedHint", "Sample", "Sort", "SubqueryAlias", "Tail", "Union", "Window", "WithCTE",
}
_SUBQUERIES = ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression")
_ALLOWED_FUNCTIONS: dict[str, tuple[set[str], set[str]]] = {}


@dataclass
class ConsoleResult:
    """Outcome of one statement: refused, failed, or rows."""

    ok: bool
    sql: str
    rejected: bool = False
    reason: str = ""
    rows: DataFrame | None = None
    row_count: int = 0
    elapsed_ms: float = 0.0

    @property
    def columns(self) -> list[str]:
        return self.rows.columns if self.rows is not None else []


def review(spark: SparkSession, raw: str) -> tuple[str, str]:
    """The cleaned statement and the reason its words rule it out (empty when they don't)."""
    cleaned = txt.clean_sql(F.lit(raw))
    seen = spark.range(1).select(cleaned.alias("sql"), txt.sql_rejection(cleaned).alias("reason")).first()
    return seen["sql"], seen["reason"]


def _items(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _simple(node) -> str:
    return node.getClass().getName().rpartition(".")[2]


def _functions(session: SparkSession) -> tuple[set[str], set[str]]:
    """Names of the built-in functions a statement may call, and the expression classes they resolve to."""
    app = session.sparkContext.applicationId
    if app not in _ALLOWED_FUNCTIONS:
        analysis = session._jvm.org.apache.spark.sql.catalyst.analysis
        found = [(pair._1(), pair._2()._1()) for registry in (analysis.FunctionRegistry.expressions(), analysis.TableFunctionRegistry.logicalPlans()) for pair in _items(registry.toSeq())]
        fine = [(name.lower(), info) for name, info in found if info.getGroup() in _FUNCTION_GROUPS or name in _MORE_FUNCTIONS or name in ("range", "explode", "posexplode", "inline", "stack", "json_tuple")]
        _ALLOWED_FUNCTIONS[app] = ({name for name, _ in fine}, {info.getClassName().rpartition(".")[2] for _, info in fine})
    return _ALLOWED_FUNCTIONS[app]


def _nodes(plan, plans) -> Iterator:
    """A plan's nodes and their expressions, those of subqueries and of WITH included; a view's own definition is not looked into."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        name = _simple(node)
        if name == "View":
            continue
        todo += _items(node.children())
        if name in _SUBQUERIES:
            todo.append(node.plan())
        if name == "UnresolvedWith":
            todo += (pair._2() for pair in _items(node.cteRelations()))
        elif name == "WithCTE":
            todo += _items(node.cteDefs())
        elif plans.isInstance(node):
            todo += _items(node.expressions())


def _plan_class(session: SparkSession):
    return session._jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan")


def refusal(session: SparkSession, sql: str, tables: Mapping[str, DataFrame]) -> str:
    """Why a statement is more than a query over known tables, by its parsed form; nothing runs.

    Every plan node must be one a query is made of, every relation one of ``tables``, of the statement's own WITH names
    or of the catalogue, every name written out, and every function a built-in one that computes from its arguments alone.
    """
    plans = _plan_class(session)
    parsed = list(_nodes(session._jsparkSession.sessionState().sqlParser().parsePlan(sql), plans))
    known, _ = _functions(session)
    own = {name.lower() for name in tables}
    for node in parsed:
        if _simple(node) == "UnresolvedWith":
            own |= {pair._1().lower() for pair in _items(node.cteRelations())}
    for node in parsed:
        name = _simple(node)
        if "UnresolvedIdentifier" in name:
            return "Names must be written out: IDENTIFIER is not allowed"
        if plans.isInstance(node) and name not in _QUERY_NODES:
            return f"Only queries are allowed: {name}"
        if name == "UnresolvedRelation":
            path = list(_items(node.multipartIdentifier()))
            if not (len(path) == 1 and path[0].lower() in own) and not session.catalog.tableExists(".".join(f"`{p.replace('`', '``')}`" for p in path)):
                if len(path) > 1 or any(c in path[0] for c in "/\\:"):
                    return "Only tables of the catalogue are allowed"
        if name in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
            path = [p.lower() for p in _items(node.nameParts() if name == "UnresolvedFunction" else node.name())]
            if path[-1] not in known or len(path) > 1:
                return f"Function is not allowed: {path[-1]}"
    return ""


def resolved_refusal(df: DataFrame) -> str:
    """Why a resolved statement is more than a query: a relation or expression outside of what is allowed, however it was written.

    Views, and tables of the catalogue, are taken as they are.
    """
    session = df.sparkSession
    plans, (_, classes) = _plan_class(session), _functions(session)
    for node in _nodes(df._jdf.queryExecution().analyzed(), plans):
        name = _simple(node)
        if not plans.isInstance(node):
            if name not in _EXPRESSIONS and name not in _BUILT and name not in classes:
                return f"Expression is not allowed: {name}"
        elif name == "LogicalRelation":
            if node.catalogTable().isEmpty():
                return "Only tables of the catalogue are allowed"
        elif name not in _PLANS and name not in ("View", "HiveTableRelation"):
            return f"Only queries are allowed: {name}"
    return ""


def run_readonly(spark: SparkSession, raw: str, tables: Mapping[str, DataFrame] | None = None,
                 max_rows: int = rules.CONSOLE_MAX_ROWS) -> ConsoleResult:
    """Run one SELECT in a session of its own, over the catalogue and the given tables.

    It is looked at twice before anything runs: as parsed, and as resolved against the tables.
    In that session files can't be named as tables.  The statement runs once: its rows are staged in their order and
    counted by the write, ``rows`` reads the first ``max_rows`` of them back.
    """
    tables = tables or {}
    sql, reason = review(spark, raw)
    if reason:
        return ConsoleResult(False, sql, rejected=True, reason=reason)
    session = spark.newSession()
    pin_utc(session)
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    clock = time.monotonic()
    shared = {name: f"console_{uuid.uuid4().hex}" for name in tables}
    try:
        if reason := refusal(session, sql, tables):
            return ConsoleResult(False, sql, rejected=True, reason=reason)
        for name, alias in shared.items():
            tables[name].createOrReplaceGlobalTempView(alias)
            session.sql(f"CREATE OR REPLACE TEMPORARY VIEW `{name}` AS SELECT * FROM global_temp.{alias}")
        df = session.sql(sql)
        if reason := resolved_refusal(df):
            return ConsoleResult(False, sql, rejected=True, reason=reason)
        seen, names = Observation(), df.columns
        plain = df.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("place", F.monotonically_increasing_id())
        staged = stage(plain.observe(seen, F.count(F.lit(1)).alias("n")), "console")
        count = rows_seen(seen)
    except PySparkException as problem:
        return ConsoleResult(False, sql, reason=f"Spark error: {str(problem).splitlines()[0]}")
    finally:
        for alias in shared.values():
            spark.catalog.dropGlobalTempView(alias)
    rows = staged.orderBy("place").limit(max_rows).drop("place").toDF(*names)
    return ConsoleResult(True, sql, rows=rows, row_count=count, elapsed_ms=round((time.monotonic() - clock) * 1000, 1))

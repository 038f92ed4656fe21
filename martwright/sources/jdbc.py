"""Database reads: options per engine, a row limit the server applies, parallel reads on request."""

from __future__ import annotations

from urllib.parse import quote_plus

from pyspark.sql import DataFrame, SparkSession

from martwright import rules


def jdbc_options(engine: str, host: str = "localhost", port: int | None = None, database: str = "", user: str | None = None,
                 password: str | None = None, account: str = "", schema: str = "PUBLIC", warehouse: str = "") -> dict[str, str]:
    """Options of ``spark.read.format('jdbc')`` for a known engine.  The password is never part of the URL."""
    if engine not in rules.JDBC_ENGINES:
        raise ValueError(f"unknown engine: {engine!r}")
    template, default_port = rules.JDBC_ENGINES[engine]
    url = template.format(host=host, port=port or default_port, database=database, account=account,
                          schema=quote_plus(schema), warehouse=quote_plus(warehouse))
    options = {"url": url}
    if user:
        options["user"] = user
    if password:
        options["password"] = password
    return options


def metadata(options: dict[str, str]) -> dict[str, str]:
    """What may be shown or stored about a connection."""
    return {k: v for k, v in options.items() if k not in ("password", "user")}


def limited(engine: str, source: str, max_rows: int) -> str:
    """A derived table of at most ``max_rows`` rows, in the engine's own words."""
    if engine == "sqlserver":
        return f"(SELECT TOP ({max_rows}) * FROM {source}) limited_rows"
    if engine == "oracle":
        return f"(SELECT * FROM {source} FETCH FIRST {max_rows} ROWS ONLY) limited_rows"
    return f"(SELECT * FROM {source} LIMIT {max_rows}) limited_rows"


def read_table(spark: SparkSession, engine: str, options: dict[str, str], table: str, max_rows: int | None = None,
               partition_column: str | None = None, lower: object = None, upper: object = None, partitions: int = 16) -> DataFrame:
    """A whole table, in parallel ranges of ``partition_column`` if given; at most ``max_rows`` rows, by the server, only if asked for."""
    reader = spark.read.format("jdbc").options(**table_options(engine, table, max_rows, partition_column, lower, upper, partitions), **options)
    return reader.load()


def table_options(engine: str, table: str, max_rows: int | None = None, partition_column: str | None = None, lower: object = None,
                  upper: object = None, partitions: int = 16) -> dict[str, str]:
    """What to read, with the limit inside the source, so that it holds for parallel ranges too."""
    chosen = {"dbtable": table if max_rows is None else limited(engine, table, max_rows)}
    if partition_column:
        chosen |= {"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions)}
    return chosen


def read_query(spark: SparkSession, options: dict[str, str], sql: str, max_rows: int | None = None) -> DataFrame:
    """The result of one query; at most ``max_rows`` rows only if asked for."""
    df = spark.read.format("jdbc").options(**options).option("query", sql).load()
    return df if max_rows is None else df.limit(max_rows)


def capped(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """At most ``max_rows`` rows, and whether there are more: read one more than wanted, then call this."""
    return df.limit(max_rows), df.limit(max_rows + 1).count() > max_rows

"""Reads that keep going: broken rows go to a quarantine, unreadable files become rows of a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright.session import stage
from martwright.sources import files

FAILURES = "file string, length long, reason string"
#: A parquet file without rows is its footer alone; no footer is larger than this.
FOOTER_BYTES = 8 << 20
_MAGIC = b"PAR1"


@dataclass
class Tolerant:
    """What could be read, what could not, and how much of each.

    ``quarantined`` holds ``file`` and ``record`` (the text as it stands) of every row that does not fit the schema;
    ``failures`` holds ``file``, ``length`` and ``reason`` of every file that gives none of its rows to ``rows``.
    """

    rows: DataFrame
    quarantined: DataFrame
    failures: DataFrame
    n_rows: int
    n_broken: int


def _file(name: str = "file") -> Column:
    return F.col("_metadata.file_path").alias(name)


def _spare_name(schema: T.StructType) -> str:
    taken, name = {f.name.lower() for f in schema}, "_broken"
    while name in taken:
        name += "_"
    return name


def _split(spark: SparkSession, read, schema: T.StructType) -> Tolerant:
    """One pass stages the rows that don't fit, and counts both kinds; the rows that do are read where they are asked for."""
    mark = _spare_name(schema)
    # The readers parse, and so test, only the columns a query refers to: this refers to all and holds for every row.
    tested = F.array_position(F.array(*[F.col(f"`{f.name}`").isNull() for f in schema]), True) >= 0
    whole = read(T.StructType([*schema, T.StructField(mark, T.StringType())]), mark)
    seen = Observation()
    counted = whole.select("*", _file("_file_of_row")).observe(seen, F.count(F.lit(1)).alias("n"), F.count(mark).alias("broken"))
    broken = stage(counted.where(F.col(mark).isNotNull() & tested).select(F.col("_file_of_row").alias("file"), F.col(mark).alias("record")), "quarantine")
    n, bad = int(seen.get["n"]), int(seen.get["broken"])
    rows = whole.where(F.col(mark).isNull() & tested).drop(mark)
    return Tolerant(rows, broken, spark.createDataFrame([], FAILURES), n - bad, bad)


def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType, multi_line: bool = False, **options) -> Tolerant:
    """CSV or TSV with a header.  A row with a value that is not of its column's type, or with too few or too many values, is broken.

    Which rows are broken does not depend on the columns asked for later.  Blank lines are no rows; an empty table gives none.
    """
    typed = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def read(with_mark: T.StructType, mark: str) -> DataFrame:
        return files.read_delimited(spark, path, with_mark, multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord=mark, columnPruning=False, **options)

    return _split(spark, read, typed)


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType, **options) -> Tolerant:
    """One object per line.  A line that is no object, or holds a value that is not of its column's type, is broken; absent members are null."""
    typed = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def read(with_mark: T.StructType, mark: str) -> DataFrame:
        return spark.read.schema(with_mark).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", mark).options(**options).json(path)

    return _split(spark, read, typed)


def read_parquet(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> Tolerant:
    """Parquet of which some files may be cut off or damaged.

    A file fails as a whole: without a readable footer, or when fewer rows can be decoded than its footer promises.  To know
    the latter all columns are decoded once, beside a pass over the footers.  Files without rows are no failures.
    """
    reader = spark.read.option("ignoreCorruptFiles", True)
    if schema is None:
        try:
            schema = reader.parquet(path).schema
        except AnalysisException as problem:
            if problem.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            schema = T.StructType([])
    reader = reader.schema(schema)
    listed = spark.read.format("binaryFile").load(path).select(_file(), "length")
    all_rows = reader.parquet(path)
    promised = all_rows.select(_file()).groupBy("file").agg(F.count(F.lit(1)).alias("promised"))
    cells = [F.count(F.col(f"`{c}`")) for c in all_rows.columns]
    decoded = all_rows.select("*", _file("_file_of_row")).groupBy(F.col("_file_of_row").alias("file")).agg(
        F.count(F.lit(1)).alias("decoded"), sum(cells, F.lit(0).cast("long")).alias("cells"))
    told = stage(listed.join(promised, "file", "left").join(decoded, "file", "left"), "files_read")

    silent = told.where("promised is null")
    # Names of files without rows: never more than the listing of the path, which the driver holds anyway.
    small = [r["file"] for r in silent.where(F.col("length") <= FOOTER_BYTES).select("file").collect()]
    if small:
        ends = spark.read.format("binaryFile").load(small).where(F.substring("content", -len(_MAGIC), len(_MAGIC)) == F.lit(_MAGIC))
        silent = silent.join(ends.select(_file()), "file", "left_anti")
    early = told.where("coalesce(decoded, 0) < promised")
    no_footer = silent.select("file", "length", F.lit("no readable footer").alias("reason"))
    cut = early.select("file", "length", F.concat(F.lit("only "), F.coalesce("decoded", F.lit(0)).cast("string"), F.lit(" of "), F.col("promised").cast("string"), F.lit(" rows can be read")).alias("reason"))
    failures = stage(no_footer.union(cut), "failed_files")
    n = told.join(failures, "file", "left_anti").agg(F.coalesce(F.sum("promised"), F.lit(0)).alias("n")).first()["n"]
    keys = failures.select(F.col("file").alias("_failed_file"))
    rows = all_rows.select("*", _file("_file_of_row")).join(keys, F.col("_file_of_row") == F.col("_failed_file"), "left_anti").drop("_file_of_row")
    return Tolerant(rows, spark.createDataFrame([], "file string, record string"), failures, n, 0)

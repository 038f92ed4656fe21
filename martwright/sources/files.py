"""File and object-store reads that end in a DataFrame or in an empty one with the reason."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright import rules
from martwright.session import rows_seen

SEPARATORS = (",", "\t", ";", "|")


@dataclass
class Extract:
    """One read: the rows, or why there are none, and the bookkeeping of the source."""

    df: DataFrame
    name: str
    source_type: str = "file"
    error: str | None = None
    extracted_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    _seen: Observation | None = None

    def counted(self) -> DataFrame:
        """The rows, counted inside whichever job reads them.

        Kept apart from ``df``: an observed plan would keep later filters from reaching the scan.
        """
        self._seen = Observation()
        return self.df.observe(self._seen, F.count(F.lit(1)).alias("n"))

    @property
    def record_count(self) -> int:
        """Rows seen by the job that consumed ``counted()``; -1 before."""
        return rows_seen(self._seen) if self._seen is not None and _finished(self._seen) else -1

    def metadata(self) -> dict[str, object]:
        return {"name": self.name, "source_type": self.source_type,
                "last_extract_time": self.extracted_at.isoformat(), "last_record_count": self.record_count}


def _finished(observation: Observation, wait_seconds: float = 1.0) -> bool:
    """Whether a job has reported; reports arrive shortly after their job ends."""
    deadline = time.monotonic() + wait_seconds
    while observation._jo is not None and not observation._jo.future().isCompleted():
        if time.monotonic() > deadline:
            return False
        time.sleep(0.02)
    return observation._jo is not None


def _nothing(spark: SparkSession, name: str, error: str) -> Extract:
    return Extract(spark.createDataFrame([], T.StructType([])), name, error=error)


@dataclass(frozen=True)
class Shape:
    """What one pass over all lines of a text file tells."""

    separator: str
    encoding: str


def shape(spark: SparkSession, path: str) -> Shape:
    """Separator and encoding, in one pass over every line.

    The separator is the candidate that occurs equally often on every line, else the one no line lacks or that is most
    frequent; UTF-8 unless some line is not, then Latin-1 (which accepts any byte).
    """
    n = [F.length("value") - F.length(F.replace("value", F.lit(s), F.lit(""))) for s in SEPARATORS]
    seen = spark.read.text(path).agg(
        F.count_if(~F.is_valid_utf8("value")).alias("broken"),
        *[f(c).alias(f"{tag}{i}") for i, c in enumerate(n) for tag, f in (("lo", F.min), ("hi", F.max), ("sum", F.sum))]).first()
    score = {s: (seen[f"lo{i}"] == seen[f"hi{i}"], seen[f"lo{i}"] or 0, seen[f"sum{i}"]) for i, s in enumerate(SEPARATORS) if (seen[f"hi{i}"] or 0) > 0}
    return Shape(max(score, key=score.get) if score else ",", "ISO-8859-1" if seen["broken"] else "UTF-8")


def read_delimited(spark: SparkSession, path: str, schema=None, multi_line: bool = False, **options) -> DataFrame:
    """CSV or TSV with a header; what the caller leaves open of separator and encoding is found from the file.

    Without ``multi_line`` big files split across tasks; set it when quoted values hold line breaks.
    """
    found = None if {"sep", "encoding"} <= options.keys() else shape(spark, path)
    reader = (spark.read.option("header", True).option("sep", options.pop("sep", None) or found.separator)
              .option("encoding", options.pop("encoding", None) or found.encoding)
              .option("quote", '"').option("escape", '"').option("multiLine", multi_line).options(**options))
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def json_layouts(spark: SparkSession, path: str) -> dict[bool, list[str]]:
    """The files of a path by layout: True for one object per line, False for one document per file; by all their lines."""
    line = F.trim("value")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), line.alias("line")).where("line <> ''")
    whole = F.col("line").startswith("{") & F.col("line").endswith("}")
    files = lines.groupBy("file").agg(F.count_if(~whole).alias("parts"), F.count(F.lit(1)).alias("n"), F.min("line").alias("line"))
    out: dict[bool, list[str]] = {}
    for r in files.orderBy("file").collect():
        by_line = r["parts"] == 0 and not (r["n"] == 1 and _is_column_lists(spark, r["line"]))
        out.setdefault(by_line, []).append(r["file"])
    return out


def read_json(spark: SparkSession, path: str, schema=None, lines: bool | None = None) -> DataFrame:
    """Record arrays, JSON lines, or objects of column lists.

    Each file's layout is decided by its own lines, or for all by ``lines``; files of different layouts are read apart and
    united by column name.  A file that is one document is one task.
    """
    layouts = json_layouts(spark, path) if lines is None else {lines: [path]}
    parts = []
    for by_line, files in sorted(layouts.items()):
        reader = spark.read.option("multiLine", not by_line)
        df = reader.schema(schema).json(files) if schema is not None else reader.json(files)
        if all(isinstance(f.dataType, T.ArrayType) for f in df.schema) and df.columns and not by_line:
            df = df.select(F.inline(F.arrays_zip(*[F.col(f"`{c}`") for c in df.columns])))
        parts.append(df)
    if not parts:
        return spark.read.json(path)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _is_column_lists(spark: SparkSession, line: str) -> bool:
    """A single object on one line whose every member is a list."""
    shape_of = spark.range(1).select(F.schema_of_json(F.lit(line)).alias("s")).first()["s"]
    kinds = [f.dataType for f in T._parse_datatype_string(shape_of)]
    return bool(kinds) and all(isinstance(t, T.ArrayType) for t in kinds)


def load(spark: SparkSession, path: str, **options) -> Extract:
    """Read by suffix.  A missing file, an unknown suffix or an unreadable file gives an empty extract."""
    name = re.sub(r"\.[^.]*$", "", path.rstrip("/").rsplit("/", 1)[-1])
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    readers = {"csv": read_delimited, "tsv": read_delimited, "json": read_json,
               "parquet": lambda s, p, **kw: s.read.options(**kw).parquet(p)}
    if suffix not in readers:
        return _nothing(spark, name, f"unsupported suffix: {suffix}")
    try:
        df = readers[suffix](spark, path, **options)
    except Exception as problem:  # every reader failure is reported, never raised
        return _nothing(spark, name, str(problem).splitlines()[0])
    return Extract(df, name)


# --- object stores ---------------------------------------------------------------------------------


def parse_uri(uri: str) -> dict[str, str]:
    """Scheme, bucket and key of an object-store URI."""
    match = re.match(rules.OBJECT_URI_PATTERN, uri)
    if not match:
        raise ValueError(f"not an object-store URI: {uri!r}")
    return {"scheme": match[1].lower(), "bucket": match[2], "key": match[3]}


def uri_parts(c: Column, schemes: str = "s3|gs|az") -> list[Column]:
    """Scheme, bucket and key of a column of URIs; null where the text is not one."""
    pattern = rf"(?i)^({schemes})://([^/]+)/(.+)$"
    part = [F.when(c.rlike(pattern), F.regexp_extract(c, pattern, i)) for i in (1, 2, 3)]
    return [F.lower(part[0]).alias("scheme"), part[1].alias("bucket"), part[2].alias("key")]


def hadoop_path(uri: str, account: str | None = None) -> str:
    """The path Spark reads the object with, in place."""
    part = parse_uri(uri)
    host = part["bucket"]
    if part["scheme"] == "az" and account:
        host = f"{host}@{account}.dfs.core.windows.net"
    return f"{rules.HADOOP_SCHEMES[part['scheme']]}://{host}/{part['key']}"


def load_uri(spark: SparkSession, uri: str, account: str | None = None, **options) -> Extract:
    """Read an object by URI, in place."""
    return load(spark, hadoop_path(uri, account), **options)

"""Small tables that are replaced as a whole: every version is a folder, and a numbered manifest names the one that counts.

A commit writes its rows first and then renames a finished manifest to the next number, which the store refuses if
another commit took it.  Readers keep the version they opened; a commit that fails leaves everything as it was.  On object stores
without a refusing rename, commits of one table have to come from one application at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.operators import history
from martwright.session import drop_path

#: Versions kept for readers that opened them, the newest included.
KEPT = 3


class Conflict(RuntimeError):
    """Another commit took the number; read again and try again."""


def _store(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def numbers(spark: SparkSession, home: str) -> list[int]:
    """Numbers of the manifests that are there, ascending."""
    store, path = _store(spark, f"{home}/manifest")
    if not store.exists(path):
        return []
    names = [status.getPath().getName() for status in store.listStatus(path)]
    return sorted(int(n) for n in names if n.isdigit())


def _folder_of(spark: SparkSession, home: str, number: int) -> str:
    return f"{home}/" + spark.read.text(f"{home}/manifest/{number:012d}").first()["value"]


def read(spark: SparkSession, home: str, number: int | None = None) -> DataFrame | None:
    """The newest version, or one by number; None where nothing was ever committed."""
    there = numbers(spark, home)
    if not there:
        return None
    return spark.read.parquet(_folder_of(spark, home, there[-1] if number is None else number))


def commit(df: DataFrame, home: str, after: int | None = None) -> int:
    """Write ``df`` as the version after ``after`` (the newest if left open) and return its number.

    Raises ``Conflict`` when that number is taken; rows written for nothing are deleted, here and when writing fails.
    """
    spark = df.sparkSession
    if after is None:
        after = max(numbers(spark, home), default=0)
    folder, number = f"rows-{uuid.uuid4().hex}", after + 1
    try:
        df.write.parquet(f"{home}/{folder}")
        _switch(spark, home, folder, number)
    except BaseException:
        drop_path(spark, f"{home}/{folder}")
        raise
    for old in numbers(spark, home)[:-KEPT]:
        rows = _folder_of(spark, home, old)
        drop_path(spark, f"{home}/manifest/{old:012d}")
        drop_path(spark, rows)
    return number


def _switch(spark: SparkSession, home: str, folder: str, number: int) -> None:
    store, manifest = _store(spark, f"{home}/manifest/{number:012d}")
    _, draft = _store(spark, f"{home}/manifest/_draft-{folder}")
    out = store.create(draft, False)
    out.write(bytearray(folder.encode()))
    out.close()
    # A rename onto a file that is there fails or returns False, by the kind of store; local disks would overwrite it.
    if store.exists(manifest) or not store.rename(draft, manifest):
        store.delete(draft, False)
        raise Conflict(f"version {number} of {home} is taken")


def upsert(new: DataFrame, home: str, key: str = "table_name", tries: int = 5,
           merge: Callable[[DataFrame, DataFrame, str], DataFrame] = history.upsert_registry) -> int:
    """Entries of ``new`` replace those of the same key in the stored table; the number of the version that holds them.

    Of commits at the same time one goes first and the others merge with it anew.
    """
    spark = new.sparkSession
    for left in range(tries, 0, -1):
        there = numbers(spark, home)
        after = there[-1] if there else 0
        merged = merge(read(spark, home, after), new, key) if there else new
        try:
            return commit(merged, home, after)
        except Conflict:
            if left == 1:
                raise
    raise ValueError("tries must be positive")

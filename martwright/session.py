"""Session set-up and the one way this package materialises intermediate results.

Intermediate tables that several jobs read are written once as parquet into the
folder all executors share, then read back.  A lost executor re-reads a file; it
never re-runs the lineage behind it, and column pruning still applies.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
SHUFFLES_GO_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STAGE_SUBDIR = "martwright_stage"
_LOCAL_FOLDERS: dict[str, str] = {}
_OWNED: set[str] = set()
_SCOPES: list[list[str]] = []
_STAGED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def get_session(app_name: str = "martwright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; cluster settings win over these."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        # Recording a call site per column expression costs more than planning a wide query.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> None:
    """Wall-clock timestamps are compared as UTC everywhere."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a temporary folder and a cluster its warehouse, but only if that lies in a
    shared store: a ``file:`` warehouse is another disk on every machine.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if folder:
        return folder.rstrip("/")
    if not is_local(spark.sparkContext.master):
        return shared_warehouse(spark)
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="martwright-")
    return _LOCAL_FOLDERS[app]


def shared_warehouse(spark: SparkSession) -> str:
    """The warehouse, refused on a cluster where neither its scheme nor ``spark.checkpoint.dir`` beside it tells that it is shared."""
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    given = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not given and not is_local(spark.sparkContext.master) and not re.match(r"(?!file:)[a-z0-9+.-]+:", warehouse, re.IGNORECASE):
        raise RuntimeError(f"set {CHECKPOINT_KEY}: {warehouse} is not shared by the executors")
    return warehouse


def is_local(master: str) -> bool:
    """Whether driver and executors are one process (``local-cluster`` is not)."""
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def stage_folder(spark: SparkSession) -> str:
    """Where this application stages; it goes when the application ends."""
    folder = f"{shared_folder(spark)}/{_STAGE_SUBDIR}/{spark.sparkContext.applicationId}"
    if folder not in _OWNED:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _OWNED.add(folder)
    return folder


def stage_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the application's stage folder; no two calls share one."""
    return f"{stage_folder(spark)}/{label}-{uuid.uuid4().hex}"


def rows_seen(observation: Observation) -> int:
    """The ``n`` metric of a finished job; 0 when the optimizer planned a known-empty input away with its metric."""
    try:
        return int(observation.get["n"])
    except Py4JJavaError:
        return 0


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is staged inside goes at the end, except what was staged to outlive it or is handed to the function that the scope gives.

    A caller that returns a DataFrame over staged tables stages its result with ``outlive``; scopes nest, and outside of
    every scope a staged table stays until the application ends.
    """
    own: list[str] = []

    def keep(table: DataFrame) -> DataFrame:
        """A table that ``stage`` returned goes with the scope around this one; one from outside stays as it is."""
        if (path := _STAGED.get(table)) in own:
            own.remove(path)
            if _SCOPES[:-1]:
                _SCOPES[-2].append(path)
        return table

    _SCOPES.append(own)
    try:
        yield keep
    finally:
        for path in _SCOPES.pop():
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of any store Spark reaches; nothing happens if it is not there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_staged(table: DataFrame) -> None:
    """Delete a table that ``stage`` returned and that nothing reads any more; any other DataFrame is left alone."""
    if path := _STAGED.pop(table, None):
        drop_path(table.sparkSession, path)


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is run inside go with its end, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLES_GO_KEY, None)
    spark.conf.set(SHUFFLES_GO_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO_KEY) if before is None else spark.conf.set(SHUFFLES_GO_KEY, before)


def stage(df: DataFrame, label: str = "stage", outlive: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder as parquet and return a DataFrame that reads it.

    Inside a ``stage_scope`` the table goes when the scope ends; with ``outlive`` it goes with the scope around that one.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    owners = _SCOPES[:-1] if outlive else _SCOPES
    if owners:
        owners[-1].append(path)
    with _shuffles_go(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _STAGED[table] = path
    return table

"""Session defaults and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# While this is on, a join deals both sides out by all of its keys, even if they lie together by some of them already.
ALL_JOIN_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"

_folder: contextvars.ContextVar[str | None] = contextvars.ContextVar("folder", default=None)


def build_session(app: str = "segrisk", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on (UTC, adaptive execution, ANSI)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.ansi.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as named by the cluster in ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; on a cluster the setting is required,
    because a folder of one machine is lost with it.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    return _local_folder(spark.sparkContext.applicationId)


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"segrisk-{application}-")


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/segrisk/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in the folder of the innermost ``temporary`` block."""
    return f"{_folder.get() or _session_folder(spark)}/{uuid.uuid4().hex}/{name}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete every table that this session has written to the shared folder.

    To be called when no result is read any more, before the session stops.
    """
    _delete(spark, _session_folder(spark))


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are materialised inside are deleted at the end of the block.

    The block gets a function like ``materialise`` that writes outside of it, for the results. Blocks may be nested;
    a result then belongs to the block around.
    """
    outer = _folder.get()
    inner = f"{outer or _session_folder(spark)}/{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        own = _folder.set(outer)
        try:
            return materialise(df, name)
        finally:
            _folder.reset(own)

    token = _folder.set(inner)
    try:
        yield keep
    finally:
        _folder.reset(token)
        _delete(spark, inner)


@contextmanager
def _dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when their query ends; a table that is written once needs them no longer."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and continue from the table.

    Used before iterative work. It cuts the lineage, survives the loss of executors, keeps column pruning and
    filter pushdown for the readers, and gives the planner real sizes.
    """
    path = new_path(df.sparkSession, name)
    with _dropping_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_all(**tables: DataFrame) -> list[DataFrame]:
    """``materialise`` for several independent tables, written at the same time."""
    spark = next(iter(tables.values())).sparkSession
    write = inheritable_thread_target(spark)(materialise)
    jobs = [(contextvars.copy_context(), df, name) for name, df in tables.items()]
    with _dropping_shuffles(spark), ThreadPool(len(tables)) as pool:
        return pool.starmap(lambda context, df, name: context.run(write, df, name), jobs)

"""Tables written to the folder that driver and executors share.

A written table cuts lineage, survives lost executors, is columnar and compressed, and gives
the planner its size, so that Spark's own broadcast threshold applies to what is joined with it.
Once it is written, nobody reads the shuffles that made it: Spark drops their files at once.
"""

from __future__ import annotations

import atexit
import contextlib
import threading
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
_SCOPE: ContextVar[list[tuple[SparkSession, str]]] = ContextVar("scope", default=_WRITTEN)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_WRITING: dict[int, tuple[int, str | None]] = {}  # by session: writes that run, and its own setting


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; without it, a local session uses its warehouse folder, a cluster refuses."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the scope or else the session's process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _SCOPE.get().append((spark, path))
    return path


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written inside are removed when it ends. It gives a ``written`` whose table stays, as one of the scope
    around it: whatever leaves a scope must read no other table of it."""
    own: list[tuple[SparkSession, str]] = []
    outer = _SCOPE.get()

    def keep(df: DataFrame, name: str) -> DataFrame:
        inner = _SCOPE.set(outer)
        try:
            return written(df, name)
        finally:
            _SCOPE.reset(inner)

    token = _SCOPE.set(own)
    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        _delete(own)


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside drop their shuffle files when they end. Of writes that overlap in a session, the last to
    end puts the session's own setting back."""
    with _LOCK:
        running, before = _WRITING.get(id(spark), (0, None))
        if not running:
            before = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _WRITING[id(spark)] = (running + 1, before)
    try:
        yield
    finally:
        with _LOCK:
            running, before = _WRITING.pop(id(spark))
            if running > 1:
                _WRITING[id(spark)] = (running - 1, before)
            elif before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder."""
    path = new_path(df.sparkSession, name)
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    _delete(_WRITTEN)


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        with contextlib.suppress(Exception):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

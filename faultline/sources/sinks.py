"""Writing chart-ready and metric frames."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession


def write_frame(df: DataFrame, out: str, name: str) -> str:
    """Store one frame as parquet under ``<out>/<name>`` and return that path."""
    path = f"{out}/{name}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_frames(frames: Mapping[str, DataFrame], out: str) -> dict[str, str]:
    return {name: write_frame(df, out, name) for name, df in frames.items()}


def register_views(
    spark: SparkSession, root: str, registry: Mapping[str, Callable[[SparkSession, str], DataFrame]], names=None
) -> list[str]:
    """Bind named results as temp views, so that later ``spark.sql`` text can use them by name."""
    bound = list(names or registry)
    for name in bound:
        registry[name](spark, root).createOrReplaceTempView(name)
    return bound


class NamedResults:
    """Results by name that run nothing until they are used.

    A name is built, counted and staged at its first use, bound as a temp view, and kept. ``sql`` binds the
    names that stand in its text as whole words, in either case, and no others.
    """

    def __init__(self, spark: SparkSession, root: str, registry: Mapping[str, Callable[[SparkSession, str], DataFrame]]):
        self._spark, self._root, self._registry = spark, root, dict(registry)
        self._built: dict[str, DataFrame] = {}

    def __iter__(self):
        return iter(self._registry)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._registry[name](self._spark, self._root)
            self._built[name].createOrReplaceTempView(name)
        return self._built[name]

    def sql(self, text: str) -> DataFrame:
        words = {w.lower() for w in re.findall(r"\w+", text)}
        for name in self._registry:
            if name.lower() in words:
                self[name]
        return self._spark.sql(text)

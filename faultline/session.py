"""Session settings used by the benchmark and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(cores: int = 8, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster the submitter's own settings apply instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("faultline")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

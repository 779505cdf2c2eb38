"""Queries over tables where one car, make, campaign and group of copies owns a third of all rows.

Both fall-back paths are forced: keys cut into runs, and sides too large to broadcast.
"""

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import differences
from faultline.operators import ordered, staging
from faultline.plans import registry, reports
from faultline.sources.tables import Tables
from oracles import catalog

NAMES = [
    "q02", "q04", "q05", "q06", "q08", "q08_dedup", "q09", "q11", "q11_exact", "q12", "q13_all", "q14", "q15", "q16", "q19",
    "plot_q02c", "plot_q04", "plot_q10a", "plot_q10b", "plot_q10c", "plot_q10d_median", "a_median", "w_row_number",
    "w_first_per_key", "w_keep_first", "w_lag", "w_moving_avg", "w_part_count", "w_rank", "ml_high_flag",
]


def third(df):
    return F.pmod(F.xxhash64(*df.columns), F.lit(3)) == 0


def overwrite(df, where, values):
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()})


@pytest.fixture(scope="module")
def skewed(spark, tables, tmp_path_factory):
    root = tmp_path_factory.mktemp("skewed")
    car = {"MAKETXT": "BRAND 1", "MODELTXT": "RED RING", "YEARTXT": "1998"}
    copy = {**car, "POTAFF": 123456, "COMPNAME": "STEERING", "RCLTYPECD": "V", "DO_NOT_DRIVE": "Y",
            "PARK_OUTSIDE": "Y", "DESC_DEFECT": "defect X", "SRC_LINE": 1}
    recalls, hot = tables.recalls, third(tables.recalls)
    copies = F.pmod(F.xxhash64(*recalls.columns), F.lit(6)) == 0
    made = {
        "complaints": overwrite(tables.complaints, third(tables.complaints), {**car, "CDESCR": "brakes failed"}),
        "ratings": overwrite(
            tables.ratings, F.col("RATING_ID") % 3 == 0, {"MAKE": "BRAND 1", "MODEL": "red ring", "MODEL_YR": 1998}
        ),
        "investigations": overwrite(tables.investigations, third(tables.investigations), {"CAMPNO": "777"}),
        "recalls": recalls.select(
            *[
                F.when(hot, "777").otherwise(F.col(c)).alias(c) if c == "CAMPNO"
                else F.when(copies, F.lit(copy[c])).otherwise(F.col(c)).cast(recalls.schema[c].dataType).alias(c)
                if c in copy else F.col(c)
                for c in recalls.columns
            ]
        ),
    }
    for name, df in made.items():
        df.repartition(8).write.parquet(f"{root}/{name}")  # several map tasks, which a skewed partition is split by
    subject = Tables(**{n: (lambda n=n: spark.read.parquet(f"{root}/{n}")) for n in made})
    assert subject.recalls.groupBy(*subject.recalls.columns).count().agg(F.max("count")).first()[0] > 500
    return root, subject


@pytest.fixture
def statements(skewed, monkeypatch):
    for name in ("ratings", "complaints", "investigations", "recalls"):
        monkeypatch.setitem(
            catalog.STATEMENTS, f"v_{name}", ((), f"select * from read_parquet('{skewed[0]}/{name}/*.parquet')")
        )
    return catalog.oracle_sql()


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("path", ["runs", "shuffled sides"])
def test_rows_match(spark, skewed, statements, monkeypatch, name, path):
    if path == "runs":
        plain = ordered._in_plain_windows
        monkeypatch.setattr(
            ordered, "_in_plain_windows", lambda df, k, o, f: ordered._in_runs(df, k, o, f, plain(df, k, o, f).schema, 4)
        )
    else:
        monkeypatch.setattr(staging, "BROADCAST_BYTES", -1)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert differences(registry.SUBJECT_QUERIES[name](skewed[1]), duckdb.connect(), statements[name]) == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_semi_join_is_below_or_above_the_grouping(spark, skewed, monkeypatch):
    def above():
        text = reports.q15(skewed[1])._jdf.queryExecution().executedPlan().toString()
        return text.index("LeftSemi") < text.index("Aggregate")

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not above()
        monkeypatch.setattr(staging, "BROADCAST_BYTES", -1)
        assert above()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_campaign_of_pairs_is_split(spark, skewed):
    """q10 is the one report whose result is pairs; its hot campaign is split by the adaptive skew join."""
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        pairs = reports.q10(skewed[1])
        pairs.collect()
        assert "skew=true" in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)

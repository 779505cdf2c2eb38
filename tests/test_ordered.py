"""Ordered features are the same whether a key is cut into runs or handled by one window."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.operators.grouping import exact_median
from faultline.operators.ordered import key_sum, moving_average, ordered_features, position, previous, running_sum
from faultline.operators.ranking import sort_by, sorted_rows, value_ranks, with_percent_rank, with_rank

FEATURES = [
    position("pos"),
    previous("prev1", "v"),
    previous("prev3", "v", 3),
    moving_average("avg3", "v", 3),
    running_sum("upto", "v"),
    key_sum("total", "v"),
]


def brute(rows):
    """Features of (key, id, value) rows, straight from their definition."""
    out = {}
    for key in {r[0] for r in rows}:
        group = sorted([r for r in rows if r[0] == key], key=lambda r: r[1])
        values = [r[2] for r in group]
        for i, (_, ident, _) in enumerate(group):
            seen = [v for v in values[: i + 1] if v is not None]
            last3 = [v for v in values[max(0, i - 2) : i + 1] if v is not None]
            everything = [v for v in values if v is not None]
            out[ident] = (
                i + 1,
                values[i - 1] if i >= 1 else None,
                values[i - 3] if i >= 3 else None,
                sum(last3) / len(last3) if last3 else None,
                sum(seen) if seen else None,
                sum(everything) if everything else None,
            )
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    keys = ["hot"] * 40 + ["a", "b", None, "c"]
    made = [(rng.choice(keys), i, rng.choice([None, 1, 2, 3, 4, 5])) for i in range(400)]
    return made + [("gone", 1000 + i, None) for i in range(5)]


@pytest.mark.parametrize("unique", [True, False])
@pytest.mark.parametrize("hot_rows", [10_000, 20])
def test_features_equal_their_definition(spark, rows, hot_rows, unique):
    df = spark.createDataFrame(rows, "k string, id int, v int").repartition(4)
    out = ordered_features(df, ["k"], sort_by("id"), FEATURES, unique=unique, hot_rows=hot_rows)
    assert out.columns == ["k", "id", "v", *[f.name for f in FEATURES]]
    got = {r.id: (r.pos, r.prev1, r.prev3, r.avg3, r.upto, r.total) for r in out.collect()}
    expected = brute(rows)
    assert got.keys() == expected.keys()
    assert all(got[i] == pytest.approx(expected[i]) for i in got)


def test_one_row_runs_reach_back_over_several_runs(spark):
    """With as many runs as rows, three rows back lies three runs back."""
    rows = [("k", i, i * 10) for i in range(8)]
    df = spark.createDataFrame(rows, "k string, id int, v int")
    out = ordered_features(df, ["k"], sort_by("id"), FEATURES, unique=True, hot_rows=1)
    got = {r.id: (r.pos, r.prev1, r.prev3, r.avg3, r.upto, r.total) for r in out.collect()}
    assert got == brute(rows)


def test_copies_of_one_row_are_numbered_once_each(spark):
    """Equal rows are cut into runs too, through the frozen tie-break."""
    df = spark.createDataFrame([("k", 1)] * 300 + [("k", 2)] * 10, "k string, id int").repartition(5)
    out = ordered_features(df, ["k"], sort_by("id"), [position("pos")], hot_rows=20).collect()
    assert sorted(r.pos for r in out) == list(range(1, 311))
    assert all((r.pos <= 300) == (r.id == 1) for r in out)


def test_no_key_at_all(spark, rows):
    df = spark.createDataFrame([(r[1], r[2]) for r in rows], "id int, v int")
    out = ordered_features(df, [], sort_by("id"), FEATURES, unique=True, hot_rows=30)
    expected = brute([("", r[1], r[2]) for r in rows])
    got = {r.id: (r.pos, r.prev1, r.prev3, r.upto, r.total) for r in out.collect()}
    assert got == {k: (v[0], v[1], v[2], v[4], v[5]) for k, v in expected.items()}


@pytest.mark.parametrize("hot_rows", [10_000, 2])
def test_ranks_equal_the_window_functions(spark, rows, hot_rows):
    df = spark.createDataFrame(rows, "k string, id int, v int")
    df.createOrReplaceTempView("ranked_rows")
    plain = spark.sql(
        "select id, rank() over (partition by k order by v desc nulls last) r, "
        "percent_rank() over (order by v desc nulls last) p from ranked_rows"
    )
    ours = with_rank(with_percent_rank(df, "v", "p", hot_rows=hot_rows), ["k"], "v", "r", hot_rows=hot_rows)
    assert sorted(map(tuple, ours.select("id", "r", "p").collect())) == sorted(map(tuple, plain.collect()))


def test_percent_rank_of_a_single_row(spark):
    df = spark.createDataFrame([(1, 7)], "id int, v int")
    assert value_ranks(df, [], "v").first()["PERCENT_RANK"] == 0.0


@pytest.mark.parametrize("hot_rows", [10_000, 3])
def test_exact_median(spark, hot_rows):
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 50)) for k in ("a", "b", "c") for _ in range(rng.randint(20, 31))]
    df = spark.createDataFrame([*rows, ("a", None), ("empty", None)], "k string, x int")
    expected = df.filter("x is not null").groupBy("k").agg(F.median("x").alias("m"))
    got = exact_median(df, "x", ["k"], hot_rows=hot_rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    whole = exact_median(df, "x", hot_rows=hot_rows).first()[0]
    assert whole == df.agg(F.median("x")).first()[0]


def test_equal_rows_are_sorted_by_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(2,)] * 800 + [(1,), (3,)], "x int").repartition(8)
        out = sorted_rows(df, F.col("x"))
        assert [r.x for r in out.collect()] == [1] + [2] * 800 + [3]
        per_task = out.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert max(r["count"] for r in per_task) < 500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("kind", ["int", "bigint", "decimal(10,2)", "double"])
def test_both_ways_give_the_same_types_and_bits(spark, kind):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "hot", "a"]), i, rng.choice([None, *[rng.randint(-999, 999) / 7 for _ in range(9)]])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, id int, v double").withColumn("v", F.col("v").cast(kind)).repartition(4)
    features = [f for f in FEATURES if kind != "double" or f.kind not in ("running", "key_sum")]
    plain, cut = (ordered_features(df, ["k"], sort_by("id"), features, unique=True, hot_rows=n) for n in (10_000, 20))
    assert plain.dtypes == cut.dtypes
    assert sorted(map(tuple, plain.collect()), key=lambda r: r[1]) == sorted(map(tuple, cut.collect()), key=lambda r: r[1])


def test_sums_of_floating_point_are_refused(spark):
    df = spark.createDataFrame([("a", 1, 0.1)], "k string, id int, v double")
    with pytest.raises(TypeError, match="decimal"):
        ordered_features(df, ["k"], sort_by("id"), [running_sum("s", "v")])

"""Grouping, linking and ranking operators on small frames, and fast forms against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import grouping, ranking, staging
from faultline.plans import reports
from faultline.sources.tables import SCHEMAS, Tables


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def subject(spark, **tables):
    """Tables holding the given rows; a row names only the columns it sets."""

    def frame(name):
        names = [part.split()[0] for part in SCHEMAS[name].split(", ")]
        data = [tuple(row.get(n) for n in names) for row in tables.get(name, [])]
        return spark.createDataFrame(data, SCHEMAS[name])

    return Tables(**{name: (lambda n=name: frame(n)) for name in SCHEMAS})


# ---------------------------------------------------------------- grouping


def test_real_nulls_next_to_subtotals(spark):
    cases = [
        {"MAKETXT": "A", "CDESCR": "x", "DEATHS": 1},
        {"MAKETXT": "A", "CDESCR": None, "DEATHS": 2},
        {"MAKETXT": None, "CDESCR": "x"},
    ]
    t = subject(spark, complaints=cases)
    all_makes, all_parts = reports.ALL_MAKES, reports.ALL_COMPONENTS
    merged = [tuple(r)[:4] for r in reports.q05(t).collect()]
    assert merged.count(("A", all_parts, 2, 3)) == 1 and merged.count(("A", all_parts, 1, 2)) == 1
    assert merged.count((all_makes, all_parts, 1, None)) == 1 and merged.count((all_makes, "x", 1, None)) == 1
    labelled = [tuple(r)[:4] for r in reports.q05_labelled(t).collect()]
    assert ("A", None, 1, 2) in labelled and ("A", all_parts, 2, 3) in labelled
    assert (None, "x", 1, None) in labelled and (None, all_parts, 1, None) in labelled
    assert (all_makes, all_parts, 3, 3) in labelled and len(labelled) == len(merged) == 6


def test_histogram(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 9.99, 10, 10)] + [(None,)], "x double")
    got = [tuple(r) for r in grouping.histogram(df, "x", 5).orderBy("BIN").collect()]
    assert [r[3] for r in got] == [2, 1, 0, 0, 3]  # 2 opens the second bin, 10 stays in the last
    assert got[0][1:3] == (0.0, 2.0) and got[-1][1:3] == (8.0, 10.0)
    constant = grouping.histogram(spark.createDataFrame([(4.0,)] * 3, "x double"), "x", 2).orderBy("BIN")
    assert [tuple(r) for r in constant.collect()] == [(0, 3.5, 4.0, 0), (1, 4.0, 4.5, 3)]
    tenths = [i / 10 for i in range(11)] * 2 + [0.35, 0.6000000001]
    by_numpy = np.histogram(tenths, bins=10)[0].tolist()
    ours = grouping.histogram(spark.createDataFrame([(x,) for x in tenths], "x double"), "x", 10).orderBy("BIN")
    assert [r.N for r in ours.collect()] == by_numpy
    nothing = grouping.histogram(spark.createDataFrame([(None,)], "x double"), "x", 2).orderBy("BIN")
    assert [tuple(r) for r in nothing.collect()] == [(0, 0.0, 0.5, 0), (1, 0.5, 1.0, 0)]


def test_pivots_and_shares(spark):
    df = spark.createDataFrame(
        [("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), (None, "x"), ("c", None)], "k string, v string"
    )
    assert rows_of(grouping.pivot_count(df, "k", "v", ["x", "y"])) == [("a", 2, 1), ("b", 0, 1)]
    assert rows_of(grouping.pivot_share(df, "k", "v", ["x", "y"], 2)) == [("a", 66.67, 33.33), ("b", 0.0, 100.0)]
    assert rows_of(grouping.value_share(df, "v")) == [("x", 3, 0.6), ("y", 2, 0.4)]


def test_dedupe_measure(spark):
    df = spark.createDataFrame([("c1", "a", 5), ("c1", "a", 5), ("c1", "b", 5), ("c2", "a", None)], "c string, m string, n int")
    assert rows_of(grouping.dedupe_measure(df, ["c", "m"], "n")) == [("c1", "a", 5), ("c1", "b", 5), ("c2", "a", None)]


# ---------------------------------------------------------------- ranking


def test_topk_puts_missing_values_last_and_breaks_ties(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 3), ("d", 3)], "k string, n int")
    assert [r.k for r in ranking.nlargest(df, 3, "n", "k").collect()] == ["c", "d", "a"]
    assert [r.k for r in ranking.topk(df, 4, "-n", "k").collect()] == ["c", "d", "a", "b"]
    assert [r.k for r in ranking.tail(df, 2, "-n", "k").collect()] == ["a", "b"]


def test_top_keys_ignore_missing_keys(spark):
    df = spark.createDataFrame([(None,)] * 5 + [("a",)] * 3 + [("b",)] * 3 + [("c",)], "k string")
    assert [r.k for r in ranking.top_keys(df, "k", 2).collect()] == ["a", "b"]
    assert ranking.keep_top_keys(df, "k", 1).count() == 3


def test_group_size_by_broadcast_or_shuffle(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, n int")
    sizes = df.groupBy("k").agg(F.count("*").alias("size"))
    expected = [("a", 1, 2), ("a", 2, 2), (None, 3, 1)]
    assert rows_of(ranking.with_group_size(df, ["k"], "size")) == sorted(expected, key=repr)
    assert rows_of(staging.lookup(df, sizes, ["k"], max_rows=1)) == sorted(expected, key=repr)


# ---------------------------------------------------------------- campaigns


def test_lost_campaign(spark):
    """The campaign's first row is not the row its make keeps, so q08 credits it to nobody."""
    recalls = [
        {"CAMPNO": "c1", "MAKETXT": "A", "MODELTXT": "z", "POTAFF": 100, "COMPNAME": "1"},
        {"CAMPNO": "c1", "MAKETXT": "A", "MODELTXT": "b", "POTAFF": 100, "COMPNAME": "2"},
        {"CAMPNO": "c1", "MAKETXT": "B", "MODELTXT": "a", "POTAFF": 100, "COMPNAME": "3"},
        {"CAMPNO": "c2", "MAKETXT": "B", "MODELTXT": "a", "POTAFF": 7, "COMPNAME": "3"},
        {"CAMPNO": "c3", "MAKETXT": "C", "MODELTXT": "a", "POTAFF": None, "COMPNAME": "3"},
    ]
    t = subject(spark, recalls=recalls)
    plain = {r.MAKE: r.TOTAL_VEHICLES_AFFECTED for r in reports.q08(t).collect()}
    exact = {r.MAKE: r.TOTAL_VEHICLES_AFFECTED for r in reports.q08_dedup(t).collect()}
    assert plain == {"A": 0, "B": 7, "C": None}
    assert exact == {"A": 100, "B": 7, "C": None}


# ---------------------------------------------------------------- linking


def plain_ratings_join(spark, t):
    t.complaints.createOrReplaceTempView("c")
    t.ratings.createOrReplaceTempView("s")
    return spark.sql(
        """select c.MAKETXT, c.MODELTXT, c.YEARTXT, count(*), sum(c.DEATHS), sum(c.INJURED), s.OVERALL_STARS, s.ROLLOVER_STARS
        from c join s on upper(c.MAKETXT) = upper(s.MAKE) and upper(c.MODELTXT) = upper(s.MODEL)
         and try_cast(c.YEARTXT as decimal(38,0)) = s.MODEL_YR
        group by c.MAKETXT, c.MODELTXT, c.YEARTXT, s.OVERALL_STARS, s.ROLLOVER_STARS"""
    )


def plain_recall_join(spark, t, least):
    t.complaints.createOrReplaceTempView("c")
    t.recalls.createOrReplaceTempView("r")
    return spark.sql(
        f"""select c.MAKETXT, count(distinct c.CMPLID), count(distinct r.CAMPNO), sum(c.DEATHS), sum(c.INJURED)
        from c left join r on upper(c.MAKETXT) = upper(r.MAKETXT) and upper(c.MODELTXT) = upper(r.MODELTXT)
         and c.YEARTXT = r.YEARTXT where c.MAKETXT is not null
         and upper(trim(c.MAKETXT)) not in ('UNKNOWN', 'OTHER', '')
        group by c.MAKETXT having count(distinct c.CMPLID) > {least}"""
    )


def small_lifecycle(spark):
    cases = [
        {"CMPLID": i % 7, "MAKETXT": m, "MODELTXT": "x", "YEARTXT": y, "DEATHS": d, "INJURED": 1}
        for i, (m, y, d) in enumerate(
            [("a", "2010", 1), ("A", "2010", 2), ("A", " 2010", None), ("A", None, 4), ("b", "2011", None),
             ("b", "2011", None), ("other", "2010", 9), (None, "2010", 3), ("A", "2010", 2), ("z", "1", 5)]
        )
    ]
    stars = [
        {"MAKE": "A", "MODEL": "X", "MODEL_YR": 2010, "OVERALL_STARS": 4},
        {"MAKE": "a", "MODEL": "x", "MODEL_YR": 2010, "OVERALL_STARS": 4},
        {"MAKE": "A", "MODEL": "X", "MODEL_YR": 2010, "OVERALL_STARS": 3, "ROLLOVER_STARS": 1},
        {"MAKE": "B", "MODEL": "X", "MODEL_YR": 2011},
    ]
    recalls = [
        {"CAMPNO": c, "MAKETXT": m, "MODELTXT": "X", "YEARTXT": y}
        for c, m, y in [("1", "A", "2010"), ("1", "a", "2010"), ("2", "A", "2010"), (None, "A", "2010"), ("3", "B", "2011"),
                        ("4", "B", None), ("5", None, "2010")]
    ]
    return subject(spark, complaints=cases, ratings=stars, recalls=recalls)


def test_joins_without_fan_out_on_edge_cases(spark):
    t = small_lifecycle(spark)
    assert rows_of(reports.q06(t)) == rows_of(plain_ratings_join(spark, t))
    assert rows_of(reports.q19(t, 0)) == rows_of(plain_recall_join(spark, t, 0))


def test_joins_without_fan_out_on_test_tables(spark, tables):
    assert rows_of(reports.q06(tables)) == rows_of(plain_ratings_join(spark, tables))
    assert rows_of(reports.q19(tables)) == rows_of(plain_recall_join(spark, tables, 10))


def test_casualties_counted_once(spark):
    t = small_lifecycle(spark)
    exact = {r.MAKE: r.DEATHS_FROM_COMPLAINTS for r in reports.q11_exact(t, 0).collect()}
    joined = {r.MAKE: r.DEATHS_FROM_COMPLAINTS for r in reports.q11(t, 0).collect()}
    assert exact == {"A": 8, "a": 1, "b": None, "z": 5}
    assert joined == {"A": 2 * 4 + 2 * 4 + 4, "a": 4, "b": None, "z": 5}


def test_rate_is_missing_when_one_sum_is(spark):
    cases = [{"MAKETXT": m, "PROD_TYPE": "V", "INJURED": 2, "DEATHS": d, "CRASH": "Y"}
             for m, d in [("A", None), ("A", None), ("B", 1)]]
    t = subject(spark, complaints=cases)
    assert [(r.VEHICLE_MAKE, r.CRASH_RATE_PCT, r.CASUALTY_RATE_PCT) for r in reports.q14(t).collect()] == [("A", 100.0, None)]


@pytest.mark.parametrize("report", [reports.q15, reports.q16])
def test_exists_before_or_after_grouping(tables, report):
    assert rows_of(report(tables)) == rows_of(report(tables, max_rows=1))


def test_trend_is_the_same_for_hot_makes(tables):
    assert rows_of(reports.q02(tables)) == rows_of(reports.q02(tables, hot_rows=3))


def test_yearly_ranks_are_the_same_for_hot_makes(tables):
    assert rows_of(reports.q04(tables)) == rows_of(reports.q04(tables, hot_rows=3))


def test_top_makes_must_be_spelled_clean(spark):
    """A padded spelling can be a top make but matches no cleaned make."""
    cases = [{"MAKETXT": " A ", "PROD_TYPE": "V"}] * 3 + [{"MAKETXT": "B", "PROD_TYPE": "V"}]
    t = subject(spark, complaints=cases)
    assert {r.VEHICLE_MAKE for r in reports.q12(t, 1).collect()} <= {reports.ROLLUP_ALL_MAKES}
    assert {r.VEHICLE_MAKE for r in reports.q12(t, 2).collect()} == {"B", reports.ROLLUP_ALL_MAKES}

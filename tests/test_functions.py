"""Cleaning functions on hand-made values, one case per rule and edge."""

import pytest
from pyspark.sql import functions as F

from faultline.functions import numbers, taxonomy, text
from oracles import literals


def apply(spark, values, kind, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    rows = df.select("i", *[c(F.col("c")).alias(f"o{n}") for n, c in enumerate(columns)]).orderBy("i").collect()
    return [r[1] if len(columns) == 1 else tuple(r[1:]) for r in rows]


def test_years(spark):
    values = ["2010", " 2010 ", "2010.6", "2e3", "MY2011", "N/A", "", None]
    assert apply(spark, values, "string", numbers.try_year) == [2010, 2010, 2011, 2000, None, None, None, None]
    assert apply(spark, values, "string", numbers.digits_year) == [2010, 2010, 20106, 23, 2011, None, None, None]
    assert apply(spark, values, "string", numbers.to_numeric) == [2010, 2010, 2010.6, 2000, None, None, None, None]


@pytest.mark.parametrize("group,parts", literals.COMPONENT_GROUPS.items())
def test_component_rules(spark, group, parts):
    prefix = lambda c: taxonomy.component_group(c, "prefix")
    spelled = [*parts, *[f" {p.lower()} :DETAIL" for p in parts]]
    assert apply(spark, spelled, "string", prefix) == [group] * len(spelled)


def test_component_edges(spark):
    prefix = lambda c: taxonomy.component_group(c, "prefix")
    anywhere = lambda c: taxonomy.component_group(c, "anywhere")
    values = ["X:LIGHTING", ":", "", None, " steering ", "TIRES:LIGHTING", "ENGINE:LIGHTING", "lighting"]
    assert apply(spark, values, "string", prefix, anywhere) == [
        ("X", "LIGHTING SYSTEMS"),
        ("OTHER / UNKNOWN", "OTHER / UNKNOWN"),
        ("OTHER / UNKNOWN", "OTHER / UNKNOWN"),
        ("OTHER / UNKNOWN", "OTHER / UNKNOWN"),
        ("STEERING", "STEERING"),
        ("TIRES & WHEELS", "LIGHTING SYSTEMS"),
        ("ENGINE & COOLING", "ENGINE & COOLING"),
        ("LIGHTING", "LIGHTING SYSTEMS"),
    ]
    with pytest.raises(ValueError):
        taxonomy.component_group(F.col("c"), "elsewhere")


def test_noise_and_consolidation(spark):
    values = ["No summary", "n/a", "N/A x", "Takata Recall", "none", " none ", None, "SEE ATTACHED LETTER"]
    noise = lambda c: taxonomy.matches(text.strip(c), taxonomy.COMPLAINT_NOISE)
    assert apply(spark, values, "string", noise) == [True, True, False, True, True, True, False, True]
    texts = ["transmission may FAIL", " air bags out", "service brakes fail", "brakes fail", "SEAT BELT", "rust", None]
    assert apply(spark, texts, "string", taxonomy.consolidate_failures) == [
        "TRANSMISSION FAILURE", "AIR BAGS", "SERVICE BRAKES", "BRAKE FAILURE", "SEAT BELTS", "rust", None,
    ]


def test_sign_and_bins(spark):
    assert apply(spark, [2, -1, 0, None], "int", numbers.sign_bucket) == ["Improved", "Declined", "No Change", None]
    bins = lambda c: numbers.right_closed_bins(c, [-0.01, 0.25, 0.5, 0.75, 1.0], list("abcd"))
    values = [0.0, 0.25, 0.2500001, 0.5, 0.75, 1.0, 1.1, None]
    assert apply(spark, values, "double", bins) == ["a", "a", "b", "b", "c", "d", None, None]


def test_safe_ratio(spark):
    df = spark.createDataFrame([(1, 3), (1, 0), (None, 4), (201, 20000), (1, 800)], "a int, b int")
    got = [r[0] for r in df.select(numbers.safe_ratio(F.col("a"), F.col("b"), 2)).collect()]
    assert got == [33.33, None, None, 1.01, 0.13]  # halves go up: 1.005 and 0.125


def test_text(spark):
    values = ["Air-bags: o2 sENSOR's", "(abc) 3.5l", "", None, "\ttab\n", "\xa0wide\u3000 Space\u2009"]
    assert apply(spark, values, "string", text.title) == [None if v is None else v.title() for v in values]
    assert apply(spark, values, "string", text.lower_strip) == [None if v is None else v.lower().strip() for v in values]
    assert apply(spark, [" a-b ", "\tx"], "string", text.norm_make) == ["A B", "\tX"]
    assert apply(spark, ["abcdef", None], "string", lambda c: text.truncate(c, 3)) == ["abc", None]


def test_numbers_as_text(spark):
    values = [1234567.0, 18_400_000.0, 150_400.0, 2_500_000.0, 0.0, None]
    assert apply(spark, values, "double", text.thousands, text.short_number) == [
        ("1,234,567", "1M"), ("18,400,000", "18M"), ("150,400", "150K"), ("2,500,000", "2M"), ("0", "0K"), (None, None),
    ]
    assert apply(spark, [12.34567, None], "double", lambda c: text.percent_text(c, 4)) == ["12.3457%", None]
    assert apply(spark, [0.1234, 0.5], "double", text.share_text) == ["12.3%", "50.0%"]


def test_labels(spark):
    df = spark.createDataFrame([("A", "B", 2010), ("A", "B", None)], "a string, b string, y bigint")
    a, b, y = F.col("a"), F.col("b"), F.col("y")
    got = df.select(text.vehicle_label(a, b, y), text.vehicle_label(a, b, text.shown(y))).collect()
    assert list(map(tuple, got)) == [("A B (2010)", "A B (2010)"), (None, "A B (<NA>)")]


def test_tiers(spark):
    rows = [(6_000_000, 0), (100, 0), (100, 11), (100, 10), (100, 3), (100, 2)]
    df = spark.createDataFrame(rows, "total bigint, severe bigint")
    tier = taxonomy.risk_tier(F.col("total"), F.col("severe"), 5_000_000, 0.10, 0.02)
    got = [tuple(r) for r in df.select(tier, taxonomy.tier_group(tier)).collect()]
    assert got == [
        (taxonomy.TIER_SOFTWARE, "LOW RISK"),
        (taxonomy.TIER_ROUTINE, "LOW RISK"),
        (taxonomy.TIER_HIGH, "HIGH RISK"),
        (taxonomy.TIER_MODERATE, "MODERATE RISK"),
        (taxonomy.TIER_MODERATE, "MODERATE RISK"),
        (taxonomy.TIER_ROUTINE, "LOW RISK"),
    ]


def test_flags_and_lookups(spark):
    assert apply(spark, ["y", " Yes", "1", "true ", "N", None], "string", taxonomy.is_yes) == [True] * 4 + [False] * 2
    style = lambda c: taxonomy.map_or_keep(c, taxonomy.BODY_STYLE_CATEGORIES)
    assert apply(spark, ["4DR", "4 DR", "??", None], "string", style) == ["4-Door Sedan", "4-Door Sedan", "??", None]
    assert apply(spark, ["V", "Q", None], "string", taxonomy.recall_type_name) == ["VEHICLE RECALL", "Q", None]
    assert apply(spark, ["a", "b", None], "string", lambda c: taxonomy.not_in(c, ["a"])) == [False, True, True]


def test_patterns_read_line_ends_and_case_as_asked(spark):
    values = ["brakes\rwill fail", "brakes\u2028fail", "brakes\nfail", "BRAKE\x85FAIL", "engine ſ fail"]
    assert apply(spark, values, "string", taxonomy.consolidate_failures) == [
        "BRAKE FAILURE", "BRAKE FAILURE", "brakes\nfail", "BRAKE FAILURE", "ENGINE FAILURE",
    ]
    assert apply(spark, ["É"], "string", lambda c: taxonomy.matches(c, "(?i)é")) == [True]

"""One small query per reusable operator or function, run over whole subject tables.

Cleaning functions are shown as (input, output, rows), counted over every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions import numbers, taxonomy, text
from faultline.operators import grouping, ordered, ranking
from faultline.plans import reports
from faultline.sources.tables import Tables


def _rows(name: str = "N") -> Column:
    return F.count(F.lit(1)).alias(name)


def _shown(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    return df.groupBy(source, *[c.alias(n) for n, c in columns.items()]).agg(_rows())


# ---------------------------------------------------------------- filters


def f_codes(t: Tables) -> DataFrame:
    """Inequality on a nullable code drops the missing codes too."""
    return t.recalls.filter(F.col("RCLTYPECD") != "X").groupBy("RCLTYPECD").agg(_rows())


def f_regex_noise(t: Tables) -> DataFrame:
    """Narratives that say something; a missing narrative is not noise."""
    kept = t.complaints.filter(~taxonomy.matches(text.strip(F.col("CDESCR")), taxonomy.COMPLAINT_NOISE))
    return kept.groupBy("CDESCR").agg(_rows())


def f_dropna(t: Tables) -> DataFrame:
    kept = t.complaints.na.drop(subset=["MAKETXT", "CDESCR", "DEATHS"])
    return kept.groupBy("MAKETXT").agg(_rows(), F.sum("DEATHS").alias("DEATHS"))


# ---------------------------------------------------------------- functions


def x_norm_text(t: Tables) -> DataFrame:
    c = F.col("MAKETXT")
    return _shown(t.complaints, "MAKETXT", CLEAN=text.norm_text(c), CLEAN_MAKE=text.norm_make(c))


def x_component_group(t: Tables) -> DataFrame:
    c = F.col("COMPDESC")
    return _shown(
        t.complaints,
        "COMPDESC",
        BY_PREFIX=taxonomy.component_group(c, "prefix"),
        ANYWHERE=taxonomy.component_group(c, "anywhere"),
    )


def x_regex_consolidate(t: Tables) -> DataFrame:
    return _shown(t.complaints, "CDESCR", FAILURE=taxonomy.consolidate_failures(F.col("CDESCR")))


def x_lookup_map(t: Tables) -> DataFrame:
    category = taxonomy.map_or_keep(F.col("BODY_STYLE"), taxonomy.BODY_STYLE_CATEGORIES)
    return _shown(t.ratings, "BODY_STYLE", CATEGORY=category)


def x_digits_year(t: Tables) -> DataFrame:
    return _shown(t.complaints, "YEARTXT", YEAR=numbers.digits_year(F.col("YEARTXT")))


def x_try_year(t: Tables) -> DataFrame:
    return _shown(t.complaints, "YEARTXT", YEAR=numbers.try_year(F.col("YEARTXT")))


def x_to_numeric(t: Tables) -> DataFrame:
    return _shown(t.recalls, "YEARTXT", YEAR=numbers.to_numeric(F.col("YEARTXT")))


def x_fillna(t: Tables) -> DataFrame:
    filled = t.recalls.na.fill({"RCLTYPECD": "NONE", "POTAFF": 0})
    return filled.groupBy("RCLTYPECD").agg(_rows(), F.sum("POTAFF").alias("POTAFF"))


def x_safe_pct(t: Tables) -> DataFrame:
    """Percentages with an empty whole for makes without fires among year-less complaints."""
    missing_year = F.col("YEARTXT").isNull() & (F.col("FIRE") == "Y")
    return (
        t.complaints.groupBy("MAKETXT")
        .agg(
            F.sum(numbers.flag(F.col("CRASH") == "Y")).alias("CRASHES"),
            F.sum(numbers.flag(missing_year)).alias("WHOLE"),
            _rows(),
        )
        .select(
            "MAKETXT",
            numbers.safe_ratio(F.col("CRASHES"), F.col("N"), 2).alias("CRASH_PCT"),
            numbers.safe_ratio(F.col("CRASHES"), F.col("WHOLE"), 2).alias("SPARSE_PCT"),
        )
    )


def x_sign_bucket(t: Tables) -> DataFrame:
    change = F.col("OVERALL_STARS") - F.col("ROLLOVER_STARS")
    return _shown(t.ratings.withColumn("CHANGE", change), "CHANGE", DIRECTION=numbers.sign_bucket(F.col("CHANGE")))


def x_right_closed_bins(t: Tables) -> DataFrame:
    """Stars scaled to 0 .. 1.25 fall on every edge and outside."""
    shift = F.when(F.col("MODEL_YR") == 1995, 0.25).otherwise(0.0)
    scaled = t.ratings.withColumn("X", (F.col("OVERALL_STARS") - 1) / 4 + shift)
    edges, labels = [-0.01, 0.25, 0.5, 0.75, 1.0], ["a", "b", "c", "d"]
    return _shown(scaled, "X", BIN=numbers.right_closed_bins(F.col("X"), edges, labels))


def x_lower_strip(t: Tables) -> DataFrame:
    return _shown(t.complaints, "CDESCR", CLEAN=text.lower_strip(F.col("CDESCR")))


def x_label(t: Tables) -> DataFrame:
    parts = F.col("MAKE"), F.col("MODEL")
    return t.investigations.groupBy(
        text.vehicle_label(*parts, F.col("COMPNAME")).alias("LABEL"),
        text.vehicle_label(*parts, text.shown(F.col("COMPNAME"))).alias("SHOWN_LABEL"),
    ).agg(_rows())


def x_truncate(t: Tables) -> DataFrame:
    return _shown(t.recalls, "COMPNAME", SHORT=text.truncate(F.col("COMPNAME"), 12))


def x_title(t: Tables) -> DataFrame:
    return _shown(t.recalls, "COMPNAME", TITLE=text.title(F.col("COMPNAME")))


def x_tier_group(t: Tables, **thresholds) -> DataFrame:
    return reports.q17(t, **thresholds).select(
        "VEHICLE_MAKE", "INVESTMENT_RISK_TIER", taxonomy.tier_group(F.col("INVESTMENT_RISK_TIER")).alias("TIER")
    )


def x_human_number(t: Tables) -> DataFrame:
    return reports.make_complaints(t).select(
        "MAKE",
        text.thousands(F.col("TOTAL_INJURIES")).alias("THOUSANDS"),
        text.short_number(F.col("TOTAL_INJURIES") * 1000).alias("SHORT"),
        text.percent_text(F.col("DEATH_RATE_PER_COMPLAINT"), 4).alias("PERCENT"),
        text.share_text(numbers.safe_ratio(F.col("CRASH_COUNT"), F.col("TOTAL_COMPLAINTS"), 3, scale=1.0)).alias("SHARE"),
    )


# ---------------------------------------------------------------- aggregates


def a_count(t: Tables) -> DataFrame:
    return t.complaints.groupBy("MAKETXT").agg(_rows())


def a_count_distinct(t: Tables) -> DataFrame:
    return t.complaints.groupBy("MAKETXT").agg(F.countDistinct("CMPLID").alias("COMPLAINTS"))


def a_avg_of_counts(t: Tables) -> DataFrame:
    counts = t.complaints.groupBy("MAKETXT").agg(_rows())
    return counts.agg(F.round(F.avg("N"), 6).alias("AVG_ROWS"))


def a_dedupe_sum(t: Tables) -> DataFrame:
    campaigns = grouping.dedupe_measure(t.recalls, ["MAKETXT", "CAMPNO"], "POTAFF")
    return campaigns.groupBy("MAKETXT").agg(_rows("CAMPAIGNS"), F.sum("POTAFF").alias("POTAFF"))


def a_pivot_count(t: Tables) -> DataFrame:
    return grouping.pivot_count(t.recalls, "MAKETXT", "RCLTYPECD", ["V", "E", "T", "X"])


def a_pivot_share(t: Tables) -> DataFrame:
    return grouping.pivot_share(t.recalls, "MAKETXT", "RCLTYPECD", ["V", "E", "T", "X"])


def a_median(t: Tables) -> DataFrame:
    return grouping.exact_median(t.recalls, "POTAFF", ["RCLTYPECD"])


def a_histogram(t: Tables) -> DataFrame:
    sized = t.recalls.filter(F.col("POTAFF") > 0).select(F.log10("POTAFF").alias("X"))
    return grouping.histogram(sized, "X", 30)


def a_value_share(t: Tables) -> DataFrame:
    return grouping.value_share(t.recalls, "RCLTYPECD")


def a_extent(t: Tables) -> DataFrame:
    return grouping.extent(t.recalls, "POTAFF")


def a_top_makes(t: Tables) -> DataFrame:
    return reports.top_makes(t)


# ---------------------------------------------------------------- windows

_RECALL_COLUMNS = [
    "MAKETXT", "MODELTXT", "YEARTXT", "POTAFF", "COMPNAME", "RCLTYPECD", "DO_NOT_DRIVE", "PARK_OUTSIDE",
    "DESC_DEFECT",
]


def recall_order(df: DataFrame) -> list[str]:
    return [c for c in ("SRC_LINE", *_RECALL_COLUMNS) if c in df.columns]


def _trend(t: Tables, feature: ordered.Feature) -> DataFrame:
    df = reports.rated(t).withColumn("HIGH", numbers.flag(F.col("OVERALL_STARS") >= 4))
    out = ordered.ordered_features(
        df, ["MAKE"], reports.trend_order(df), [feature], unique="RATING_ID" in df.columns
    )
    ident = [c for c in ("RATING_ID", "MAKE", "MODEL", "MODEL_YR", "OVERALL_STARS") if c in df.columns]
    return out.select(*ident, feature.name)


def w_percent_rank(t: Tables) -> DataFrame:
    df = ranking.with_percent_rank(reports.rated(t), "OVERALL_STARS", "P")
    return df.select("MAKE", "MODEL", "MODEL_YR", "OVERALL_STARS", F.round("P", 6).alias("SAFETY_PERCENTILE"))


def w_rank(t: Tables) -> DataFrame:
    df = ranking.with_rank(reports.rated(t), ["MODEL_YR"], "OVERALL_STARS", "RANK_IN_YEAR")
    return df.select("MAKE", "MODEL", "MODEL_YR", "OVERALL_STARS", "RANK_IN_YEAR")


def w_part_count(t: Tables) -> DataFrame:
    df = ranking.with_group_size(reports.rated(t), ["MAKE"], "TOTAL_MODELS_BY_MAKE")
    return df.select("MAKE", "MODEL", "MODEL_YR", "TOTAL_MODELS_BY_MAKE")


def w_lag(t: Tables) -> DataFrame:
    return _trend(t, ordered.previous("PREV_YEAR_STARS", "OVERALL_STARS"))


def w_lag_diff(t: Tables) -> DataFrame:
    df = w_lag(t)
    return df.withColumn("STAR_CHANGE", F.col("OVERALL_STARS") - F.col("PREV_YEAR_STARS")).drop("PREV_YEAR_STARS")


def w_moving_avg(t: Tables) -> DataFrame:
    df = _trend(t, ordered.moving_average("ROLLING_3YR_AVG", "OVERALL_STARS", 3))
    return df.withColumn("ROLLING_3YR_AVG", F.round("ROLLING_3YR_AVG", 6))


def w_cum_flag(t: Tables) -> DataFrame:
    return _trend(t, ordered.running_sum("CUMULATIVE_HIGH_RATINGS", "HIGH"))


def w_row_number(t: Tables) -> DataFrame:
    df = t.recalls
    order = ["MAKETXT", *[c for c in recall_order(df) if c != "MAKETXT"]]
    numbered = ordered.ordered_features(df, ["CAMPNO"], ranking.sort_by(*order), [ordered.position("RN")])
    return numbered.select("CAMPNO", *order, "RN")


def w_first_per_key(t: Tables) -> DataFrame:
    df = t.recalls
    order = ["MODELTXT", *[c for c in recall_order(df) if c not in ("MODELTXT", "MAKETXT")]]
    return ranking.first_per_key(df, ["CAMPNO", "MAKETXT"], ranking.sort_by(*order)).select("CAMPNO", "MAKETXT", *order)


def w_keep_first(t: Tables) -> DataFrame:
    """First row of every campaign in the order of vehicles affected."""
    df = t.recalls
    order = ["-POTAFF", *[c for c in recall_order(df) if c != "POTAFF"]]
    return ranking.first_per_key(df, ["CAMPNO"], ranking.sort_by(*order)).select(
        "CAMPNO", "MAKETXT", "MODELTXT", "POTAFF", "COMPNAME"
    )


# ---------------------------------------------------------------- top-k


def t_topk(t: Tables) -> DataFrame:
    order = ["-POTAFF", "CAMPNO", *[c for c in recall_order(t.recalls) if c != "POTAFF"]]
    return ranking.topk(t.recalls, 25, *order).select("CAMPNO", "MAKETXT", "MODELTXT", "POTAFF")


def t_nlargest(t: Tables) -> DataFrame:
    return ranking.nlargest(reports.make_complaints(t), 15, "CRASH_COUNT", "MAKE").select("MAKE", "CRASH_COUNT")


def t_head_tail(t: Tables) -> DataFrame:
    totals = reports.make_complaints(t).select("MAKE", "TOTAL_COMPLAINTS")
    order = ["-TOTAL_COMPLAINTS", "MAKE"]
    head = ranking.topk(totals, 15, *order).withColumn("PART", F.lit("head"))
    return head.unionByName(ranking.tail(totals, 15, *order).withColumn("PART", F.lit("tail")))


def t_topk_semi(t: Tables) -> DataFrame:
    kept = ranking.keep_top_keys(t.complaints, "MAKETXT", 5)
    return kept.groupBy("MAKETXT", "YEARTXT").agg(_rows())

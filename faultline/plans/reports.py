"""The nineteen reports. Each takes the subject tables and returns one DataFrame.

Column names and literals are those of the questions the reports answer; thresholds, make
lists and row limits are parameters. Every sort puts NULLs last and ends in the group keys,
so that limits are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.functions.numbers import digits_year, flag, safe_ratio, try_year
from faultline.functions.taxonomy import NO_BRAND, NO_MAKE, component_group, is_yes, recall_type_name, risk_tier
from faultline.functions.text import norm_make, norm_text
from faultline.operators.grouping import dedupe_measure, merged_label, subtotal_label
from faultline.operators.linking import complaints_to_recalls, complaints_with_ratings
from faultline.operators.ordered import HOT_ROWS, key_sum, moving_average, ordered_features, previous, running_sum
from faultline.operators.ranking import first_per_key, sort_by, sorted_rows, top_keys, topk, value_ranks, with_rank
from faultline.operators.staging import BROADCAST_ROWS, keep_existing, lookup, stage
from faultline.sources.tables import Tables

# Makes compared by the component x make cube.
CUBE_MAKES = ["FORD", "CHEVROLET", "TOYOTA", "HONDA", "NISSAN"]

# Subtotal labels.
ALL_MAKES = "-- ALL MAKES --"
ALL_COMPONENTS = "-- ALL COMPONENTS --"
ROLLUP_ALL_MAKES = "--- ALL MAKES (GRAND TOTAL) ---"
ROLLUP_ALL_COMPONENTS = "--- ALL COMPONENTS (GRAND TOTAL) ---"
ROLLUP_SUBTOTAL = "--- ALL COMPONENTS (SUBTOTAL) ---"
CUBE_ALL_MAKES = "--- ALL MAKES ---"
CUBE_ALL_COMPONENTS = "--- ALL COMPONENTS ---"
CUBE_ALL_TYPES = "--- ALL RECALL TYPES ---"


def _rows() -> Column:
    return F.count(F.lit(1))


def _yes(name: str) -> Column:
    return F.sum(flag(F.col(name) == "Y"))


# ---------------------------------------------------------------- ratings


def q01(t: Tables, min_rows: int = 5) -> DataFrame:
    """Star averages by body style, for styles with enough rated vehicles."""

    def mean(name: str) -> Column:
        return F.round(F.avg(name), 2)

    return (
        t.ratings.filter(F.col("OVERALL_STARS").isNotNull())
        .groupBy("BODY_STYLE")
        .agg(
            _rows().alias("VEHICLES_RATED"),
            mean("OVERALL_STARS").alias("AVG_OVERALL_STARS"),
            mean("OVERALL_FRNT_STARS").alias("AVG_FRONTAL_STARS"),
            mean("OVERALL_SIDE_STARS").alias("AVG_SIDE_STARS"),
            mean("ROLLOVER_STARS").alias("AVG_ROLLOVER_STARS"),
            mean("ROLLOVER_POSSIBILITY").alias("AVG_ROLLOVER_PROBABILITY"),
        )
        .filter(F.col("VEHICLES_RATED") >= min_rows)
        .orderBy(*sort_by("-AVG_OVERALL_STARS", "BODY_STYLE"))
    )


def rated(t: Tables) -> DataFrame:
    """Vehicles with an overall rating, the columns the trend needs, one tie-break id if there is one."""
    wanted = ["MAKE", "MODEL", "MODEL_YR", "OVERALL_STARS", "ROLLOVER_POSSIBILITY", "RATING_ID"]
    return t.ratings.filter(F.col("OVERALL_STARS").isNotNull()).select(
        *[c for c in wanted if c in t.ratings.columns]
    )


def trend_order(df: DataFrame) -> list[Column]:
    names = ["MODEL_YR", "MODEL", "RATING_ID", "OVERALL_STARS", "ROLLOVER_POSSIBILITY"]
    return sort_by(*[n for n in names if n in df.columns])


def add_make_trend(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Previous stars, change, three-row average, make size and cumulative high ratings, per make."""
    marked = df.withColumns({"_high": flag(F.col("OVERALL_STARS") >= 4), "_one": F.lit(1)})
    features = [
        previous("PREV_YEAR_STARS", "OVERALL_STARS"),
        moving_average("ROLLING_3YR_AVG", "OVERALL_STARS", 3),
        key_sum("TOTAL_MODELS_BY_MAKE", "_one"),
        running_sum("CUMULATIVE_HIGH_RATINGS", "_high"),
    ]
    out = ordered_features(
        marked, ["MAKE"], trend_order(df), features, unique="RATING_ID" in df.columns, hot_rows=hot_rows
    )
    return out.withColumns(
        {
            "STAR_CHANGE": F.col("OVERALL_STARS") - F.col("PREV_YEAR_STARS"),
            "ROLLING_3YR_AVG": F.round("ROLLING_3YR_AVG", 6),
        }
    ).drop("_high", "_one")


def q02(t: Tables, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rating trend: seven ordered features of every rated vehicle.

    Both ranks come from one count per (year, stars) and are attached to the rows.
    """
    vehicles, stars, year = rated(t), "OVERALL_STARS", "MODEL_YR"
    counts = stage(vehicles.groupBy(year, stars).agg(_rows().alias("n")))
    overall = value_ranks(counts, [], stars, hot_rows, "n").withColumnRenamed("PERCENT_RANK", "SAFETY_PERCENTILE")
    in_year = value_ranks(counts, [year], stars, hot_rows, "n").withColumnRenamed("RANK", "RANK_IN_YEAR")
    df = lookup(add_make_trend(vehicles, hot_rows), overall.drop("RANK"), [stars])
    df = lookup(df, in_year.drop("PERCENT_RANK"), [year, stars])
    return sorted_rows(df, *sort_by("MAKE"), *trend_order(df)).select(
        "MAKE",
        "MODEL",
        "MODEL_YR",
        "OVERALL_STARS",
        "ROLLOVER_POSSIBILITY",
        F.round("SAFETY_PERCENTILE", 6).alias("SAFETY_PERCENTILE"),
        "PREV_YEAR_STARS",
        "STAR_CHANGE",
        "ROLLING_3YR_AVG",
        "RANK_IN_YEAR",
        "TOTAL_MODELS_BY_MAKE",
        "CUMULATIVE_HIGH_RATINGS",
    )


# ---------------------------------------------------------------- complaints


def make_complaints(t: Tables) -> DataFrame:
    """Complaint volume and severity of every make."""
    return (
        t.complaints.groupBy(F.col("MAKETXT").alias("MAKE"))
        .agg(
            _rows().alias("TOTAL_COMPLAINTS"),
            F.sum("DEATHS").alias("TOTAL_DEATHS"),
            F.sum("INJURED").alias("TOTAL_INJURIES"),
            _yes("CRASH").alias("CRASH_COUNT"),
            _yes("FIRE").alias("FIRE_COUNT"),
        )
        .withColumn(
            "DEATH_RATE_PER_COMPLAINT", safe_ratio(F.col("TOTAL_DEATHS"), F.col("TOTAL_COMPLAINTS"), 4)
        )
    )


def q03(t: Tables, k: int = 20) -> DataFrame:
    """Most complained-about makes with their severity."""
    return topk(make_complaints(t), k, "-TOTAL_COMPLAINTS", "MAKE")


def q04(t: Tables, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Complaints per make and year text, running total of the make, rank within the year."""
    counts = stage(
        t.complaints.groupBy(F.col("MAKETXT").alias("MAKE"), F.col("YEARTXT").alias("MODEL_YEAR")).agg(
            F.countDistinct("CMPLID").alias("COMPLAINTS")
        )
    )
    totals = ordered_features(
        counts,
        ["MAKE"],
        sort_by("MODEL_YEAR"),
        [running_sum("RUNNING_TOTAL_COMPLAINTS", "COMPLAINTS")],
        unique=True,
        staged=True,
        hot_rows=hot_rows,
    )
    ranked = with_rank(totals, ["MODEL_YEAR"], "COMPLAINTS", "RANK_IN_YEAR", hot_rows=hot_rows)
    return ranked.orderBy(*sort_by("MODEL_YEAR", "RANK_IN_YEAR", "MAKE"))


def _text_rollup(t: Tables, make: Column, text: Column) -> DataFrame:
    return (
        t.complaints.rollup("MAKETXT", "CDESCR")
        .agg(
            make.alias("MAKE"),
            text.alias("COMPONENT"),
            _rows().alias("COMPLAINT_COUNT"),
            F.sum("DEATHS").alias("TOTAL_DEATHS"),
            F.sum("INJURED").alias("TOTAL_INJURIES"),
        )
        .orderBy(*sort_by("MAKETXT", "-COMPLAINT_COUNT", "CDESCR"))
        .drop("MAKETXT", "CDESCR")
    )


def q05(t: Tables) -> DataFrame:
    """Complaints rolled up make > narrative.

    A missing make or narrative carries the same label as a subtotal. The subtotals shrink
    to one row per make in the map-side aggregate, so one shuffle moves the detail rows once.
    """
    return _text_rollup(t, merged_label("MAKETXT", ALL_MAKES), merged_label("CDESCR", ALL_COMPONENTS))


def q05_labelled(t: Tables) -> DataFrame:
    """q05 with labels on real subtotals only; missing values stay NULL."""
    return _text_rollup(t, subtotal_label("MAKETXT", ALL_MAKES), subtotal_label("CDESCR", ALL_COMPONENTS))


def rated_car_complaints(t: Tables) -> DataFrame:
    """Complaints of rated cars next to their stars, one row per car and star pair, in no order."""
    return complaints_with_ratings(t.complaints, t.ratings)


def q06(t: Tables) -> DataFrame:
    return rated_car_complaints(t).orderBy(
        *sort_by("-COMPLAINT_COUNT", "MAKE", "MODEL", "MODEL_YEAR", "OVERALL_STARS", "ROLLOVER_STARS")
    )


# ---------------------------------------------------------------- investigations and recalls


def q07(t: Tables, k: int = 20) -> DataFrame:
    """Most investigated make / model / component."""
    grouped = t.investigations.groupBy("MAKE", "MODEL", F.col("COMPNAME").alias("COMPONENT")).agg(
        F.countDistinct("ACTION_NUMBER").alias("INVESTIGATION_COUNT"),
        F.countDistinct("CAMPNO").alias("RELATED_CAMPAIGNS"),
        F.min("YEAR").alias("EARLIEST_YEAR"),
        F.max("YEAR").alias("LATEST_YEAR"),
    )
    return topk(grouped, k, "-INVESTIGATION_COUNT", "MAKE", "MODEL", "COMPONENT")


def _recall_rest(t: Tables) -> list[str]:
    return [*(["SRC_LINE"] if "SRC_LINE" in t.recalls.columns else []), "POTAFF", "COMPNAME", "DO_NOT_DRIVE", "PARK_OUTSIDE"]


def campaign_make_rows(t: Tables) -> DataFrame:
    """The row that each campaign and make keeps: its first by model.

    Spark prunes to one row per campaign, make and map task before the shuffle, so a hot campaign
    leaves each map task as one row per make.
    """
    rest = _recall_rest(t)
    rows = t.recalls.select("CAMPNO", "MAKETXT", "MODELTXT", *rest)
    return first_per_key(rows, ["CAMPNO", "MAKETXT"], sort_by("MODELTXT", *rest))


def campaign_first_rows(t: Tables) -> DataFrame:
    """The first row of each campaign by make and source order; it may not be the one that its make keeps."""
    rest = _recall_rest(t)
    rows = t.recalls.select("CAMPNO", "MAKETXT", "MODELTXT", *rest)
    return first_per_key(rows, ["CAMPNO"], sort_by("MAKETXT", *rest, "MODELTXT"))


def _recall_counts() -> list[Column]:
    return [
        F.count("CAMPNO").alias("TOTAL_RECALLS"),
        F.countDistinct("COMPNAME").alias("COMPONENTS_RECALLED"),
        _yes("DO_NOT_DRIVE").alias("DO_NOT_DRIVE_RECALLS"),
        _yes("PARK_OUTSIDE").alias("PARK_OUTSIDE_RECALLS"),
    ]


def _recall_leaders(per_make: DataFrame, k: int) -> DataFrame:
    shown = per_make.select(
        "MAKE", "TOTAL_RECALLS", "TOTAL_VEHICLES_AFFECTED", "COMPONENTS_RECALLED", "DO_NOT_DRIVE_RECALLS", "PARK_OUTSIDE_RECALLS"
    )
    return topk(shown, k, "-TOTAL_VEHICLES_AFFECTED", "MAKE")


def q08(t: Tables, k: int = 20) -> DataFrame:
    """Makes by vehicles recalled, a campaign counted only where its first row survives per make.

    Campaigns whose first row is not the one kept for its make count for nobody. Kept and first rows meet in one
    grouping by all of their columns, so neither side is staged or joined.
    """
    kept = campaign_make_rows(t).withColumns({"kept": F.lit(1), "leads": F.lit(0)})
    both = kept.unionByName(campaign_first_rows(t).withColumns({"kept": F.lit(0), "leads": F.lit(1)}))
    names = [n for n in both.columns if n not in ("kept", "leads")]
    rows = both.groupBy(*names).agg(F.max("kept").alias("kept"), F.max("leads").alias("leads")).filter("kept = 1")
    credit = F.sum(F.when(F.col("leads") == 1, F.col("POTAFF")).otherwise(0)).alias("TOTAL_VEHICLES_AFFECTED")
    return _recall_leaders(rows.groupBy(F.col("MAKETXT").alias("MAKE")).agg(credit, *_recall_counts()), k)


def q08_dedup(t: Tables, k: int = 20) -> DataFrame:
    """q08 without the loss: each campaign's vehicles are credited once, to its first make.

    The window over a campaign sees one row per make of it.
    """
    per_make = campaign_make_rows(t).groupBy(F.col("MAKETXT").alias("MAKE")).agg(*_recall_counts())
    campaign = Window.partitionBy("CAMPNO")
    largest = t.recalls.groupBy("CAMPNO", "MAKETXT").agg(F.max("POTAFF").alias("LARGEST"))
    placed = largest.select(
        F.col("MAKETXT").alias("CREDITED_MAKE"),
        F.row_number().over(campaign.orderBy(*sort_by("MAKETXT"))).alias("place"),
        F.max("LARGEST").over(campaign).alias("vehicles"),
    )
    credit = F.sum(F.when(F.col("place") == 1, F.col("vehicles")).otherwise(0)).alias("TOTAL_VEHICLES_AFFECTED")
    credits = placed.groupBy("CREDITED_MAKE").agg(credit)
    return _recall_leaders(per_make.join(credits, F.col("MAKE").eqNullSafe(F.col("CREDITED_MAKE"))), k)


def q09(t: Tables, makes: Sequence[str] = CUBE_MAKES) -> DataFrame:
    """Recalls cubed over component x make for a few makes; POTAFF is summed as stored, per row.

    Rows are summed per campaign first, so the cube expands fewer rows.
    """
    campaigns = (
        t.recalls.filter(F.col("MAKETXT").isin(list(makes)))
        .groupBy("COMPNAME", "MAKETXT", "CAMPNO")
        .agg(F.sum("POTAFF").alias("POTAFF"))
    )
    return (
        campaigns.cube("COMPNAME", "MAKETXT")
        .agg(
            merged_label("COMPNAME", ALL_COMPONENTS).alias("COMPONENT"),
            merged_label("MAKETXT", ALL_MAKES).alias("MAKE"),
            F.countDistinct("CAMPNO").alias("RECALL_COUNT"),
            F.sum("POTAFF").alias("TOTAL_AFFECTED"),
        )
        .drop("COMPNAME", "MAKETXT")
        .orderBy(*sort_by("-TOTAL_AFFECTED", "COMPONENT", "MAKE"))
    )


def q10(t: Tables) -> DataFrame:
    """Every recall row with every investigation of the same campaign.

    All pairs are the result here; a campaign that is hot on both sides is split by the
    adaptive skew join, and the sort spreads equal rows over tasks.
    """
    r, i = t.recalls.alias("r"), t.investigations.alias("i")
    pairs = r.join(i, F.col("r.CAMPNO") == F.col("i.CAMPNO")).select(
        F.col("r.MAKETXT").alias("MAKE"),
        F.col("r.CAMPNO").alias("CAMPAIGN_NUMBER"),
        F.col("r.COMPNAME").alias("RECALL_COMPONENT"),
        F.col("r.POTAFF").alias("VEHICLES_AFFECTED"),
        "r.DESC_DEFECT",
        "i.ACTION_NUMBER",
        F.col("i.SUBJECT").alias("INVESTIGATION_SUBJECT"),
        F.col("i.SUMMARY").alias("INVESTIGATION_SUMMARY"),
    )
    return sorted_rows(
        pairs, *sort_by("-VEHICLES_AFFECTED", "CAMPAIGN_NUMBER", "MAKE", "ACTION_NUMBER", "RECALL_COMPONENT")
    )


def _named_complaints(t: Tables) -> DataFrame:
    return t.complaints.filter(F.col("MAKETXT").isNotNull() & ~norm_text(F.col("MAKETXT")).isin(NO_MAKE))


def q11(t: Tables, min_complaints: int = 100, k: int = 20, fan_out: bool = True) -> DataFrame:
    """Makes with many complaints and the recall campaigns of the same cars.

    Casualties count once per matching recall row; ``fan_out=False`` counts them once.
    """
    linked = complaints_to_recalls(_named_complaints(t), t.recalls, min_complaints, fan_out)
    return topk(linked, k, "-COMPLAINT_COUNT", "MAKE")


def q11_exact(t: Tables, min_complaints: int = 100, k: int = 20) -> DataFrame:
    return q11(t, min_complaints, k, fan_out=False)


# ---------------------------------------------------------------- hierarchies and cubes


def top_makes(t: Tables, k: int = 5) -> DataFrame:
    """The makes, as spelled, with the most vehicle complaints."""
    return top_keys(t.complaints.filter(F.col("PROD_TYPE") == "V"), "MAKETXT", k)


def _of_top_makes(df: DataFrame, t: Tables, k: int) -> DataFrame:
    """Rows whose cleaned make equals one of the k top spellings; CLEAN_MAKE is added."""
    tops = top_makes(t, k).select(F.col("MAKETXT").alias("CLEAN_MAKE"))
    cleaned = df.withColumn("CLEAN_MAKE", norm_text(F.col("MAKETXT")))
    return cleaned.join(F.broadcast(tops), "CLEAN_MAKE", "left_semi")


def _casualty_columns(total: str = "TOTAL_COMPLAINTS") -> dict[str, Column]:
    n = F.col(total)
    return {
        "CRASH_RATE_PCT": safe_ratio(F.col("TOTAL_CRASHES"), n, 2),
        "CASUALTY_RATE_PCT": safe_ratio(F.col("TOTAL_DEATHS") + F.col("TOTAL_INJURIES"), n, 2),
    }


def q12(t: Tables, k: int = 5) -> DataFrame:
    """Complaints of the top makes rolled up make > component group, with crash and casualty rates.

    Rows are counted per (make, group) first; the rollup then expands a handful of rows.
    """
    detail = (
        _of_top_makes(t.complaints.filter(F.col("PROD_TYPE") == "V"), t, k)
        .groupBy("CLEAN_MAKE", component_group(F.col("COMPDESC"), "anywhere").alias("CLEAN_COMPONENT"))
        .agg(
            _rows().alias("n"),
            F.sum("DEATHS").alias("deaths"),
            F.sum("INJURED").alias("injured"),
            _yes("CRASH").alias("crashes"),
        )
    )
    below = F.when(F.grouping("CLEAN_MAKE") == 1, ROLLUP_ALL_COMPONENTS).otherwise(ROLLUP_SUBTOTAL)
    return (
        detail.rollup("CLEAN_MAKE", "CLEAN_COMPONENT")
        .agg(
            subtotal_label("CLEAN_MAKE", ROLLUP_ALL_MAKES).alias("VEHICLE_MAKE"),
            F.when(F.grouping("CLEAN_COMPONENT") == 1, below)
            .otherwise(F.col("CLEAN_COMPONENT"))
            .alias("PRIMARY_COMPONENT"),
            F.sum("n").alias("TOTAL_COMPLAINTS"),
            F.sum("deaths").alias("TOTAL_DEATHS"),
            F.sum("injured").alias("TOTAL_INJURIES"),
            F.sum("crashes").alias("TOTAL_CRASHES"),
            F.grouping("CLEAN_MAKE").alias("all_makes"),
            F.grouping("CLEAN_COMPONENT").alias("all_components"),
        )
        .withColumns(_casualty_columns())
        .orderBy(*sort_by("all_makes", "VEHICLE_MAKE", "all_components", "-TOTAL_COMPLAINTS", "PRIMARY_COMPONENT"))
        .drop("CLEAN_MAKE", "CLEAN_COMPONENT", "all_makes", "all_components")
    )


def q13_cube(t: Tables, k: int = 5) -> DataFrame:
    """Recall campaigns of the top makes cubed over make x component group x recall type.

    Campaign rows are reduced to one per (make, group, type, campaign) before the cube.
    """
    base = _of_top_makes(
        t.recalls.filter(F.col("RCLTYPECD").isNotNull() & (F.col("RCLTYPECD") != "X")), t, k
    ).select(
        "CLEAN_MAKE",
        component_group(F.col("COMPNAME"), "prefix").alias("CLEAN_COMPONENT"),
        norm_text(F.col("RCLTYPECD")).alias("CLEAN_RECALL_TYPE"),
        norm_text(F.col("CAMPNO")).alias("CLEAN_CAMPNO"),
        "POTAFF",
    )
    dims = ["CLEAN_MAKE", "CLEAN_COMPONENT", "CLEAN_RECALL_TYPE"]
    campaigns = dedupe_measure(base.filter("CLEAN_COMPONENT != ''"), [*dims, "CLEAN_CAMPNO"], "POTAFF")
    return (
        campaigns.cube(*dims)
        .agg(
            subtotal_label(dims[0], CUBE_ALL_MAKES).alias("VEHICLE_MAKE"),
            subtotal_label(dims[1], CUBE_ALL_COMPONENTS).alias("PRIMARY_COMPONENT"),
            subtotal_label(dims[2], CUBE_ALL_TYPES, recall_type_name(F.col(dims[2]))).alias("RECALL_CLASSIFICATION"),
            F.countDistinct("CLEAN_CAMPNO").alias("TOTAL_RECALL_CAMPAIGNS"),
            F.sum("POTAFF").alias("TOTAL_VEHICLES_AFFECTED"),
            *[F.grouping(d).alias(f"all_{i}") for i, d in enumerate(dims)],
        )
        .withColumn(
            "AVG_VEHICLES_PER_RECALL",
            safe_ratio(F.col("TOTAL_VEHICLES_AFFECTED"), F.col("TOTAL_RECALL_CAMPAIGNS"), 0, scale=1.0),
        )
        .drop(*dims)
    )


_CUBE_ORDER = [
    "all_0", "all_1", "all_2", "-TOTAL_VEHICLES_AFFECTED", "VEHICLE_MAKE", "PRIMARY_COMPONENT",
    "RECALL_CLASSIFICATION",
]


def q13(t: Tables, k: int = 5, limit: int = 40) -> DataFrame:
    """First rows of ``q13_cube``: detail before subtotals, largest first."""
    return topk(q13_cube(t, k), limit, *_CUBE_ORDER).drop("all_0", "all_1", "all_2")


def q13_all(t: Tables, k: int = 5) -> DataFrame:
    """The whole cube, subtotals included."""
    return q13_cube(t, k).orderBy(*sort_by(*_CUBE_ORDER)).drop("all_0", "all_1", "all_2")


def q14(t: Tables) -> DataFrame:
    """Makes with more vehicle complaints than the average make.

    The makes are staged, so that the average and the comparison share one pass over complaints.
    """
    make = norm_make(F.col("MAKETXT"))
    named = F.col("MAKETXT").isNotNull() & (norm_text(F.col("MAKETXT")) != "UNKNOWN")
    brands = stage(
        t.complaints.filter((F.col("PROD_TYPE") == "V") & named)
        .groupBy(make.alias("VEHICLE_MAKE"))
        .agg(
            _rows().alias("TOTAL_COMPLAINTS"),
            F.sum("DEATHS").alias("TOTAL_DEATHS"),
            F.sum("INJURED").alias("TOTAL_INJURIES"),
            _yes("CRASH").alias("TOTAL_CRASHES"),
        )
    )
    average = brands.agg(F.avg("TOTAL_COMPLAINTS").alias("average")).scalar()
    return (
        brands.filter(F.col("TOTAL_COMPLAINTS") > average)
        .withColumn("NATIONAL_BRAND_AVERAGE", F.round(average, 0))
        .withColumns(_casualty_columns())
        .orderBy(*sort_by("-TOTAL_COMPLAINTS", "VEHICLE_MAKE"))
    )


# ---------------------------------------------------------------- failed the test, then recalled


def _low_rated_recalls(
    t: Tables, year: Column, max_stars: int, k: int, max_rows: int
) -> DataFrame:
    car = ["VEHICLE_MAKE", "VEHICLE_MODEL", "MODEL_YEAR"]
    low = t.ratings.filter(F.col("OVERALL_STARS") <= max_stars).select(
        norm_text(F.col("MAKE")).alias(car[0]),
        norm_text(F.col("MODEL")).alias(car[1]),
        F.col("MODEL_YR").cast("bigint").alias(car[2]),
    )
    wanted = F.col("COMPNAME").isNotNull() & (F.col("COMPNAME") != "") & (F.col("RCLTYPECD") != "X")
    rows = t.recalls.filter(wanted).select(
        norm_text(F.col("MAKETXT")).alias(car[0]),
        norm_text(F.col("MODELTXT")).alias(car[1]),
        year.alias(car[2]),
        norm_text(F.col("CAMPNO")).alias("campaign"),
        component_group(F.col("COMPNAME"), "anywhere").alias("PRIMARY_COMPONENT"),
        "POTAFF",
    )

    keys = [*car, "PRIMARY_COMPONENT"]
    grouped = (
        dedupe_measure(rows, [*keys, "campaign"], "POTAFF")
        .groupBy(*keys)
        .agg(
            F.count("campaign").alias("RECALL_CAMPAIGNS_ISSUED"),
            F.sum("POTAFF").alias("TOTAL_VEHICLES_RECALLED"),
        )
    )
    named = keep_existing(grouped, low, max_rows)
    return topk(
        named, k, "-TOTAL_VEHICLES_RECALLED", "VEHICLE_MAKE", "VEHICLE_MODEL", "MODEL_YEAR", "PRIMARY_COMPONENT"
    )


def q15(t: Tables, max_stars: int = 2, k: int = 25, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Recalls of cars with a low crash-test rating; the year is read from its digits."""
    return _low_rated_recalls(t, digits_year(F.col("YEARTXT")), max_stars, k, max_rows)


def q16(t: Tables, max_stars: int = 2, k: int = 25, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """q15 with the year text taken as a number, so annotated years do not match."""
    return _low_rated_recalls(t, try_year(F.col("YEARTXT")), max_stars, k, max_rows)


def q17(
    t: Tables,
    min_vehicles: int = 500_000,
    large: int = 5_000_000,
    high: float = 0.10,
    moderate: float = 0.02,
) -> DataFrame:
    """Share of each make's recalled vehicles under a do-not-drive or park-outside order, as a risk tier."""
    raw = norm_text(F.col("MAKETXT"))
    campaigns = (
        t.recalls.filter(F.col("MAKETXT").isNotNull() & (F.col("RCLTYPECD") == "V") & ~raw.isin(NO_BRAND))
        .groupBy(norm_make(F.col("MAKETXT")).alias("VEHICLE_MAKE"), norm_text(F.col("CAMPNO")).alias("campaign"))
        .agg(
            F.max("POTAFF").alias("vehicles"),
            F.bool_or(is_yes(F.col("DO_NOT_DRIVE")) | is_yes(F.col("PARK_OUTSIDE"))).alias("severe"),
        )
    )
    total, severe = F.col("TOTAL_VEHICLES_RECALLED"), F.col("SEVERE_VEHICLES_RECALLED")
    return (
        campaigns.groupBy("VEHICLE_MAKE")
        .agg(
            F.count("campaign").alias("TOTAL_SAFETY_CAMPAIGNS"),
            F.sum("vehicles").alias("TOTAL_VEHICLES_RECALLED"),
            F.sum(F.when(F.col("severe"), F.col("vehicles")).otherwise(0)).alias("SEVERE_VEHICLES_RECALLED"),
        )
        .filter(total > min_vehicles)
        .withColumns(
            {
                "SEVERE_RECALL_PCT": safe_ratio(severe, total, 2),
                "INVESTMENT_RISK_TIER": risk_tier(total, severe, large, high, moderate),
            }
        )
        .orderBy(*sort_by("-SEVERE_RECALL_PCT", "VEHICLE_MAKE"))
    )


# ---------------------------------------------------------------- training frames


def q18(t: Tables) -> DataFrame:
    """Training frame of the injury and death models: the rows of q06."""
    return q06(t)


def make_recall_links(t: Tables, min_complaints: int = 10) -> DataFrame:
    """q11 with a lower bar, no limit and no order."""
    return complaints_to_recalls(_named_complaints(t), t.recalls, min_complaints)


def q19(t: Tables, min_complaints: int = 10) -> DataFrame:
    """Training frame of the recall model."""
    return make_recall_links(t, min_complaints).orderBy(*sort_by("-COMPLAINT_COUNT", "MAKE"))

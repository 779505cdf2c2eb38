"""Chart-ready frames: what each figure draws, aggregated on the cluster.

Values a figure would compute row by row (labels, bubble sizes, millions, colours) are columns.
Groups with a missing key are left out here, as data-frame grouping does; equal values are
ordered by name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions.numbers import right_closed_bins, sign_bucket, to_numeric
from faultline.functions.taxonomy import (
    BODY_STYLE_CATEGORIES,
    COMPLAINT_NOISE,
    NOT_A_COMPONENT,
    OTHER_GROUP,
    RECALL_NOISE,
    consolidate_failures,
    map_or_keep,
    map_values,
    matches,
    not_in,
    tier_group,
)
from faultline.functions.text import (
    lower_strip,
    path_head,
    percent_text,
    short_number,
    shown,
    strip,
    thousands,
    title,
    truncate,
    vehicle_label,
)
from faultline.operators.grouping import exact_median, histogram, pivot_count, pivot_share, value_share
from faultline.operators.ranking import (
    first_per_key,
    keep_top_keys,
    nlargest,
    place_top_keys,
    sort_by,
    tail,
    topk,
    with_percent_rank,
    with_rank,
)
from faultline.operators.staging import stage
from faultline.plans import reports
from faultline.sources.tables import Tables

# Safety tiers by percentile, upper edge included.
TIER_EDGES = [-0.01, 0.25, 0.50, 0.75, 1.0]
TIER_LABELS = ["Top 25%", "25–50%", "50–75%", "Bottom 25%"]
DIRECTIONS = ["Improved", "No Change", "Declined"]

# Colour of each make in the bubble charts.
MAKE_COLORS = {
    "FORD": "#1f77b4",
    "CHEVROLET": "#ff7f0e",
    "TOYOTA": "#2ca02c",
    "DODGE": "#d62728",
    "JEEP": "#9467bd",
}


# Colours of the first five makes by place, and of the risk tiers, grey for any other.
PLACE_COLORS = ["#e94560", "#f5a623", "#00d2d3", "#a29bfe", "#55efc4"]
TIER_COLORS = {"HIGH RISK": "#e94560", "MODERATE RISK": "#f5a623", "LOW RISK": "#55efc4"}
OTHER_COLOR = "gray"


def _by_place(df: DataFrame, ranked: DataFrame, measure: Column | None = None) -> DataFrame:
    """``df`` with the colour of its make's place among the makes of ``ranked``."""
    places = place_top_keys(ranked, "MAKE", len(PLACE_COLORS), measure)
    color = F.get(F.array(*map(F.lit, PLACE_COLORS)), F.col("PLACE") - 1)
    return df.join(F.broadcast(places.select("MAKE", color.alias("COLOR"))), "MAKE")  # as many rows as colours


def _tier_color(tier: str) -> Column:
    return F.coalesce(map_values(F.col(tier), TIER_COLORS), F.lit(OTHER_COLOR))


def _present(df: DataFrame, *names: str) -> DataFrame:
    return df.na.drop(subset=list(names))


def _total(name: str) -> Column:
    """Sum that is 0 rather than missing when every value is missing."""
    return F.coalesce(F.sum(name), F.lit(0))


# ---------------------------------------------------------------- q01, q02


def plot_q01(t: Tables) -> DataFrame:
    """q01 with style codes merged into categories; the averages of the codes are averaged unweighted."""
    means = ["AVG_OVERALL_STARS", "AVG_FRONTAL_STARS", "AVG_SIDE_STARS", "AVG_ROLLOVER_STARS"]
    named = reports.q01(t).withColumn(
        "BODY_STYLE_CLEAN", map_or_keep(F.col("BODY_STYLE"), BODY_STYLE_CATEGORIES)
    )
    return (
        _present(named, "BODY_STYLE_CLEAN")
        .groupBy("BODY_STYLE_CLEAN")
        .agg(
            F.sum("VEHICLES_RATED").alias("VEHICLES_RATED"), *[F.round(F.avg(m), 6).alias(m) for m in means]
        )
        .orderBy(*sort_by("-AVG_OVERALL_STARS", "BODY_STYLE_CLEAN"))
    )


def plot_q02a(t: Tables) -> DataFrame:
    """Improved / unchanged / declined vehicles per model year."""
    changes = reports.add_make_trend(reports.rated(t)).withColumn(
        "DIRECTION", sign_bucket(F.col("STAR_CHANGE"))
    )
    return pivot_count(changes, "MODEL_YR", "DIRECTION", DIRECTIONS).orderBy("MODEL_YR")


def _trend_of_top_makes(t: Tables) -> DataFrame:
    """Features of the five makes with the most ratings; whole makes are kept, so they stay as they are."""
    return reports.add_make_trend(keep_top_keys(reports.rated(t), "MAKE", 5))


def plot_q02b(t: Tables) -> DataFrame:
    """Mean three-row average per year of the five largest makes."""
    means = (
        _present(_trend_of_top_makes(t), "ROLLING_3YR_AVG", "MODEL_YR")
        .groupBy("MAKE", "MODEL_YR")
        .agg(F.round(F.avg("ROLLING_3YR_AVG"), 4).alias("ROLLING_AVG"))
    )
    return _by_place(means, reports.rated(t)).orderBy("MAKE", "MODEL_YR")


def plot_q02c(t: Tables) -> DataFrame:
    """Share of each safety tier per model year."""
    ranked = with_percent_rank(reports.rated(t), "OVERALL_STARS", "SAFETY_PERCENTILE")
    tiers = ranked.withColumn(
        "PERCENTILE_TIER", right_closed_bins(F.col("SAFETY_PERCENTILE"), TIER_EDGES, TIER_LABELS)
    )
    return pivot_share(tiers, "MODEL_YR", "PERCENTILE_TIER", TIER_LABELS).orderBy("MODEL_YR")


def plot_q02d(t: Tables) -> DataFrame:
    """Cumulative high ratings per year of the five largest makes."""
    highs = (
        _present(_trend_of_top_makes(t), "MODEL_YR")
        .groupBy("MAKE", "MODEL_YR")
        .agg(F.max("CUMULATIVE_HIGH_RATINGS").alias("CUMULATIVE_HIGH_RATINGS"))
    )
    return _by_place(highs, reports.rated(t)).orderBy("MAKE", "MODEL_YR")


def plot_q02e(t: Tables) -> DataFrame:
    """Vehicles sharing the first rank of each model year."""
    ranked = with_rank(reports.rated(t), ["MODEL_YR"], "OVERALL_STARS", "RANK_IN_YEAR")
    first = _present(ranked, "MODEL_YR").filter(F.col("RANK_IN_YEAR") == 1)
    return first.groupBy("MODEL_YR").agg(F.count(F.lit(1)).alias("RANK1_VEHICLES")).orderBy("MODEL_YR")


# ---------------------------------------------------------------- q03 - q06


def plot_q03(t: Tables) -> DataFrame:
    """q03 from the shortest bar to the longest, with bar and severity labels."""
    return (
        reports.q03(t)
        .select(
            "MAKE",
            "TOTAL_COMPLAINTS",
            thousands(F.col("TOTAL_COMPLAINTS")).alias("BAR_LABEL"),
            F.concat(F.lit("Deaths/Complaint: "), percent_text(F.col("DEATH_RATE_PER_COMPLAINT"), 4)).alias(
                "DEATH_LABEL"
            ),
        )
        .orderBy("TOTAL_COMPLAINTS", F.col("MAKE").desc_nulls_first())
    )


def plot_q04(t: Tables, last_year: float = 2026) -> DataFrame:
    """Rank and volume per year of the five makes with the most complaints in proper years."""
    yearly = reports.q04(t).select(
        "MAKE", to_numeric(F.col("MODEL_YEAR")).alias("MODEL_YEAR"), "RANK_IN_YEAR", "COMPLAINTS"
    )
    proper = yearly.filter(F.col("MODEL_YEAR") <= last_year)
    return _by_place(proper, proper, F.sum("COMPLAINTS")).orderBy("MAKE", "MODEL_YEAR")


def plot_q05a(t: Tables) -> DataFrame:
    """Ten largest rows labelled as totals of a make."""
    totals = reports.q05(t).filter(
        (F.col("COMPONENT") == reports.ALL_COMPONENTS) & (F.col("MAKE") != reports.ALL_MAKES)
    )
    return nlargest(totals.select("MAKE", "COMPLAINT_COUNT"), 10, "COMPLAINT_COUNT", "MAKE")


def plot_q05b(t: Tables) -> DataFrame:
    """Ten most reported failures, similar narratives merged, empty ones left out.

    These are the detail rows of q05 added up by failure. Rows are named before they are
    grouped, so whole narratives are not shuffled where a pattern matches.
    """
    named = _present(t.complaints.select("CDESCR", "MAKETXT"), "CDESCR", "MAKETXT")
    stripped = F.col("STRIPPED")
    telling = named.withColumn("STRIPPED", strip(F.col("CDESCR"))).filter(
        not_in(F.lower(stripped), NOT_A_COMPONENT)
        & not_in(lower_strip(F.col("MAKETXT")), NOT_A_COMPONENT)
        & ~matches(stripped, COMPLAINT_NOISE)
    )
    totals = telling.groupBy(consolidate_failures(F.col("CDESCR"), stripped).alias("FAILURE")).agg(
        F.count(F.lit(1)).alias("COMPLAINT_COUNT")
    )
    return nlargest(totals, 10, "COMPLAINT_COUNT", "FAILURE").select(
        truncate(F.col("FAILURE"), 35).alias("COMPONENT"), "COMPLAINT_COUNT"
    )


def plot_q06a(t: Tables) -> DataFrame:
    """Fifteen most complained-about rated cars."""
    top = topk(
        reports.q06(t), 15, "-COMPLAINT_COUNT", "MAKE", "MODEL", "MODEL_YEAR", "OVERALL_STARS", "ROLLOVER_STARS"
    )
    return top.select(F.concat("MAKE", F.lit(" "), "MODEL").alias("LABEL"), "COMPLAINT_COUNT")


def plot_q06b(t: Tables) -> DataFrame:
    """Bubbles: stars against complaints, sized by injuries, coloured by rollover stars."""
    injuries = F.coalesce("TOTAL_INJURIES", F.lit(0))
    return _present(reports.q06(t), "OVERALL_STARS", "COMPLAINT_COUNT").select(
        "OVERALL_STARS", "COMPLAINT_COUNT", (injuries * 2 + 20).alias("BUBBLE_SIZE"), "ROLLOVER_STARS"
    )


# ---------------------------------------------------------------- q07 - q09


def plot_q07(t: Tables) -> DataFrame:
    """First fifteen fully named rows of q07."""
    named = _present(reports.q07(t), "MAKE", "MODEL", "COMPONENT")
    top = topk(named, 15, "-INVESTIGATION_COUNT", "MAKE", "MODEL", "COMPONENT")
    return top.select(
        vehicle_label(F.col("MAKE"), F.col("MODEL"), F.col("COMPONENT")).alias("LABEL"), "INVESTIGATION_COUNT"
    )


def plot_q08(t: Tables) -> DataFrame:
    """First fifteen makes of q08."""
    top = topk(reports.q08(t), 15, "-TOTAL_VEHICLES_AFFECTED", "MAKE")
    return top.select(
        "MAKE", "TOTAL_VEHICLES_AFFECTED", thousands(F.col("TOTAL_VEHICLES_AFFECTED")).alias("BAR_LABEL")
    )


def _cube_detail(t: Tables, makes: Sequence[str]) -> DataFrame:
    detail = reports.q09(t, makes).filter(
        (F.col("MAKE") != reports.ALL_MAKES) & (F.col("COMPONENT") != reports.ALL_COMPONENTS)
    )
    return detail.filter(~matches(F.col("COMPONENT"), RECALL_NOISE))


def plot_q09a(t: Tables, makes: Sequence[str] = reports.CUBE_MAKES) -> DataFrame:
    """Ten component groups with the most campaigns."""
    groups = (
        _cube_detail(t, makes)
        .groupBy(strip(path_head(F.col("COMPONENT"))).alias("GROUP"))
        .agg(_total("RECALL_COUNT").alias("RECALL_COUNT"))
    )
    return nlargest(groups, 10, "RECALL_COUNT", "GROUP").select(
        truncate(F.col("GROUP"), 30).alias("COMPONENT_GROUP"), "RECALL_COUNT"
    )


def plot_q09b(t: Tables, makes: Sequence[str] = reports.CUBE_MAKES) -> DataFrame:
    """Campaigns per make."""
    per_make = _cube_detail(t, makes).groupBy("MAKE").agg(_total("RECALL_COUNT").alias("RECALL_COUNT"))
    return per_make.orderBy("RECALL_COUNT", "MAKE")


# ---------------------------------------------------------------- q10, q11

# Order of q10 as far as it decides which row of a campaign or action comes first.
_RECALL_ORDER = ["-POTAFF", "CAMPNO", "MAKETXT"]


def linked_campaigns(t: Tables) -> DataFrame:
    """First q10 row of every campaign: the campaign's first recall row, if it has an investigation.

    The pairs of q10 are never formed; the semi-join and the first row do not need them.
    """
    firsts = first_per_key(
        t.recalls.filter(F.col("CAMPNO").isNotNull()).select("CAMPNO", "MAKETXT", "COMPNAME", "POTAFF"),
        ["CAMPNO"],
        sort_by("-POTAFF", "MAKETXT", "COMPNAME"),
    )
    known = t.investigations.select("CAMPNO").distinct()
    return firsts.join(known, "CAMPNO", "left_semi")


def linked_actions(t: Tables, campaigns: DataFrame | None = None) -> DataFrame:
    """First q10 row of every investigation: its make comes from the largest linked campaign.

    ``campaigns`` are the linked campaigns, if the caller has them already.
    """
    firsts = linked_campaigns(t) if campaigns is None else campaigns
    links = t.investigations.filter(F.col("CAMPNO").isNotNull()).select("CAMPNO", "ACTION_NUMBER").distinct()
    joined = links.join(firsts.select("CAMPNO", "MAKETXT", "POTAFF"), "CAMPNO")
    return first_per_key(joined, ["ACTION_NUMBER"], sort_by(*_RECALL_ORDER))


def _actions_per_make(t: Tables, campaigns: DataFrame | None = None) -> DataFrame:
    return (
        _present(linked_actions(t, campaigns), "MAKETXT")
        .groupBy(F.col("MAKETXT").alias("MAKE"))
        .agg(F.countDistinct("ACTION_NUMBER").alias("INVESTIGATIONS"))
    )


def plot_q10a(t: Tables) -> DataFrame:
    """Ten makes with the most linked investigations."""
    return nlargest(_actions_per_make(t), 10, "INVESTIGATIONS", "MAKE")


def plot_q10b(t: Tables) -> DataFrame:
    """Ten components with the most vehicles affected, each campaign counted once."""
    affected = (
        _present(linked_campaigns(t), "COMPNAME")
        .groupBy("COMPNAME")
        .agg(_total("POTAFF").alias("VEHICLES_AFFECTED"))
    )
    return nlargest(affected, 10, "VEHICLES_AFFECTED", "COMPNAME").select(
        truncate(F.col("COMPNAME"), 28).alias("COMPONENT"),
        "VEHICLES_AFFECTED",
        short_number(F.col("VEHICLES_AFFECTED")).alias("AXIS_LABEL"),
    )


def plot_q10c(t: Tables) -> DataFrame:
    """Ten makes with the most linked campaigns, next to their investigations (0 if none)."""
    linked = stage(linked_campaigns(t))  # one row per campaign, used twice
    campaigns = _present(linked, "MAKETXT").groupBy(F.col("MAKETXT").alias("MAKE")).agg(F.countDistinct("CAMPNO").alias("RECALLS"))
    top = nlargest(campaigns, 10, "RECALLS", "MAKE")
    return (
        top.join(_actions_per_make(t, linked), "MAKE", "left")
        .na.fill(0, subset=["INVESTIGATIONS"])
        .orderBy(*sort_by("-RECALLS", "MAKE"))
    )


def plot_q10d(t: Tables) -> DataFrame:
    """Thirty bins of log10 vehicles affected per linked campaign."""
    sized = linked_campaigns(t).filter(F.col("POTAFF") > 0).select(F.log10("POTAFF").alias("LOG10_AFFECTED"))
    return histogram(stage(sized), "LOG10_AFFECTED", 30).orderBy("BIN")


def plot_q10d_median(t: Tables) -> DataFrame:
    """Median size of a linked campaign, its place on the log axis and its label."""
    sized = linked_campaigns(t).filter(F.col("POTAFF") > 0)
    whole = F.floor("MEDIAN")
    return exact_median(sized, "POTAFF").select(
        "MEDIAN",
        F.round(F.log10("MEDIAN"), 6).alias("LOG10_MEDIAN"),
        F.concat(F.lit("Median: "), thousands(whole)).alias("LABEL"),
    )


def plot_q11(t: Tables) -> DataFrame:
    """First fifteen makes of q11 with their recall label."""
    top = topk(reports.q11(t), 15, "-COMPLAINT_COUNT", "MAKE")
    return top.select(
        "MAKE",
        "COMPLAINT_COUNT",
        F.concat(thousands(F.col("RELATED_RECALLS")), F.lit(" recalls")).alias("RECALL_LABEL"),
    ).orderBy("COMPLAINT_COUNT", F.col("MAKE").desc())


# ---------------------------------------------------------------- q12 - q14


def plot_q12(t: Tables, colors: Mapping[str, str] = MAKE_COLORS) -> DataFrame:
    """Bubbles: crash rate against casualty rate of every make and component group."""
    component = F.col("PRIMARY_COMPONENT")
    labels = [OTHER_GROUP, reports.ROLLUP_SUBTOTAL, reports.ROLLUP_ALL_COMPONENTS]
    return (
        reports.q12(t)
        .filter(not_in(component, labels))
        .select(
            "VEHICLE_MAKE",
            "PRIMARY_COMPONENT",
            "CRASH_RATE_PCT",
            "CASUALTY_RATE_PCT",
            F.round(F.col("TOTAL_COMPLAINTS") * 0.04, 6).alias("BUBBLE_SIZE"),
            map_values(F.col("VEHICLE_MAKE"), colors).alias("COLOR"),
        )
    )


def plot_q13(t: Tables, colors: Mapping[str, str] = MAKE_COLORS) -> DataFrame:
    """Bubbles: campaigns against millions of vehicles, from the detail rows of q13."""
    detail = (
        not_in(F.col("VEHICLE_MAKE"), [reports.CUBE_ALL_MAKES])
        & not_in(F.col("PRIMARY_COMPONENT"), [reports.CUBE_ALL_COMPONENTS])
        & not_in(F.col("RECALL_CLASSIFICATION"), [reports.CUBE_ALL_TYPES])
    )
    return (
        reports.q13(t)
        .filter(detail)
        .select(
            "VEHICLE_MAKE",
            "PRIMARY_COMPONENT",
            "RECALL_CLASSIFICATION",
            "TOTAL_RECALL_CAMPAIGNS",
            F.round(F.col("TOTAL_VEHICLES_AFFECTED") / 1e6, 6).alias("MILLIONS_AFFECTED"),
            F.round(F.col("AVG_VEHICLES_PER_RECALL") * 0.002, 6).alias("BUBBLE_SIZE"),
            map_values(F.col("VEHICLE_MAKE"), colors).alias("COLOR"),
        )
    )


def plot_q14a(t: Tables) -> DataFrame:
    """Last fifteen above-average makes by rising volume."""
    return tail(reports.q14(t).select("VEHICLE_MAKE", "TOTAL_COMPLAINTS"), 15, "TOTAL_COMPLAINTS", "VEHICLE_MAKE")


def plot_q14b(t: Tables) -> DataFrame:
    """Fifteen above-average makes with the highest crash rate."""
    return nlargest(
        reports.q14(t).select("VEHICLE_MAKE", "CRASH_RATE_PCT"), 15, "CRASH_RATE_PCT", "VEHICLE_MAKE"
    )


# ---------------------------------------------------------------- q15 - q17


def _millions(name: str) -> Column:
    return F.round(F.col(name) / 1e6, 6)


def plot_q15a(t: Tables) -> DataFrame:
    """Fifteen low-rated cars and components with the most vehicles recalled."""
    top = nlargest(
        reports.q15(t),
        15,
        "TOTAL_VEHICLES_RECALLED",
        "VEHICLE_MAKE",
        "VEHICLE_MODEL",
        "MODEL_YEAR",
        "PRIMARY_COMPONENT",
    )
    return top.select(
        vehicle_label(F.col("VEHICLE_MAKE"), F.col("VEHICLE_MODEL"), F.col("MODEL_YEAR")).alias("LABEL"),
        _millions("TOTAL_VEHICLES_RECALLED").alias("MILLIONS_RECALLED"),
    )


def plot_q15b(t: Tables) -> DataFrame:
    """Ten component groups with the most vehicles in q15."""
    groups = (
        _present(reports.q15(t), "PRIMARY_COMPONENT")
        .groupBy("PRIMARY_COMPONENT")
        .agg(_total("TOTAL_VEHICLES_RECALLED").alias("TOTAL_VEHICLES_RECALLED"))
    )
    return nlargest(groups, 10, "TOTAL_VEHICLES_RECALLED", "PRIMARY_COMPONENT").select(
        "PRIMARY_COMPONENT", _millions("TOTAL_VEHICLES_RECALLED").alias("MILLIONS_RECALLED")
    )


def plot_q16(t: Tables) -> DataFrame:
    """Twenty low-rated cars with the most vehicles recalled, component in title case."""
    top = nlargest(
        _present(reports.q16(t), "TOTAL_VEHICLES_RECALLED"),
        20,
        "TOTAL_VEHICLES_RECALLED",
        "VEHICLE_MAKE",
        "VEHICLE_MODEL",
        "MODEL_YEAR",
        "PRIMARY_COMPONENT",
    )
    car = vehicle_label(F.col("VEHICLE_MAKE"), F.col("VEHICLE_MODEL"), shown(F.col("MODEL_YEAR")))
    return top.select(
        F.concat(car, F.lit(" — "), title(F.col("PRIMARY_COMPONENT"))).alias("LABEL"),
        _millions("TOTAL_VEHICLES_RECALLED").alias("MILLIONS_RECALLED"),
        F.concat(F.col("RECALL_CAMPAIGNS_ISSUED").cast("string"), F.lit(" campaigns")).alias("BAR_LABEL"),
    )


def _risk_card(t: Tables, thresholds: Mapping[str, float]) -> DataFrame:
    return (
        _present(reports.q17(t, **thresholds), "SEVERE_RECALL_PCT")
        .withColumn("VEHICLE_MAKE", truncate(F.col("VEHICLE_MAKE"), 20))
        .withColumn("RISK_TIER", tier_group(F.col("INVESTMENT_RISK_TIER")))
    )


def plot_q17a(t: Tables, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Fifteen makes with the largest severe share."""
    top = nlargest(_risk_card(t, thresholds or {}), 15, "SEVERE_RECALL_PCT", "VEHICLE_MAKE")
    return top.select(
        "VEHICLE_MAKE", "SEVERE_RECALL_PCT", "INVESTMENT_RISK_TIER", "RISK_TIER", _tier_color("RISK_TIER").alias("COLOR")
    )


def plot_q17b(t: Tables, thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """How many makes fall into each tier, and their share."""
    shares = value_share(_risk_card(t, thresholds or {}).select("RISK_TIER"), "RISK_TIER")
    shares = shares.withColumns({"SHARE_LABEL": percent_text(F.col("SHARE") * 100, 0), "COLOR": _tier_color("RISK_TIER")})
    return shares.orderBy(*sort_by("-N", "RISK_TIER"))

"""Joins across the lifecycle whose sums come out as if every pair of rows had been joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.functions.numbers import try_year
from faultline.operators.staging import stage_all


def complaints_with_ratings(complaints: DataFrame, ratings: DataFrame) -> DataFrame:
    """Complaints matched to ratings on upper-cased make and model and on the numeric year.

    Both sides are grouped to the result's keys first, so one row per key meets one row per
    key and pair counts are products; a much-complained-about car never fans out.
    """
    cases = (
        complaints.select(
            "MAKETXT", "MODELTXT", "YEARTXT", "DEATHS", "INJURED", try_year(F.col("YEARTXT")).alias("_year")
        )
        .filter("_year IS NOT NULL AND MAKETXT IS NOT NULL AND MODELTXT IS NOT NULL")
        .groupBy("MAKETXT", "MODELTXT", "YEARTXT", "_year")
        .agg(
            F.count(F.lit(1)).alias("_cases"),
            F.sum("DEATHS").alias("_deaths"),
            F.sum("INJURED").alias("_injured"),
        )
        .withColumns({"_make": F.upper("MAKETXT"), "_model": F.upper("MODELTXT")})
    )
    stars = (
        ratings.filter("MAKE IS NOT NULL AND MODEL IS NOT NULL AND MODEL_YR IS NOT NULL")
        .groupBy(
            F.upper("MAKE").alias("_make"),
            F.upper("MODEL").alias("_model"),
            F.col("MODEL_YR").cast("bigint").alias("_year"),
            "OVERALL_STARS",
            "ROLLOVER_STARS",
        )
        .agg(F.count(F.lit(1)).alias("_rated"))
    )
    return cases.join(stars, ["_make", "_model", "_year"]).select(
        F.col("MAKETXT").alias("MAKE"),
        F.col("MODELTXT").alias("MODEL"),
        F.col("YEARTXT").alias("MODEL_YEAR"),
        (F.col("_cases") * F.col("_rated")).alias("COMPLAINT_COUNT"),
        (F.col("_deaths") * F.col("_rated")).alias("TOTAL_DEATHS"),
        (F.col("_injured") * F.col("_rated")).alias("TOTAL_INJURIES"),
        "OVERALL_STARS",
        "ROLLOVER_STARS",
    )


def complaints_to_recalls(
    complaints: DataFrame, recalls: DataFrame, min_complaints: int, fan_out: bool = True
) -> DataFrame:
    """Per make: distinct complaints, distinct recall campaigns of the same car, casualties.

    With ``fan_out`` casualties count once per matching recall row (a complaint without a
    match counts once), as a left join of the rows would; without it each complaint row
    counts once. Either way both sides are grouped per car before they meet.
    """
    car = ["_make", "_model", "YEARTXT"]
    named = complaints.withColumns({"_make": F.upper("MAKETXT"), "_model": F.upper("MODELTXT")})
    cars = named.groupBy("MAKETXT", *car).agg(
        F.sum("DEATHS").alias("_deaths"), F.sum("INJURED").alias("_injured")
    )
    recalled = recalls.select(
        F.upper("MAKETXT").alias("_make"), F.upper("MODELTXT").alias("_model"), "YEARTXT", "CAMPNO"
    ).filter("_make IS NOT NULL AND _model IS NOT NULL AND YEARTXT IS NOT NULL")
    campaigns = recalled.groupBy(*car, "CAMPNO").agg(F.count(F.lit(1)).alias("_rows"))
    volume = complaints.groupBy("MAKETXT").agg(F.countDistinct("CMPLID").alias("COMPLAINT_COUNT"))
    volume = volume.filter(F.col("COMPLAINT_COUNT") > min_complaints)
    cars, campaigns = stage_all(cars, campaigns)  # each is used twice

    # One row per car on both sides: casualties weighted by the recall rows of the car.
    rows_per_car = campaigns.groupBy(*car).agg(F.sum("_rows").alias("_rows"))
    weight = F.coalesce(F.col("_rows"), F.lit(1))
    casualties = (
        cars.join(rows_per_car, car, "left")
        .groupBy("MAKETXT")
        .agg(
            F.sum(F.col("_deaths") * weight).alias("_joined_deaths"),
            F.sum(F.col("_injured") * weight).alias("_joined_injured"),
            F.sum("_deaths").alias("_own_deaths"),
            F.sum("_injured").alias("_own_injured"),
        )
    )
    # Spellings of a car x its distinct campaigns; an inner join, so a hot car can be split.
    related = (
        cars.select("MAKETXT", *car)
        .join(campaigns.select(*car, "CAMPNO"), car)
        .groupBy("MAKETXT")
        .agg(F.countDistinct("CAMPNO").alias("_related"))
    )
    side = "_joined" if fan_out else "_own"
    return (
        volume.join(casualties, "MAKETXT")
        .join(related, "MAKETXT", "left")
        .select(
            F.col("MAKETXT").alias("MAKE"),
            "COMPLAINT_COUNT",
            F.coalesce("_related", F.lit(0)).alias("RELATED_RECALLS"),
            F.col(f"{side}_deaths").alias("DEATHS_FROM_COMPLAINTS"),
            F.col(f"{side}_injured").alias("INJURIES_FROM_COMPLAINTS"),
        )
    )

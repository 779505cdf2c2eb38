"""The four subject tables expressed over the star-schema test tables.

The mapping follows FIXTURES.md section 3: dirty spellings, missing values and bad
years are added by arithmetic on the order key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.sources.tables import Tables

# Columns read from the star-schema tables; naming them saves a schema-inference job per scan.
STAR_SCHEMAS = {
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": (
        "o_orderkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_discount DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": "event_id BIGINT, user_id BIGINT, event_type STRING, props STRING",
}

# Component path per p_size % 14.
COMPONENT_PATHS = [
    "SERVICE BRAKES, HYDRAULIC:FOUNDATION",
    "PARKING BRAKE",
    "ENGINE AND ENGINE COOLING:ENGINE",
    "FUEL SYSTEM, GASOLINE",
    "Electronic Stability Control",
    "VISIBILITY/WIPER",
    "EXTERIOR LIGHTING:HEADLIGHTS",
    " tires :TREAD",
    "AIR BAGS:FRONTAL",
    "STEERING",
    None,
    "UNKNOWN OR OTHER",
    "ELECTRICAL SYSTEM:LIGHTING RELAY",
    "",
]

# Complaint text per l_partkey % 9.
NARRATIVES = [
    "No summary given",
    "SEE ATTACHED",
    "Transmission will fail",
    "brakes failed",
    "AIR BAG light",
    "steering pulls",
    None,
    " seat belt stuck ",
    "paint peels",
]

# Body style code per p_type.
BODY_STYLES = {"SMALL": "2 DR", "ECONOMY": "5 HB", "MEDIUM": "4 DR", "STANDARD": "4DR", "LARGE": "SUV"}


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{root}/{name}.parquet")


def _choose(index: Column, values: list[str | None]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _brand(separator: str) -> Column:
    return F.upper(F.replace(F.col("p_brand"), F.lit("#"), F.lit(separator)))


def _parts(spark: SparkSession, root: str) -> DataFrame:
    """Everything that depends on the part alone, worked out once per part and not per joined row."""
    return _table(spark, root, "part").select(
        "p_partkey",
        _brand(" ").alias("brand"),
        _brand("-").alias("hyphenated"),
        F.upper("p_name").alias("model"),
        _choose(F.col("p_size") % 14, COMPONENT_PATHS).alias("component"),
        _choose(F.col("p_partkey") % 9, NARRATIVES).alias("narrative"),
        F.concat(F.lit("defect "), F.col("p_type")).alias("defect"),
    )


def _make(key: Column) -> Column:
    brand = F.col("brand")
    return (
        F.when(key % 53 == 0, F.lit(None).cast("string"))
        .when(key % 47 == 0, "UNKNOWN")
        .when(key % 29 == 0, F.col("hyphenated"))
        .when(key % 23 == 0, F.concat(F.lit(" "), brand, F.lit(" ")))
        .when(key % 19 == 0, F.lower(brand))
        .otherwise(brand)
    )


def _year_text(key: Column, day: Column) -> Column:
    year = F.year(day).cast("string")
    return (
        F.when(key % 41 == 0, F.lit(None).cast("string"))
        .when(key % 37 == 0, "N/A")
        .when(key % 31 == 0, F.concat(F.lit("MY"), year))
        .otherwise(year)
    )


def _yes_no(flag: Column) -> Column:
    return F.when(flag, "Y").otherwise("N")


def ratings(spark: SparkSession, root: str) -> DataFrame:
    part = _table(spark, root, "part")
    key, size = F.col("p_partkey"), F.col("p_size")

    def stars(shift: int) -> Column:
        return (1 + (size + shift) % 5).cast("int")

    style = F.lit("XX")
    for kind, code in reversed(BODY_STYLES.items()):
        style = F.when(F.col("p_type") == kind, code).otherwise(style)
    return part.select(
        key.alias("RATING_ID"),
        _brand(" ").alias("MAKE"),
        F.col("p_name").alias("MODEL"),
        style.alias("BODY_STYLE"),
        (1995 + key % 7).cast("int").alias("MODEL_YR"),
        F.when(key % 11 != 0, stars(0)).alias("OVERALL_STARS"),
        stars(1).alias("OVERALL_FRNT_STARS"),
        stars(2).alias("OVERALL_SIDE_STARS"),
        F.when(key % 13 != 0, stars(3)).alias("ROLLOVER_STARS"),
        F.col("p_retailprice").alias("ROLLOVER_POSSIBILITY"),
    )


def complaints(spark: SparkSession, root: str) -> DataFrame:
    line = _table(spark, root, "lineitem")
    part = _parts(spark, root)
    key, number = F.col("l_orderkey"), F.col("l_linenumber")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        (key * 10 + number).alias("CMPLID"),
        _make(key).alias("MAKETXT"),
        F.col("model").alias("MODELTXT"),
        _year_text(key, F.col("l_shipdate")).alias("YEARTXT"),
        F.when(number != 7, F.round(F.col("l_discount") * 100).cast("int")).alias("DEATHS"),
        F.col("l_quantity").cast("int").alias("INJURED"),
        _yes_no(F.col("l_returnflag") == "R").alias("CRASH"),
        _yes_no(F.col("l_returnflag") == "A").alias("FIRE"),
        F.when(F.col("l_linestatus") == "O", "V").otherwise("E").alias("PROD_TYPE"),
        F.col("component").alias("COMPDESC"),
        F.col("narrative").alias("CDESCR"),
    )


def recalls(spark: SparkSession, root: str) -> DataFrame:
    order = _table(spark, root, "orders")
    line = _table(spark, root, "lineitem")
    part = _parts(spark, root)
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    rows = line.join(part, line.l_partkey == part.p_partkey).join(order, line.l_orderkey == order.o_orderkey)
    return rows.select(
        key.cast("string").alias("CAMPNO"),
        _make(key).alias("MAKETXT"),
        F.col("model").alias("MODELTXT"),
        _year_text(key, F.col("o_orderdate")).alias("YEARTXT"),
        F.when(key % 17 != 0, F.floor("o_totalprice").cast("bigint")).alias("POTAFF"),
        F.col("component").alias("COMPNAME"),
        F.when(key % 43 == 0, F.lit(None).cast("string"))
        .when(key % 9 == 0, "X")
        .when(F.col("o_orderstatus") == "P", "E")
        .otherwise("V")
        .alias("RCLTYPECD"),
        F.when((priority == "1-URGENT") & (key % 2 == 0), "Y")
        .when(priority == "1-URGENT", " yes")
        .otherwise("N")
        .alias("DO_NOT_DRIVE"),
        F.when((priority == "2-HIGH") & (key % 5 == 0), "Y").alias("PARK_OUTSIDE"),
        F.col("defect").alias("DESC_DEFECT"),
        F.col("l_linenumber").alias("SRC_LINE"),
    )


def investigations(spark: SparkSession, root: str) -> DataFrame:
    event = _table(spark, root, "events")
    key, user = F.col("event_id"), F.col("user_id")
    return event.select(
        F.concat(F.lit("PE"), (key % 500).cast("string")).alias("ACTION_NUMBER"),
        F.concat(F.lit("BRAND "), (1 + user % 25).cast("string")).alias("MAKE"),
        F.col("event_type").alias("MODEL"),
        F.when(key % 21 != 0, F.col("event_type")).alias("COMPNAME"),
        F.when(key % 3 != 0, (key % 1500).cast("string")).alias("CAMPNO"),
        (1995 + user % 7).cast("int").alias("YEAR"),
        F.col("event_type").alias("SUBJECT"),
        F.col("props").alias("SUMMARY"),
    )


def role_tables(spark: SparkSession, root: str) -> Tables:
    """The four subject tables over the star-schema parquet files in ``root``."""
    return Tables(
        ratings=lambda: ratings(spark, root),
        complaints=lambda: complaints(spark, root),
        investigations=lambda: investigations(spark, root),
        recalls=lambda: recalls(spark, root),
    )

"""Fixed vocabularies: component groups, recall types, body styles, noise, risk tiers."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, functions as F

from faultline.functions.numbers import severity
from faultline.functions.text import norm_text, path_head, strip

# Component group and the first path parts that belong to it, in rule order.
COMPONENT_GROUPS = {
    "BRAKES & BRAKING SYSTEMS": [
        "SERVICE BRAKES, HYDRAULIC", "SERVICE BRAKES", "SERVICE BRAKES, AIR", "SERVICE BRAKES, ELECTRIC",
        "PARKING BRAKE",
    ],
    "ENGINE & COOLING": ["ENGINE", "ENGINE AND ENGINE COOLING"],
    "FUEL & PROPULSION SYSTEM": [
        "FUEL SYSTEM, GASOLINE", "FUEL/PROPULSION SYSTEM", "FUEL SYSTEM, OTHER", "FUEL SYSTEM, DIESEL",
        "HYBRID PROPULSION SYSTEM",
    ],
    "ELECTRONIC STABILITY & TRACTION": [
        "ELECTRONIC STABILITY CONTROL (ESC)", "ELECTRONIC STABILITY CONTROL", "TRACTION CONTROL SYSTEM",
    ],
    "VISIBILITY & WIPERS": ["VISIBILITY", "VISIBILITY/WIPER"],
    "LIGHTING SYSTEMS": ["EXTERIOR LIGHTING", "INTERIOR LIGHTING"],
    "TIRES & WHEELS": ["TIRES", "WHEELS"],
    "ADAS & ADVANCED TECHNOLOGY": [
        "FORWARD COLLISION AVOIDANCE", "LANE DEPARTURE", "BACK OVER PREVENTION", "COMMUNICATION",
    ],
    "EQUIPMENT & ACCESSORIES": ["EQUIPMENT", "EQUIPMENT ADAPTIVE/MOBILITY", "TRAILER HITCHES"],
    "CHILD SEAT & RESTRAINT EQUIPMENT": [
        "CHILD SEAT", "CHEST CLIP, BUCKLE, HARNESS", "CARRY HANDLE, SHELL, BASE",
        "TETHER, LOWER ANCHOR (ON CAR SEAT OR VEHICLE)", "INSERT, PADDING",
    ],
    "OTHER / UNKNOWN": [
        "UNKNOWN OR OTHER", "OTHER/I AM NOT SURE", "OTHER/UNKNOWN", "NONE", "1", "120", "FIRERELATED", "",
    ],
}
LIGHTING_GROUP = "LIGHTING SYSTEMS"
LIGHTING_WORD = "LIGHTING"
OTHER_GROUP = "OTHER / UNKNOWN"

# Recall type code and its name.
RECALL_TYPES = {
    "V": "VEHICLE RECALL",
    "E": "EQUIPMENT RECALL",
    "T": "TIRE RECALL",
    "C": "CHILD SEAT RECALL",
}

# Spellings that count as a set flag.
YES_SPELLINGS = ["Y", "YES", "1", "TRUE"]

# Makes that name nobody.
NO_MAKE = ["UNKNOWN", "OTHER", ""]
NO_BRAND = ["UNKNOWN", "OTHER", "ALL", ""]

# Body style code and the category it is shown under.
BODY_STYLE_CATEGORIES = {
    "2 DR": "2-Door Coupe",
    "3 HB": "Hatchback",
    "3C": "Coupe",
    "4": "4-Door Sedan",
    "4 DR": "4-Door Sedan",
    "4 DR Early Release": "4-Door Sedan",
    "4DR": "4-Door Sedan",
    "4DR SUV": "SUV",
    "5 HB": "Hatchback",
    "5HB": "Hatchback",
    "C": "Coupe",
    "EXTENDED SUV": "SUV",
    "HYBRID PU/CC": "Pickup Truck",
    "MV": "Minivan",
    "PU/CC": "Pickup Truck",
    "PU/CC Early Release": "Pickup Truck",
    "PU/CC Later Release": "Pickup Truck",
    "PU/EC": "Pickup Truck",
    "PU/RC": "Pickup Truck",
    "PV": "Passenger Van",
    "PV LATER RELEASE": "Passenger Van",
    "SUV": "SUV",
    "SUV EARLY RELEASE": "SUV",
    "SUV Early Release": "SUV",
    "SUV Later Release": "SUV",
    "SW": "Station Wagon",
    "VAN": "Van",
    "WAGON": "Station Wagon",
}

# Complaint texts that say nothing, and component names left out of the recall chart.
COMPLAINT_NOISE = (
    r"(?i)^no summary|^see attached|^n/a$|^none$|^na$|^not applicable$|^unknown$|^takata recall$"
)
RECALL_NOISE = r"(?i)LABELS|ADAPTIVE/MOBILITY|EQUIPMENT:OTHER|UNKNOWN|OTHER/I AM NOT SURE"
NOT_A_COMPONENT = ["-- all components --", "-- all makes --", "unknown", "unspecified"]

# Complaint text pattern and the failure it is counted as.
FAILURE_PATTERNS = {
    r"(?i)^transmission.*fail": "TRANSMISSION FAILURE",
    r"(?i)^brake.*fail": "BRAKE FAILURE",
    r"(?i)^engine.*fail": "ENGINE FAILURE",
    r"(?i)^power train": "POWER TRAIN",
    r"(?i)^air bag": "AIR BAGS",
    r"(?i)^air bags": "AIR BAGS",
    r"(?i)^electrical.*system": "ELECTRICAL SYSTEM",
    r"(?i)^service brake": "SERVICE BRAKES",
    r"(?i)^steering.*": "STEERING",
    r"(?i)^seat belt": "SEAT BELTS",
    r"(?i)^fuel system": "FUEL SYSTEM",
}

# Risk tier names.
TIER_SOFTWARE = "LOW RISK (Software / OTA Dominant Profile)"
TIER_HIGH = "HIGH RISK (Monitor Closely - Capital Intensive)"
TIER_MODERATE = "MODERATE RISK (Standard Warranty Outlay)"
TIER_ROUTINE = "LOW RISK (Routine Maintenance Variance)"


def literal_map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def map_values(c: Column, values: Mapping[str, str]) -> Column:
    """Dictionary lookup, NULL for an unknown key. For dictionaries short enough to be a literal."""
    return F.try_element_at(literal_map(values), c)


def map_or_keep(c: Column, values: Mapping[str, str]) -> Column:
    return F.coalesce(map_values(c, values), c)


def component_group(path: Column, lighting: str = "prefix") -> Column:
    """Group of a component path.

    ``lighting='prefix'`` judges by the first path part alone; ``'anywhere'`` also counts a
    path naming lighting further down, unless an earlier rule already took its first part.
    """
    if lighting not in ("prefix", "anywhere"):
        raise ValueError("lighting is 'prefix' or 'anywhere'")
    head = norm_text(path_head(path))
    group = map_values(head, {part: label for label, parts in COMPONENT_GROUPS.items() for part in parts})
    named = F.coalesce(group, head, F.lit(OTHER_GROUP))
    if lighting == "prefix":
        return named
    labels = list(COMPONENT_GROUPS)
    earlier = labels[: labels.index(LIGHTING_GROUP)]
    taken = F.coalesce(group.isin(earlier), F.lit(False))
    return F.when(~taken & F.contains(F.upper(path), F.lit(LIGHTING_WORD)), LIGHTING_GROUP).otherwise(named)


def recall_type_name(code: Column) -> Column:
    return map_or_keep(code, RECALL_TYPES)


def is_yes(c: Column) -> Column:
    return F.coalesce(norm_text(c).isin(YES_SPELLINGS), F.lit(False))


def matches(c: Column, pattern: str) -> Column:
    """Pattern found in the text; a missing text matches nothing. A dot stops at line feeds only, and case folds in all
    scripts."""
    return F.coalesce(F.rlike(c, F.lit("(?du)" + pattern)), F.lit(False))


def not_in(c: Column, values: list[str]) -> Column:
    """Not in the list; a missing value is in no list."""
    return c.isNull() | ~c.isin(values)


def consolidate_failures(
    c: Column, stripped: Column | None = None, patterns: Mapping[str, str] = FAILURE_PATTERNS
) -> Column:
    """First failure whose pattern matches the stripped text, otherwise the text as it is.

    ``stripped`` may name a column that holds the stripped text already.
    """
    tested = strip(c) if stripped is None else stripped
    out = c
    for pattern, name in reversed(patterns.items()):
        out = F.when(matches(tested, pattern), name).otherwise(out)
    return out


def risk_tier(total: Column, severe: Column, large: int, high: float, moderate: float) -> Column:
    share = severity(total, severe)
    return (
        F.when((severe == 0) & (total > large), TIER_SOFTWARE)
        .when(share > high, TIER_HIGH)
        .when(share > moderate, TIER_MODERATE)
        .otherwise(TIER_ROUTINE)
    )


def tier_group(tier: Column) -> Column:
    """Tier without its explanation; both low tiers become one."""
    return F.when(F.contains(tier, F.lit("LOW RISK")), "LOW RISK").otherwise(
        F.trim(F.split_part(tier, F.lit("("), F.lit(1)))
    )

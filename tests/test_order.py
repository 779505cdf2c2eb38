"""Reports come in the order that their ORDER BY states: keys compared one after another, missing values last."""

import pytest

import __spark_entry__ as entry_point
from conftest import SMALL

# The visible keys of each report's ORDER BY; a minus is descending.
ORDERS = {
    "q01": "-AVG_OVERALL_STARS BODY_STYLE",
    "q03": "-TOTAL_COMPLAINTS MAKE",
    "q04": "MODEL_YEAR RANK_IN_YEAR MAKE",
    "q06": "-COMPLAINT_COUNT MAKE MODEL MODEL_YEAR",
    "q07": "-INVESTIGATION_COUNT MAKE MODEL COMPONENT",
    "q08": "-TOTAL_VEHICLES_AFFECTED MAKE",
    "q08_dedup": "-TOTAL_VEHICLES_AFFECTED MAKE",
    "q11": "-COMPLAINT_COUNT MAKE",
    "q11_exact": "-COMPLAINT_COUNT MAKE",
    "q14": "-TOTAL_COMPLAINTS VEHICLE_MAKE",
    "q17": "-SEVERE_RECALL_PCT VEHICLE_MAKE",
    "q18": "-COMPLAINT_COUNT MAKE MODEL MODEL_YEAR",
    "q19": "-COMPLAINT_COUNT MAKE",
}
LARGER = {"q17": "/root/testdata/sf0.01"}  # without rows on the smallest tables


def out_of_order(rows, keys):
    """The first two neighbours that stand the wrong way round, None if there are none."""
    for a, b in zip(rows, rows[1:]):
        for key in keys.split():
            x, y = a[key.lstrip("-")], b[key.lstrip("-")]
            if x == y:
                continue
            right = y is None or (x is not None and (x > y if key[0] == "-" else x < y))
            if not right:
                return a, b
            break
    return None


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_rows_come_in_order(spark, name):
    rows = entry_point.queries()[name](spark, LARGER.get(name, SMALL)).collect()
    keys = ORDERS[name]
    assert len(rows) > 1 and out_of_order(rows, keys) is None
    # The data tell the first key from its reverse.
    first, *rest = keys.split()
    reverse = first[1:] if first[0] == "-" else f"-{first}"
    assert out_of_order(rows, " ".join([reverse, *rest])) is not None


def test_missing_values_are_last():
    rows = [{"a": 1, "b": 2}, {"a": 1, "b": None}, {"a": None, "b": 0}]
    assert out_of_order(rows, "a b") is None and out_of_order(rows, "a -b") is None
    assert out_of_order(rows[::-1], "a b") is not None and out_of_order(rows[1::-1], "-b") is not None

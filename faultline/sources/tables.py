"""The four subject tables, read from parquet or from the session catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Column layout of the four tables (DDL text, parsed by Spark).
SCHEMAS = {
    "ratings": (
        "MAKE STRING, MODEL STRING, MODEL_YR INT, BODY_STYLE STRING, OVERALL_STARS INT, "
        "OVERALL_FRNT_STARS INT, OVERALL_SIDE_STARS INT, ROLLOVER_STARS INT, ROLLOVER_POSSIBILITY DOUBLE"
    ),
    "complaints": (
        "CMPLID BIGINT, MAKETXT STRING, MODELTXT STRING, YEARTXT STRING, DEATHS INT, INJURED INT, "
        "CRASH STRING, FIRE STRING, PROD_TYPE STRING, COMPDESC STRING, CDESCR STRING"
    ),
    "investigations": (
        "ACTION_NUMBER STRING, MAKE STRING, MODEL STRING, COMPNAME STRING, CAMPNO STRING, YEAR INT, "
        "SUBJECT STRING, SUMMARY STRING"
    ),
    "recalls": (
        "CAMPNO STRING, MAKETXT STRING, MODELTXT STRING, YEARTXT STRING, POTAFF BIGINT, COMPNAME STRING, "
        "RCLTYPECD STRING, DO_NOT_DRIVE STRING, PARK_OUTSIDE STRING, DESC_DEFECT STRING"
    ),
}


class Tables:
    """Lazy handles on the four tables; a table is only opened when a report asks for it."""

    def __init__(self, **loaders: Callable[[], DataFrame]):
        self._loaders = loaders
        self._opened: dict[str, DataFrame] = {}

    def _open(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self._loaders[name]()
        return self._opened[name]

    @property
    def ratings(self) -> DataFrame:
        return self._open("ratings")

    @property
    def complaints(self) -> DataFrame:
        return self._open("complaints")

    @property
    def investigations(self) -> DataFrame:
        return self._open("investigations")

    @property
    def recalls(self) -> DataFrame:
        return self._open("recalls")


def read_parquet(spark: SparkSession, root: str) -> Tables:
    """Tables stored as ``<root>/<table>`` parquet, read with the fixed column layout."""
    return Tables(
        **{
            name: (lambda n=name, s=schema: spark.read.schema(s).parquet(f"{root}/{n}"))
            for name, schema in SCHEMAS.items()
        }
    )


def read_catalog(spark: SparkSession, schema: str, names: dict[str, str] | None = None) -> Tables:
    """Tables registered in the catalog as ``<schema>.<name>``; ``names`` maps our names to theirs."""
    names = names or {}
    return Tables(**{n: (lambda t=f"{schema}.{names.get(n, n)}": spark.table(t)) for n in SCHEMAS})

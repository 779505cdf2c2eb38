"""Named queries over the star-schema test tables: ``name -> (spark, folder) -> DataFrame``.

Literals that name real makes or real volumes are replaced by values that occur in the test
tables; the functions keep the original ones as defaults.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.plans import charts, models, probes, reports
from faultline.sources.roles import role_tables
from faultline.sources.tables import Tables

TEST_MAKES = ["BRAND 1", "BRAND 2", "BRAND 3", "BRAND 4", "BRAND 5"]
TEST_TIERS = {"min_vehicles": 282_000_000, "high": 0.25, "moderate": 0.23}
TEST_LAST_YEAR = 2000
TEST_COLORS = {f"BRAND {i}": f"#0000{i:02d}" for i in range(1, 13)}

Query = Callable[[SparkSession, str], DataFrame]


def _recall_rule_rows(t: Tables) -> DataFrame:
    """Test rows of the recall frame scored by a fixed rule on the complaint count."""
    return models.score_rule(models.recalls_frame(t), F.col("COMPLAINT_COUNT") > 500)


def _injury_rule_rows(t: Tables) -> DataFrame:
    """Test rows of the injury frame scored as 25 injuries per complaint."""
    return models.score_rule(models.injuries_frame(t), F.col("COMPLAINT_COUNT") * 25)


def _fitted_metrics(fitted: models.Fitted, linear: bool) -> DataFrame:
    metrics = models.regression_metrics if linear else models.classification_metrics
    return metrics(fitted.scored, fitted.name)


def _coefficients(*fits: models.Fitted) -> DataFrame:
    return reduce(DataFrame.unionByName, [models.coefficients(f) for f in fits])


def _split_counts(t: Tables) -> DataFrame:
    frame = models.injuries_frame(t)
    return frame.groupBy("MAKE", "TRAIN").agg(F.count(F.lit(1)).alias("N"))


def _frame_rows(t: Tables) -> DataFrame:
    return models.injuries_frame(t).drop("LABEL")


def _high_flags(t: Tables) -> DataFrame:
    return models.recalls_frame(t).select("MAKE", "RELATED_RECALLS", F.col("LABEL").cast("int").alias("HIGH_RECALLS"))


def _actual_vs_predicted(t: Tables) -> DataFrame:
    return models.ols_injuries(t).scored.withColumn("PREDICTION", F.round("PREDICTION", 6))


SUBJECT_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    # reports
    **{f"q{i:02d}": getattr(reports, f"q{i:02d}") for i in range(1, 20)},
    "q05_labelled": reports.q05_labelled,
    "q08_dedup": reports.q08_dedup,
    "q09": lambda t: reports.q09(t, TEST_MAKES),
    "q11_exact": reports.q11_exact,
    "q13_all": reports.q13_all,
    "q17": lambda t: reports.q17(t, **TEST_TIERS),
    # chart frames
    "plot_q01": charts.plot_q01,
    "plot_q02a": charts.plot_q02a,
    "plot_q02b": charts.plot_q02b,
    "plot_q02c": charts.plot_q02c,
    "plot_q02d": charts.plot_q02d,
    "plot_q02e": charts.plot_q02e,
    "plot_q03": charts.plot_q03,
    "plot_q04": lambda t: charts.plot_q04(t, TEST_LAST_YEAR),
    "plot_q05a": charts.plot_q05a,
    "plot_q05b": charts.plot_q05b,
    "plot_q06a": charts.plot_q06a,
    "plot_q06b": charts.plot_q06b,
    "plot_q07": charts.plot_q07,
    "plot_q08": charts.plot_q08,
    "plot_q09a": lambda t: charts.plot_q09a(t, TEST_MAKES),
    "plot_q09b": lambda t: charts.plot_q09b(t, TEST_MAKES),
    "plot_q10a": charts.plot_q10a,
    "plot_q10b": charts.plot_q10b,
    "plot_q10c": charts.plot_q10c,
    "plot_q10d": charts.plot_q10d,
    "plot_q10d_median": charts.plot_q10d_median,
    "plot_q11": charts.plot_q11,
    "plot_q12": lambda t: charts.plot_q12(t, TEST_COLORS),
    "plot_q13": lambda t: charts.plot_q13(t, TEST_COLORS),
    "plot_q14a": charts.plot_q14a,
    "plot_q14b": charts.plot_q14b,
    "plot_q15a": charts.plot_q15a,
    "plot_q15b": charts.plot_q15b,
    "plot_q16": charts.plot_q16,
    "plot_q17a": lambda t: charts.plot_q17a(t, TEST_TIERS),
    "plot_q17b": lambda t: charts.plot_q17b(t, TEST_TIERS),
    "plot_q18a": _actual_vs_predicted,
    "plot_q19a": lambda t: models.confusion(models.logit_recalls(t).scored),
    "plot_q19b": lambda t: models.coefficient_bars(models.logit_recalls(t)),
    # models
    "ml_split": _split_counts,
    "ml_frame": _frame_rows,
    "ml_high_flag": _high_flags,
    "ml_reg_metrics": lambda t: models.regression_metrics(_injury_rule_rows(t), "rule"),
    "ml_cls_metrics": lambda t: models.classification_metrics(_recall_rule_rows(t), "rule"),
    "ml_cls_report": lambda t: models.classification_report(_recall_rule_rows(t), models.RECALL_CLASSES),
    "ml_confusion": lambda t: models.confusion(_recall_rule_rows(t)),
    "ml_ols_injuries": lambda t: _fitted_metrics(models.ols_injuries(t), True),
    "ml_ols_deaths": lambda t: _fitted_metrics(models.ols_deaths(t), True),
    "ml_logit_recalls": lambda t: _fitted_metrics(models.logit_recalls(t), False),
    "ml_logit_deaths": lambda t: _fitted_metrics(models.logit_deaths(t), False),
    "ml_logit_recalls_report": lambda t: models.classification_report(models.logit_recalls(t).scored, models.RECALL_CLASSES),
    "ml_logit_deaths_report": lambda t: models.classification_report(models.logit_deaths(t).scored, models.DEATH_CLASSES),
    "ml_coefs_ols": lambda t: _coefficients(models.ols_injuries(t), models.ols_deaths(t)),
    "ml_coefs": lambda t: _coefficients(
        models.ols_injuries(t), models.ols_deaths(t), models.logit_recalls(t), models.logit_deaths(t)
    ),
    "ml_residual_hist": lambda t: models.residual_histogram(models.ols_injuries(t)),
    # single operators
    **{
        name: getattr(probes, name)
        for name in dir(probes)
        if name[:2] in ("f_", "x_", "a_", "w_", "t_") and callable(getattr(probes, name))
    },
    "x_tier_group": lambda t: probes.x_tier_group(t, **TEST_TIERS),
}


def build(query: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, root: query(role_tables(spark, root))


def queries() -> dict[str, Query]:
    return {name: build(query) for name, query in SUBJECT_QUERIES.items()}

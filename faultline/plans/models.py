"""Linear models on MLlib, logistic ones by Newton steps, with their metrics as long frames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from faultline.functions.text import share_text
from faultline.operators.grouping import exact_median, histogram
from faultline.operators.staging import stage
from faultline.plans import reports
from faultline.sources.tables import Tables

# Features and labels of the four models.
CAR_FEATURES = ["COMPLAINT_COUNT", "OVERALL_STARS", "ROLLOVER_STARS"]
RECALL_FEATURES = ["COMPLAINT_COUNT", "INJURIES_FROM_COMPLAINTS", "DEATHS_FROM_COMPLAINTS"]
DEATH_FEATURES = ["TOTAL_COMPLAINTS", "CRASH_COUNT", "FIRE_COUNT", "TOTAL_INJURIES"]

# First two hex digits of the key's md5 below this go to training: 179 of 256, about 70 %.
TRAIN_BELOW = "b3"

# Newton's method ends with the first step that moves no weight by more than this share of the largest, or after so
# many passes. Each pass tries these lengths of the step, the full one first.
LAST_STEP = 1e-6
MOST_PASSES = 100
STEPS = (1.0, *[2.0**k for k in (5, 4, 3, 2, 1, -1, -2, -3, -4, -6, -8, -10, -14)])
SIGNIFICANT = 4  # digits of logistic coefficients that are reported

# Names of the classes, and the names and colours of the bars of the recall model.
RECALL_CLASSES = ("Low Recalls", "High Recalls")
DEATH_CLASSES = ("Low Deaths", "High Deaths")
BAR_NAMES = ("Complaint Count", "Injuries", "Deaths")
FALLING, RISING = "#e94560", "#55efc4"


@dataclass(frozen=True)
class Fitted:
    name: str
    features: Sequence[str]
    coefficients: Sequence[float]
    intercept: float
    train: DataFrame
    scored: DataFrame  # test rows with label and prediction
    significant: int | None = None  # digits of coefficients that are reported; six decimals if not given


def in_training(*key: str) -> Column:
    """Split that depends on the row's key alone, so it is the same on every run and engine."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    return F.substring(F.md5(text.cast("binary")), 1, 2) < TRAIN_BELOW


def model_frame(df: DataFrame, keys: Sequence[str], features: Sequence[str], *targets: str) -> DataFrame:
    """Numeric features and targets, rows with a missing one dropped, and the split."""
    columns = list(dict.fromkeys([*features, *targets]))
    numeric = [F.col(c).cast("double").alias(c) for c in columns]
    return df.select(in_training(*keys).alias("TRAIN"), *keys, *numeric).na.drop(subset=columns)


_CAR_KEYS = ["MAKE", "MODEL", "MODEL_YEAR"]


def injuries_frame(t: Tables) -> DataFrame:
    frame = reports.rated_car_complaints(t)
    return model_frame(frame, _CAR_KEYS, CAR_FEATURES, "TOTAL_INJURIES", "TOTAL_DEATHS").withColumn(
        "LABEL", F.col("TOTAL_INJURIES")
    )


def deaths_frame(t: Tables) -> DataFrame:
    frame = reports.rated_car_complaints(t)
    return model_frame(frame, _CAR_KEYS, CAR_FEATURES, "TOTAL_DEATHS").withColumn("LABEL", F.col("TOTAL_DEATHS"))


def with_high_flag(frame: DataFrame, measure: str) -> DataFrame:
    """LABEL 1 where the measure lies above its exact median."""
    median = exact_median(frame, measure).scalar()
    return frame.withColumn("LABEL", (F.col(measure) > median).cast("double"))


def recalls_frame(t: Tables) -> DataFrame:
    frame = model_frame(reports.make_recall_links(t), ["MAKE"], RECALL_FEATURES, "RELATED_RECALLS")
    return with_high_flag(stage(frame), "RELATED_RECALLS")


def make_deaths_frame(t: Tables) -> DataFrame:
    frame = model_frame(reports.q03(t).na.drop(subset=["MAKE"]), ["MAKE"], DEATH_FEATURES, "TOTAL_DEATHS")
    return with_high_flag(stage(frame), "TOTAL_DEATHS")


def fit_linear(name: str, frame: DataFrame, features: Sequence[str]) -> Fitted:
    """Least squares by the normal equations, one pass over the staged training rows."""
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(stage(frame))
    train, test = rows.filter("TRAIN"), rows.filter("NOT TRAIN")
    model = LinearRegression(labelCol="LABEL", solver="normal", regParam=0.0).fit(train)
    scored = model.transform(test).select("LABEL", F.col("prediction").alias("PREDICTION"))
    return Fitted(name, features, model.coefficients.toArray().tolist(), float(model.intercept), train, scored)


def _score(weights: Sequence[float], inputs: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * x for w, x in zip(weights, inputs)])


def _sum_columns(n: int) -> tuple[dict[str, Column], list[Column]]:
    """Columns of a row at a point, in the order they build on each other, and the sums asked for: log loss, gradient
    and upper Hessian. Terms are written by the margin towards the wrong class, which loses no digits where a
    prediction is nearly sure."""
    x, e = [F.col(f"x{i}") for i in range(n)], F.col("e")
    steps = {
        "wrong": F.when(F.col("LABEL") > 0, -1.0).otherwise(1.0),
        "margin": F.col("wrong") * reduce(lambda a, b: a + b, [F.col("w")[i] * x[i] for i in range(n)]),
        "e": F.exp(-F.abs("margin")),
        "pull": F.col("wrong") * F.when(F.col("margin") > 0, 1.0).otherwise(e) / (1 + e),
        "curve": e / ((1 + e) * (1 + e)),
    }
    terms = [F.greatest("margin", F.lit(0.0)) + F.log1p("e"), *[F.col("pull") * v for v in x]]
    terms += [F.col("curve") * x[i] * x[j] for i in range(n) for j in range(i, n)]
    return steps, [F.sum(t) for t in terms]


def _sums_at(
    rows: DataFrame, points: Sequence[np.ndarray], steps: dict[str, Column], sums: Sequence[Column]
) -> list[np.ndarray]:
    """The sums over ``rows`` (LABEL, x0, x1, ...) at each point, all in one aggregate. The points are one constant
    column, so Spark compiles the aggregate once for all passes, and each map task leaves one row per point."""
    lists = ", ".join("array(" + ", ".join(f"{float(v)!r}D" for v in p) + ")" for p in points)
    at = rows.select("*", F.posexplode(F.expr(f"array({lists})")).alias("point", "w"))
    for name, column in steps.items():
        at = at.withColumn(name, column)
    found = {r[0]: np.array(r[1:], dtype=float) for r in at.groupBy("point").agg(*sums).collect()}
    return [found.get(k, np.zeros(len(sums))) for k in range(len(points))]


def fit_logistic(name: str, frame: DataFrame, features: Sequence[str]) -> Fitted:
    """The unique minimum of the log loss plus half the squared coefficients, intercept free, features unscaled.

    Newton steps: each pass sums loss, gradient and Hessian of the staged training rows at all of ``STEPS`` lengths
    of the step at once, and goes on from the point of least loss; so neither a longer nor a shorter step costs a
    pass of its own. Features are divided by their largest training value, and the penalty with them, so the
    system stays well-conditioned and the minimum the same.
    """
    frame = stage(frame)  # the label's median is found once, not in each pass
    train, test = frame.filter("TRAIN"), frame.filter("NOT TRAIN")
    bounds = train.agg(*[F.max(F.abs(F.col(f))).alias(f) for f in features]).first()
    scale = np.array([1.0, *[bounds[f] or 1.0 for f in features]])
    penalty = np.array([0.0, *(1.0 / scale[1:] ** 2)])
    inputs = [F.lit(1.0), *[F.col(f) / F.lit(float(m)) for f, m in zip(features, scale[1:])]]
    n = len(inputs)
    rows = train.select("LABEL", *[x.alias(f"x{i}") for i, x in enumerate(inputs)])

    columns = _sum_columns(n)

    def sums(points: Sequence[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        out = []
        for w, row in zip(points, _sums_at(rows, points, *columns), strict=True):
            upper = np.zeros((n, n))
            upper[np.triu_indices(n)] = row[1 + n :]
            hessian = upper + np.triu(upper, 1).T + np.diag(penalty)
            out.append((float(row[0] + (penalty * w * w).sum() / 2), row[1 : 1 + n] + penalty * w, hessian))
        return out

    w = np.zeros(n)
    loss, gradient, hessian = sums([w])[0]
    for _ in range(MOST_PASSES):
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        if np.abs(step).max() <= LAST_STEP * np.abs(w).max():
            w = w - step  # Newton's error is squared by each step, so this one leaves none that shows
            break
        points = [w - size * step for size in STEPS]
        found = sums(points)
        best = min(range(len(STEPS)), key=lambda k: found[k][0])
        if found[0][0] <= found[best][0] * (1 + 1e-12):
            best = 0  # the full step, unless another is truly better
        if not found[best][0] <= loss * (1 + 1e-12):
            break
        w, (loss, gradient, hessian) = points[best], found[best]
    likely = _score(w, inputs) > 0
    scored = test.select("LABEL", likely.cast("double").alias("PREDICTION"))
    slopes = w / scale
    return Fitted(name, features, slopes[1:].tolist(), float(slopes[0]), train, scored, SIGNIFICANT)


def ols_injuries(t: Tables) -> Fitted:
    return fit_linear("ols_injuries", injuries_frame(t), CAR_FEATURES)


def ols_deaths(t: Tables) -> Fitted:
    return fit_linear("ols_deaths", deaths_frame(t), CAR_FEATURES)


def logit_recalls(t: Tables) -> Fitted:
    return fit_logistic("logit_recalls", recalls_frame(t), RECALL_FEATURES)


def logit_deaths(t: Tables) -> Fitted:
    return fit_logistic("logit_deaths", make_deaths_frame(t), DEATH_FEATURES)


# ---------------------------------------------------------------- metrics


def _long(row: DataFrame, name: str, metrics: Sequence[str]) -> DataFrame:
    pairs = [F.struct(F.lit(m).alias("METRIC"), F.round(F.col(m).cast("double"), 6).alias("VALUE")) for m in metrics]
    lines = row.select(F.lit(name).alias("MODEL"), F.explode(F.array(*pairs)).alias("m"))
    return lines.select("MODEL", "m.METRIC", "m.VALUE")


def regression_metrics(scored: DataFrame, name: str) -> DataFrame:
    """R2, RMSE and MAE of (LABEL, PREDICTION) rows, in one pass."""
    error = F.col("LABEL") - F.col("PREDICTION")
    sums = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(error * error).alias("squared"),
        F.sum(F.abs(error)).alias("absolute"),
        F.var_pop("LABEL").alias("variance"),
    )
    row = sums.select(
        (1 - F.try_divide(F.col("squared"), F.col("variance") * F.col("n"))).alias("R2"),
        F.sqrt(F.try_divide(F.col("squared"), F.col("n"))).alias("RMSE"),
        F.try_divide(F.col("absolute"), F.col("n")).alias("MAE"),
    )
    return _long(row, name, ["R2", "RMSE", "MAE"])


def classification_metrics(scored: DataFrame, name: str) -> DataFrame:
    row = scored.agg(F.avg((F.col("LABEL") == F.col("PREDICTION")).cast("double")).alias("ACCURACY"))
    return _long(row, name, ["ACCURACY"])


def confusion(scored: DataFrame) -> DataFrame:
    """All four cells with count, share and label; cells without rows show 0."""
    actual, predicted = F.col("LABEL").cast("int"), F.col("PREDICTION").cast("int")

    def cell(a: int, p: int, label: str) -> Column:
        return F.struct(
            F.lit(a).alias("ACTUAL"),
            F.lit(p).alias("PREDICTED"),
            F.lit(label).alias("CELL"),
            F.count_if((actual == a) & (predicted == p)).alias("N"),
        )

    cells = F.array(
        cell(0, 0, "True Negative"),
        cell(0, 1, "False Positive"),
        cell(1, 0, "False Negative"),
        cell(1, 1, "True Positive"),
    )
    sums = scored.agg(F.count(F.lit(1)).alias("total"), cells.alias("cells"))
    counted = sums.select("total", F.explode("cells").alias("c"))
    share = F.try_divide(F.col("c.N").cast("double"), F.col("total"))
    return counted.select(
        "c.ACTUAL",
        "c.PREDICTED",
        "c.CELL",
        "c.N",
        F.round(share, 6).alias("SHARE"),
        F.concat(F.lit("("), share_text(F.round(share, 6)), F.lit(")")).alias("SHARE_LABEL"),
    )


def classification_report(scored: DataFrame, classes: Sequence[str] = ("0", "1")) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, then macro and weighted means; 0 where undefined.

    The accuracy stands in the F1 column, as printed reports have it.
    """
    label, guess = F.col("LABEL").cast("int"), F.col("PREDICTION").cast("int")
    counts = scored.agg(
        *[F.count_if((label == c) & (guess == c)).alias(f"hit{c}") for c in (0, 1)],
        *[F.count_if(label == c).alias(f"support{c}") for c in (0, 1)],
        *[F.count_if(guess == c).alias(f"guessed{c}") for c in (0, 1)],
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    def scores(c: int) -> list[Column]:
        hit, support, guessed = (F.col(f"{n}{c}") for n in ("hit", "support", "guessed"))
        return [ratio(hit, guessed), ratio(hit, support), ratio(2 * hit, guessed + support)]

    def line(name: str, values: Sequence[Column], support: Column) -> Column:
        fields = [F.round(v, 6).alias(n) for v, n in zip(values, ("PRECISION", "RECALL", "F1"))]
        return F.struct(F.lit(name).alias("CLASS"), *fields, support.alias("SUPPORT"))

    low, high = scores(0), scores(1)
    s0, s1 = F.col("support0"), F.col("support1")
    macro = [(a + b) / 2 for a, b in zip(low, high)]
    weighted = [ratio(a * s0 + b * s1, s0 + s1) for a, b in zip(low, high)]
    nothing = F.lit(None).cast("double")
    accuracy = [nothing, nothing, ratio(F.col("hit0") + F.col("hit1"), s0 + s1)]
    lines = F.array(
        line(classes[0], low, s0), line(classes[1], high, s1), line("accuracy", accuracy, s0 + s1),
        line("macro avg", macro, s0 + s1), line("weighted avg", weighted, s0 + s1),
    )
    return counts.select(F.explode(lines).alias("l")).select("l.*")


def _shown(fitted: Fitted, value: float) -> float:
    if fitted.significant is None:
        return float(Decimal(value).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return float(f"{value:.{fitted.significant - 1}e}")


def coefficients(fitted: Fitted) -> DataFrame:
    """Coefficient of each feature, also times the feature's spread in training so they compare, and the intercept."""
    spread = fitted.train.agg(*[F.coalesce(F.stddev_pop(f), F.lit(0.0)).alias(f) for f in fitted.features]).first()
    lines = [(fitted.name, f, _shown(fitted, c), _shown(fitted, c * spread[f])) for f, c in zip(fitted.features, fitted.coefficients)]
    lines.append((fitted.name, "Intercept", _shown(fitted, fitted.intercept), None))
    return fitted.train.sparkSession.createDataFrame(lines, "MODEL string, FEATURE string, COEFFICIENT double, PER_STDDEV double")


def coefficient_bars(fitted: Fitted, names: Sequence[str] = BAR_NAMES) -> DataFrame:
    """One bar per feature, coloured by its sign."""
    bars = [(n, _shown(fitted, c), FALLING if c < 0 else RISING) for n, c in zip(names, fitted.coefficients)]
    return fitted.train.sparkSession.createDataFrame(bars, "FEATURE string, COEFFICIENT double, COLOR string")


def residuals(fitted: Fitted) -> DataFrame:
    return fitted.scored.select((F.col("LABEL") - F.col("PREDICTION")).alias("RESIDUAL"))


def residual_histogram(fitted: Fitted, bins: int = 8) -> DataFrame:
    return histogram(residuals(fitted), "RESIDUAL", bins).orderBy("BIN")


def score_rule(frame: DataFrame, rule: Column) -> DataFrame:
    """Test rows scored by a fixed rule instead of a fitted model."""
    return frame.filter("NOT TRAIN").select("LABEL", rule.cast("double").alias("PREDICTION"))

"""Learners: naive baseline, linear, forest, boosted trees; scoring and blending.

All learners are MLlib estimators over a `features` vector and a double `label`. For
classification the label is the index of the class in sorted order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRestModel,
)
from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions import cells
from colonnade.operators.boosting import SoftmaxBoostedTrees
from colonnade.operators.features import _param, _Stage
from colonnade.operators.forest import RandomForest
from colonnade.settings import DEFAULTS, Settings


@dataclass(frozen=True)
class Candidate:
    name: str
    engine: str
    build: Callable[[], Estimator]
    naive: bool = False
    round: int = 1
    stage: str = "Baseline"
    params: dict = field(default_factory=dict)


class NaiveBaseline(Estimator, _Stage):
    """Majority class (smallest label on a tie) or mean of the training label."""

    labelCol = _param("labelCol", "label column")
    classes = _param("classes", "number of classes, 0 for regression")

    @keyword_only
    def __init__(self, *, labelCol="label", classes=0):
        super().__init__()
        self._take(labelCol=labelCol, classes=classes)

    def _fit(self, df):
        label = F.col(self.value("labelCol"))
        if self.value("classes"):
            counts = df.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
            answer = counts.orderBy(F.desc("n"), "label").first()["label"]
        else:
            answer = df.agg(F.avg(label)).first()[0]
        return NaiveBaselineModel(answer=float(answer), classes=self.value("classes"))


class NaiveBaselineModel(Model, _Stage):
    answer = _param("answer", "the one prediction")
    classes = _param("classes", "number of classes, 0 for regression")

    @keyword_only
    def __init__(self, *, answer=None, classes=0):
        super().__init__()
        self._take(answer=answer, classes=classes)

    def _transform(self, df):
        return df.withColumn("prediction", F.lit(self.value("answer")))


MOST_CLASSES = 1000


class LabelIndexer:
    """Class labels to 0..k-1 in ascending order: by number where all labels are numbers, else by text."""

    def __init__(self, target: str):
        self.target = target

    def fit(self, df: DataFrame) -> StringIndexerModel:
        label = cells.quoted(self.target).cast("string")
        found = df.select(label.alias("label")).filter("label IS NOT NULL").distinct().limit(MOST_CLASSES + 1)
        labels = [r["label"] for r in found.collect()]
        if len(labels) > MOST_CLASSES:
            raise ValueError(f"{self.target!r} has more than {MOST_CLASSES} classes")
        return StringIndexerModel.from_labels(cells.label_order(labels), inputCol=self.target, outputCol="label", handleInvalid="error")


def label_indexer(target: str) -> LabelIndexer:
    return LabelIndexer(target)


def label_back(labels: list[str], column: str = "prediction", output: str = "y_pred") -> IndexToString:
    return IndexToString(inputCol=column, outputCol=output, labels=labels)


def linear_classifier(rows: int, classes: int) -> LogisticRegression:
    """Penalty C = 1 on the sum of losses, which is 1/n on MLlib's mean loss."""
    return LogisticRegression(
        maxIter=100, regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False,
        family="binomial" if classes == 2 else "multinomial",
    )


def boosted_classifier(classes: int, **params) -> Estimator:
    """Boosted trees: MLlib's for two classes, one softmax model for more."""
    return GBTClassifier(**params) if classes == 2 else SoftmaxBoostedTrees(classes=classes, **params)


def forest_classifier(settings: Settings = DEFAULTS, **params) -> Estimator:
    """A forest: MLlib's up to `forest_rows` rows, beyond by histograms."""
    return RandomForest(limit=settings.forest_rows, **params)


def first_round(problem_type: str, rows: int, classes: int, settings: Settings = DEFAULTS) -> list[Candidate]:
    seed = settings.seed
    if problem_type.endswith("classification"):
        return [
            Candidate("majority class", "naive", lambda: NaiveBaseline(classes=classes), naive=True),
            Candidate("LogisticRegression", "mllib", lambda: linear_classifier(rows, classes)),
            Candidate("RandomForestClassifier", "mllib",
                      lambda: forest_classifier(settings, numTrees=100, maxDepth=10, seed=seed)),
            Candidate("GradientBoostedTreesClassifier", "mllib",
                      lambda: boosted_classifier(classes, maxIter=20, maxDepth=5, stepSize=0.1, seed=seed)),
        ]
    return [
        Candidate("mean of the target", "naive", lambda: NaiveBaseline(classes=0), naive=True),
        Candidate("LinearRegression", "mllib", lambda: LinearRegression(solver="normal")),
        Candidate("RandomForestRegressor", "mllib", lambda: RandomForestRegressor(numTrees=100, maxDepth=10, seed=seed)),
        Candidate("GradientBoostedTreesRegressor", "mllib",
                  lambda: GBTRegressor(maxIter=20, maxDepth=5, stepSize=0.1, seed=seed)),
    ]


def search_grids(problem_type: str, settings: Settings = DEFAULTS) -> dict[str, tuple]:
    """The parameter combinations that a run searches by itself: penalties of the linear model, sizes of the forest."""
    forest = {"maxDepth": (5, 8), "numTrees": (40,), "seed": (settings.seed,)}
    if problem_type.endswith("classification"):
        return {"logistic regression": (LogisticRegression, {"regParam": (0.001, 0.1)}), "forest": (partial(forest_classifier, settings), forest)}
    return {"linear regression": (LinearRegression, {"regParam": (0.01, 1.0)}), "forest": (RandomForestRegressor, forest)}


def second_round(problem_type: str, classes: int, settings: Settings = DEFAULTS) -> list[Candidate]:
    """Deeper trees with a smaller step, and a deeper and a wider forest."""
    seed, stage = settings.seed, "tuned trees"
    deep = {"maxIter": 100, "stepSize": 0.04, "maxDepth": 6, "seed": seed, "minInstancesPerNode": 10}
    forest = {"numTrees": 100, "maxDepth": 15, "minInstancesPerNode": 2, "seed": seed, "featureSubsetStrategy": "sqrt"}
    wide = {"numTrees": 150, "maxDepth": 12, "minInstancesPerNode": 2, "seed": seed + 1, "featureSubsetStrategy": "all",
            "subsamplingRate": 0.7}
    if problem_type.endswith("classification"):
        builders = [lambda: boosted_classifier(classes, **deep), lambda: forest_classifier(settings, **forest),
                    lambda: forest_classifier(settings, **wide)]
    else:
        builders = [lambda: GBTRegressor(**deep), lambda: RandomForestRegressor(**forest),
                    lambda: RandomForestRegressor(**wide)]
    names = ["Tuned Boosted Trees (Deep)", "Tuned Random Forest (15-depth)", "Tuned Random Forest (Wide)"]
    return [Candidate(n, "mllib_tuned", b, round=2, stage=stage) for n, b in zip(names, builders)]


def class_probabilities(model, scored: DataFrame, classes: int) -> Column | None:
    """Probability array per class from a scored table, or null when the model has none."""
    if "probability" in scored.columns:
        return vector_to_array("probability")
    if isinstance(model, OneVsRestModel) and "rawPrediction" in scored.columns:
        margin = vector_to_array("rawPrediction")
        votes = F.transform(margin, lambda r: 1.0 / (1.0 + F.exp(-2.0 * r)))
        total = F.aggregate(votes, F.lit(0.0), lambda a, x: a + x)
        return F.transform(votes, lambda v: v / total)
    if isinstance(model, NaiveBaselineModel) and classes:
        answer = int(model.value("answer"))
        return F.array(*[F.lit(1.0 if i == answer else 0.0) for i in range(classes)])
    return None


def score(model, df: DataFrame, keep: list[str], labels: list[str] | None) -> DataFrame:
    """`(keep, label, prediction, probs, y_true, y_pred)`; class names instead of indexes where there are classes."""
    scored = model.transform(df)
    probs = class_probabilities(model, scored, len(labels or []))
    probs = F.lit(None).cast("array<double>") if probs is None else probs
    if labels:
        names = F.array(*map(F.lit, labels))
        y_true = F.element_at(names, F.col("label").cast("int") + 1)
        y_pred = F.element_at(names, F.col("prediction").cast("int") + 1)
    else:
        y_true, y_pred = F.col("label"), F.col("prediction")
    return scored.select(
        *keep, "label", "prediction", probs.alias("probs"), y_true.alias("y_true"), y_pred.alias("y_pred")
    )


def blend(members: list[DataFrame], keys: list[str], keep: list[str], labels: list[str] | None) -> DataFrame:
    """Mean of member probabilities (soft), majority of predictions (hard), or mean prediction.

    Members are stacked and grouped by row key: one shuffle whatever the number of members.
    """
    stacked = members[0]
    for m in members[1:]:
        stacked = stacked.unionByName(m)
    fixed = [F.first(c).alias(c) for c in [*[k for k in keep if k not in keys], "label", "y_true"]]
    if not labels:
        out = stacked.groupBy(*keys).agg(*fixed, F.avg("prediction").alias("prediction"))
        return out.withColumns({"probs": F.lit(None).cast("array<double>"), "y_pred": F.col("prediction")}).select(
            *keep, "label", "prediction", "probs", "y_true", "y_pred")
    k = len(labels)
    soft = stacked.groupBy(*keys).agg(
        *fixed,
        F.count("probs").alias("have"), F.count(F.lit(1)).alias("members"),
        *[F.avg(F.col("probs")[i]).alias(f"p_{i}") for i in range(k)],
        *[F.count_if(F.col("prediction") == i).alias(f"v_{i}") for i in range(k)],
    )
    mean = F.array(*[F.col(f"p_{i}") for i in range(k)])
    votes = F.array(*[F.col(f"v_{i}").cast("double") for i in range(k)])
    use = F.when(F.col("have") == F.col("members"), mean).otherwise(votes)
    choice = (F.array_position(use, F.array_max(use)) - 1).cast("double")
    out = soft.withColumn("prediction", choice).withColumn(
        "probs", F.when(F.col("have") == F.col("members"), mean)
    )
    names = F.array(*map(F.lit, labels))
    return out.select(*keep, "label", "prediction", "probs", "y_true",
                      F.element_at(names, F.col("prediction").cast("int") + 1).alias("y_pred"))


def check_lengths(predictions: DataFrame, expected: int) -> None:
    """Every target must have a prediction."""
    got = predictions.filter(F.col("y_pred").isNotNull()).count()
    if got != expected:
        raise ValueError(f"prediction/target mismatch: expected {expected} rows, got {got} predictions")


def regression_label(df: DataFrame, target: str) -> Column:
    """The target as a number; rows where it is none are left out before the split."""
    return cells.number(df, target)

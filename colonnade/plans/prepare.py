"""From a raw table to folds and a fitted preparation, without letting held-out rows into any fit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions import cells
from colonnade.functions.storage import stored
from colonnade.operators import audit, catalog, features, split, target as targets
from colonnade.settings import DEFAULTS, Settings


class PreparationError(ValueError):
    pass


@dataclass
class Prepared:
    """Folded rows, the fitted pipeline and its bookkeeping."""

    folds: DataFrame
    pipeline: PipelineModel
    routing: features.Routing
    lineage: list[tuple[str, str]]
    target: str
    keys: list[str]
    problem_type: str
    strategy: str
    candidates: list[str]
    selected: list[str]

    def transformed(self) -> DataFrame:
        """Keys, fold, target and the feature vector of every row."""
        out = self.pipeline.transform(self.folds)
        return out.select(*self.keys, "fold", cells.quoted(self.target), "features")

    def report(self) -> DataFrame:
        """One row of counts: columns in and out, generated features, rows per fold."""
        dates = len(self.routing.dates) * len(features.DATE_PARTS)
        numeric = len(self.routing.numeric_inputs())
        counts = self.folds.groupBy().pivot("fold", ["train", "validation", "test"]).count().fillna(0)
        return counts.select(
            F.lit(len(self.candidates)).cast("long").alias("original_features"),
            F.lit(len(self.selected)).cast("long").alias("selected_features"),
            F.lit(len(self.candidates) - len(self.selected)).cast("long").alias("excluded_features"),
            F.lit(len(self.lineage)).cast("long").alias("final_features"),
            F.lit(numeric).cast("long").alias("numeric_features"),
            F.lit(len(self.routing.categorical)).cast("long").alias("categorical_features"),
            F.lit(dates).cast("long").alias("datetime_features"),
            F.lit(len(self.lineage) - numeric).cast("long").alias("one_hot_features"),
            F.col("train").alias("train_rows"), F.col("validation").alias("validation_rows"),
            F.col("test").alias("test_rows"), F.lit(self.strategy).alias("strategy"),
        )

    def preview(self, limit: int = 20) -> DataFrame:
        rows = self.transformed().filter(F.col("fold") == split.TRAIN)
        return features.feature_preview(rows, [f for f, _ in self.lineage], self.keys, limit)


def choose_features(
    df: DataFrame, target: str, selected: list[str] | None, excluded: list[str] | None, settings: Settings
) -> list[str]:
    """Given list, everything but a given list, or what the audit does not flag out."""
    candidates = [c for c in catalog.profiled_columns(df) if c != target]
    if selected is not None:
        return [c for c in selected if c in candidates]
    if excluded is not None:
        return [c for c in candidates if c not in excluded]
    kept = audit.active_features(audit.feature_audit(df, target, settings), target)
    return [r["column"] for r in kept.orderBy("position").collect()]


def prepare(
    df: DataFrame,
    target: str,
    keys: list[str],
    problem_type: str,
    selected: list[str] | None = None,
    excluded: list[str] | None = None,
    test_size: float | None = None,
    validation_size: float | None = None,
    seed: int | None = None,
    numeric_imputation: str = "median",
    categorical_imputation: str = "most_frequent",
    scaling: str = "standard",
    extract_dates: bool = True,
    fit_on: tuple[str, ...] = (split.TRAIN,),
    settings: Settings = DEFAULTS,
) -> Prepared:
    """Check the target, choose features, split, then fit every stage on the training fold only.

    `validation_size=0` gives a two-way split.
    """
    targets.inspect_target(df, target, settings)
    active = choose_features(df, target, selected, excluded, settings)
    audit.verify_no_target(active, target)
    active = [c for c in active if c not in keys]  # a row key identifies rows; it is no feature
    if not active:
        raise PreparationError("no features selected; at least one is required")
    narrow = df.select(*[cells.quoted(c) for c in dict.fromkeys([*keys, *active, target])])
    if validation_size == 0:
        folds, strategy = split.train_test_split(narrow, target, keys, problem_type, test_size, seed, settings)
    else:
        folds, strategy = split.three_way_split(
            narrow, target, keys, problem_type, test_size, validation_size, seed, settings
        )
    folds = stored(folds, "folds")  # every fit below reads it
    train = folds.filter(F.col("fold").isin(*fit_on))
    types = catalog.column_types(train.select(*[cells.quoted(c) for c in active]), settings)
    routing = features.route(types, active, extract_dates)
    pipeline = features.preparation(routing, numeric_imputation, categorical_imputation, scaling)
    fitted = pipeline.fit(train)
    lineage = features.feature_lineage(fitted, routing)
    candidates = [c for c in catalog.profiled_columns(df) if c != target and c not in keys]
    return Prepared(folds, fitted, routing, lineage, target, keys, problem_type, strategy, candidates, active)

"""Explain a run's winner: importances and attributions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions import cells
from colonnade.operators import explain, models, tree_attribution
from colonnade.operators.split import VALIDATION
from colonnade.plans.training import Run


def scorer(run: Run, model_id: str):
    return lambda df: run.models[model_id].transform(df)


def explained_outputs(run: Run, model_id: str, sample: DataFrame, per_class: bool = False) -> list[Column]:
    """What is attributed: the prediction for numbers, the probability of the last class for two classes.

    For more classes it is the probability of the predicted class, or of each class in turn.
    """
    if not run.labels:
        return [F.col("prediction")]
    probs = models.class_probabilities(run.models[model_id], run.models[model_id].transform(sample), len(run.labels))
    if probs is None:
        return [F.col("prediction")]
    if len(run.labels) == 2:
        return [probs[1]]
    return [probs[i] for i in range(len(run.labels))] if per_class else [F.array_max(probs)]


def importance(run: Run, model_id: str) -> DataFrame | None:
    return explain.native_importance(run.spark, run.models[model_id], run.prepared.lineage)


def permutation(run: Run, model_id: str, repeats: int | None = None, by_column: bool = False) -> DataFrame:
    """Permutation importance on the whole validation fold, per feature or per original column."""
    return explain.permutation_importance(
        run.fold(VALIDATION), run.prepared.keys, scorer(run, model_id), run.prepared.lineage,
        bool(run.labels), repeats, run.settings, by_column,
    )


def explained_trees(run: Run, model_id: str, rows: DataFrame, nodes: DataFrame, per_class: bool = False) -> DataFrame:
    """Exact attributions of a tree ensemble: a forest's probabilities or numbers, the margins of boosted trees.

    With more than two classes `phi` is the mean absolute value over the classes, or, without `per_class`, the signed
    value for the predicted class.
    """
    keys, model = run.prepared.keys, run.models[model_id]
    classes = len(run.labels or []) if isinstance(model, tree_attribution.PER_CLASS) else 0
    out = tree_attribution.tree_attributions(rows, keys, nodes, run.prepared.lineage, [1] if classes == 2 else None)
    if classes <= 2:
        return out.drop("output")
    if per_class:
        return out.groupBy(*keys, "feature", "original_feature").agg(F.first("feature_value").alias("feature_value"), F.avg(F.abs("phi")).alias("phi"))
    said = model.transform(rows).select(*keys, F.col("prediction").cast("int").alias("said"))
    return cells.join_by(out, said, keys).filter(F.col("output") == F.col("said")).drop("output", "said")


def attributions(
    run: Run, model_id: str, rows: DataFrame | None = None, orders: int | None = None, per_class: bool = True
) -> DataFrame:
    """Attributions of a sample of validation rows, or of the given rows.

    Exact for tree ensembles; with a number of `orders`, and for other models, sampled Shapley values. With more than two
    classes `phi` is the mean absolute value over the classes, or, without `per_class`, the signed value for the
    predicted class.
    """
    s, keys = run.settings, run.prepared.keys
    pool = run.fold(VALIDATION)
    rows = explain.sample_rows(pool, keys, s.shap_sample, s.seed) if rows is None else rows
    if orders is None and tree_attribution.is_tree_model(run.models[model_id]):
        return explained_trees(run, model_id, rows, tree_attribution.node_table(run.spark, run.models[model_id]), per_class)
    back = explain.sample_rows(pool, keys, s.shap_background, f"{s.seed}-background")
    background = [r["x"] for r in back.select(vector_to_array("features").alias("x")).collect()]
    parts = [
        explain.sampled_shapley(rows, background, keys, scorer(run, model_id), output, run.prepared.lineage, orders, s)
        for output in explained_outputs(run, model_id, pool, per_class)
    ]
    if len(parts) == 1:
        return parts[0]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    return stacked.groupBy(*keys, "feature", "original_feature").agg(
        F.first("feature_value").alias("feature_value"), F.avg(F.abs("phi")).alias("phi")
    )


def _base_value(run: Run, model_id: str, rows: DataFrame) -> Column:
    """What the contributions of a row add to: the trees' mean output, or the mean output over the background rows."""
    model = run.models[model_id]
    if tree_attribution.is_tree_model(model):
        bases = tree_attribution.base_values(tree_attribution.trees_of(tree_attribution.node_table(run.spark, model)))
        each = F.array(*[F.lit(round(float(v), 4)) for v in bases])
        classes = len(run.labels or []) if isinstance(model, tree_attribution.PER_CLASS) else 0
        return F.get(each, F.lit(1)) if classes == 2 else F.get(each, F.col("prediction").cast("int")) if classes else F.get(each, F.lit(0))
    pool = explain.sample_rows(run.fold(VALIDATION), run.prepared.keys, run.settings.shap_background, f"{run.settings.seed}-background")
    return F.lit(round(model.transform(pool).agg(F.avg(explained_outputs(run, model_id, rows)[0])).first()[0], 4))


def local(run: Run, model_id: str, rows: DataFrame, top: int = 15) -> dict[str, DataFrame]:
    """Prediction, probability and base value of given rows, and their strongest contributions."""
    phi = attributions(run, model_id, rows, per_class=False)
    keep = [*run.prepared.keys, "fold"]
    scored = models.score(run.models[model_id], rows, keep, run.labels)
    return {
        "prediction": scored.select(
            *keep, "y_true", "y_pred", F.round(F.array_max("probs"), 4).alias("probability"),
            _base_value(run, model_id, rows).alias("base_value"),
        ),
        "contributions": explain.local_explanation(phi, run.prepared.keys, top),
    }

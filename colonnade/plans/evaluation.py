"""Full evaluation of a run's winner: metrics, errors, diagnosis, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions.storage import stored
from colonnade.operators import classification, diagnosis, errors, models, regression
from colonnade.operators import target as targets
from colonnade.operators.split import TEST, TRAIN
from colonnade.plans.training import Run


def evaluate_classification(scored: DataFrame, by: list[str], keys: list[str], labels: list[str], binary: bool,
                            rows: int | None = None) -> dict[str, DataFrame]:
    """Every classification table for predictions with class probabilities in `probs`."""
    counts = classification.outcome_counts(scored, by)
    places = F.array_position(F.array(*map(F.lit, labels)), F.col("y_pred"))
    confidence = F.when(places > 0, F.element_at("probs", places.cast("int"))).otherwise(F.array_max("probs"))
    out = {
        "metrics": classification.summary_metrics(counts, by, binary),
        "accuracy": classification.accuracy_counts(counts, by),
        "confusion": classification.confusion_matrix(counts, by),
        "per_class": classification.per_class(counts, by),
        "misclassification": errors.misclassification(counts, by),
        "confused_pairs": errors.confused_pairs(counts, by),
        "worst": errors.worst_misclassifications(scored, [*by, *keys], confidence),
    }
    if not binary:
        return out | {"auc": classification.multiclass_auc(scored, by, labels, rows=rows)}
    single = scored.select(*by, F.col("probs")[1].alias("score"), (F.col("y_true") == labels[-1]).cast("int").alias("is_positive"))
    table = classification.score_table(single, by, rows=rows)
    thresholds = classification.threshold_table(single, by)
    return out | {
        "breakdown": classification.binary_breakdown(counts, by),
        "auc": classification.auc(table, by),
        "roc": classification.thin_curve(classification.roc_points(table, by)),
        "precision_recall": classification.thin_curve(classification.precision_recall_points(table, by)),
        "thresholds": thresholds,
        "calibration": classification.calibration(single, by),
        "brier": classification.brier_score(single, by),
    }


def evaluate_regression(scored: DataFrame, by: list[str], keys: list[str], rows: int | None = None) -> dict[str, DataFrame]:
    """Every regression table for predictions with `y_true` and `y_pred`."""
    return {
        "metrics": regression.regression_metrics(scored, by, rows=rows),
        "residuals": regression.residual_statistics(scored, by, rows=rows),
        "histogram": regression.residual_histogram(scored, by),
        "points": regression.actual_vs_predicted(scored, [*by, *keys]),
        "reference_line": regression.reference_line(scored, by),
        "diagnostics": regression.residual_diagnostics(scored, by, rows=rows),
        "worst": errors.worst_regression_errors(scored, [*by, *keys]),
        "error_summary": errors.error_summary(scored, [*by, *keys], rows=rows),
    }


def evaluate_run(run: Run) -> dict[str, DataFrame]:
    """Score the winner on the test and training folds once and build all result tables."""
    winner = run.winner()["model_id"]
    scored = stored(run.predictions(winner, TRAIN, TEST), "predictions")
    models.check_lengths(scored.filter(F.col("fold") == TEST), run.rows[TEST])
    test = scored.filter(F.col("fold") == TEST)
    keys, rows = run.prepared.keys, run.rows[TEST]
    if run.labels:
        out = evaluate_classification(test, ["fold"], keys, run.labels, run.problem_type == targets.BINARY, rows)
        counts = classification.outcome_counts(scored, ["fold"])
        out["fold_metrics"] = classification.summary_metrics(counts, ["fold"], run.problem_type == targets.BINARY)
    else:
        out = evaluate_regression(test, ["fold"], keys, rows)
        out["fold_metrics"] = regression.regression_metrics(scored, ["fold"], rows=rows + run.rows[TRAIN])
    board = run.leaderboard()
    return out | {
        "diagnosis": diagnosis.generalization_diagnosis(board).filter("is_winner"),
        "comparison": diagnosis.comparison_table(board),
        "comparison_chart": diagnosis.comparison_chart(board),
    }

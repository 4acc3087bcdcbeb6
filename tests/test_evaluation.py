import numpy as np
import pytest
from conftest import by, one
from pyspark.sql import functions as F

from colonnade.operators import classification as c
from colonnade.operators import diagnosis, errors, regression
from colonnade.settings import Settings

SMALL = Settings(one_task_rows=10, range_rows=10, exact_percentile_rows=10, quantile_bins=8)


def outcomes(spark, true, pred, prob=None):
    rows = [(i, str(t), str(p), None if prob is None else float(prob[i])) for i, (t, p) in enumerate(zip(true, pred))]
    return spark.createDataFrame(rows, "k int, y_true string, y_pred string, score double")


def binary(spark):
    true = [0, 0, 0, 0, 0, 1, 1, 1, 1, 1]
    prob = [.1, .2, .3, .2, .4, .9, .8, .7, .4, .6]
    df = outcomes(spark, true, [int(p >= .5) for p in prob], prob)
    return df.withColumn("is_positive", F.col("y_true").cast("int"))


def test_binary_metrics(spark):
    df = outcomes(spark, [1, 0, 1, 1, 0, 0, 1, 0], [1, 0, 1, 0, 0, 0, 1, 0])
    m = one(c.summary_metrics(c.outcome_counts(df, []), [], True))
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"], m["accuracy_pct"]) == (0.875, 1.0, 0.75, 0.8571, 87.5)


def test_multiclass_metrics(spark):
    df = outcomes(spark, ["a", "b", "c", "a", "b", "c"], ["a", "b", "c", "a", "b", "b"])
    counts = c.outcome_counts(df, [])
    assert one(c.summary_metrics(counts, [], False))["accuracy"] == 0.8333
    grid = by(c.confusion_matrix(counts, []), "y_true", "y_pred")
    assert len(grid) == 9 and grid[("c", "b")]["n"] == 1 and grid[("c", "b")]["share"] == 0.5 and grid[("a", "b")]["n"] == 0
    each = by(c.per_class(counts, []), "class_label")
    assert each["b"]["precision"] == 0.6667 and each["b"]["recall"] == 1.0 and each["c"]["support"] == 2


def test_label_predicted_but_never_true(spark):
    counts = c.outcome_counts(outcomes(spark, ["a", "a", "b"], ["a", "z", "b"]), [])
    m = one(c.summary_metrics(counts, [], False))
    assert m["balanced_accuracy"] == 0.75 and m["f1"] == round((2 / 3 + 1 + 0) / 3, 4)
    assert {r["class_label"] for r in c.per_class(counts, []).collect()} == {"a", "b"}


def test_binary_evaluation(spark):
    df = binary(spark)
    counts = c.outcome_counts(df, [])
    b = one(c.binary_breakdown(counts, []))
    assert (b["true_negatives"], b["false_positives"], b["false_negatives"], b["true_positives"]) == (5, 0, 1, 4)
    assert b["specificity"] == 1.0 and b["sensitivity"] == 0.8
    assert one(c.accuracy_counts(counts, []))["correct"] == 9
    assert c.threshold_table(df, []).count() == 19
    at = one(c.nearest_threshold(c.threshold_table(df, []), [], 0.52))
    assert at["threshold"] == 0.5 and at["true_positives"] == 4
    # 23 pairs ordered, one tie at 0.4, one pair the wrong way round
    for settings in (Settings(), Settings(range_rows=3)):
        assert one(c.auc(c.score_table(df, [], settings), []))["roc_auc"] == round(24.5 / 25, 4)
    assert one(c.brier_score(df, []))["brier_score"] == round(float(np.mean([(p - t) ** 2 for p, t in zip(
        [.1, .2, .3, .2, .4, .9, .8, .7, .4, .6], [0] * 5 + [1] * 5)])), 4)


def test_curves(spark):
    table = c.score_table(binary(spark), [])
    roc = c.roc_points(table, []).orderBy("position").collect()
    assert (roc[0]["fpr"], roc[0]["tpr"], roc[0]["threshold"]) == (0.0, 0.0, None)
    assert (roc[-1]["fpr"], roc[-1]["tpr"]) == (1.0, 1.0) and len(roc) == 9
    pr = c.precision_recall_points(table, []).orderBy("position").collect()
    assert (pr[-1]["precision"], pr[-1]["recall"]) == (1.0, 0.0) and pr[0]["recall"] == 1.0


def test_thinned_curve_keeps_ends(spark):
    curve = spark.range(500).selectExpr("id AS position", "500L AS points", "id / 499 AS fpr")
    kept = [r["position"] for r in c.thin_curve(curve, 50).orderBy("position").collect()]
    assert len(kept) == 50 and kept[0] == 0 and kept[-1] == 499
    assert kept == [int(i * 499 // 49) for i in range(50)]
    assert c.thin_curve(curve, 500).count() == 500


def test_calibration_edges_fall_into_the_lower_bin(spark):
    df = spark.createDataFrame([(0.0, 0), (0.1, 1), (0.11, 1), (1.0, 1)], "score double, is_positive int")
    assert {r["bin"]: r["n"] for r in c.calibration(df, []).collect()} == {0: 2, 1: 1, 9: 1}


def test_multiclass_auc(spark):
    rows = [("a", [.8, .1, .1]), ("b", [.2, .6, .2]), ("c", [.1, .2, .7]), ("a", [.3, .4, .3]), ("b", [.4, .4, .2])]
    df = spark.createDataFrame(rows, "y_true string, probs array<double>")
    want = []
    for i, name in enumerate("abc"):
        pos, neg = [p[i] for t, p in rows if t == name], [p[i] for t, p in rows if t != name]
        want.append(np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg]))
    assert one(c.multiclass_auc(df, [], ["a", "b", "c"]))["roc_auc"] == round(float(np.mean(want)), 4)


def numbers(spark, true, pred):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(true, pred))], "k int, y_true double, y_pred double")


def test_regression_metrics(spark):
    r = one(regression.regression_metrics(numbers(spark, [10, 20, 30, 40], [12, 18, 31, 39]), []))
    assert r["mae"] == 1.5 and r["r2"] > 0.9 and r["mape"] is not None and r["median_absolute_error"] == 1.5
    zero = one(regression.regression_metrics(numbers(spark, [0, 20], [1, 20]), []))
    assert zero["mape"] is None and zero["accuracy_within_10_pct"] == 100.0
    flat = one(regression.regression_metrics(numbers(spark, [0, 0, 0], [0.05, 0.15, 0.3]), []))
    assert (flat["accuracy_within_10_pct"], flat["accuracy_within_20_pct"], flat["r2_pct"]) == (33.3, 66.7, 0.0)
    close = one(regression.regression_metrics(numbers(spark, [10, 20, 30, 40, 50], [10.5, 21, 28, 41, 52]), []))
    assert close["accuracy_within_10_pct"] == 100.0


def test_residuals(spark):
    df = numbers(spark, [10, 20, 30, 40, 50], [11, 19, 31, 38, 52])
    s = one(regression.residual_statistics(df, []))
    e = np.array([-1, 1, -1, 2, -2])
    assert s["mean"] == round(float(e.mean()), 4) and s["std"] == round(float(e.std()), 4) and s["median"] == -1.0
    assert one(regression.residual_statistics(df, [], SMALL)) == s
    h = regression.residual_histogram(df, []).orderBy("bin").collect()
    assert len(h) == 20 and sum(r["n"] for r in h) == 5 and h[-1]["n"] == 1
    assert regression.actual_vs_predicted(df, ["k"]).count() == 5
    assert one(regression.reference_line(df, [])) == {"min": 10.0, "max": 52.0}
    same = regression.residual_histogram(numbers(spark, [1, 2], [0, 1]), []).collect()
    assert sum(r["n"] for r in same) == 2 and min(r["bin_start"] for r in same) == 0.5


def test_extremes_are_always_in_the_sample(spark):
    df = spark.range(3000).selectExpr("id AS k", "cast(id AS double) AS y_true", "id + CASE WHEN id % 500 = 7 THEN 900 ELSE sin(id) END AS y_pred")
    points = regression.actual_vs_predicted(df, ["k"])
    assert points.count() == 500 and points.filter("abs_error = 900").count() == 6


def test_residual_findings(spark):
    kinds = lambda d: {r["type"] for r in regression.residual_diagnostics(d, []).collect()}
    biased = numbers(spark, range(40), [v - 10 + (v % 3) * .1 for v in range(40)])
    assert "residual_bias" in kinds(biased)
    spread = numbers(spark, range(40), [v + (0.01 if v < 20 else 4) * (-1) ** v for v in range(40)])
    assert "heteroscedasticity" in kinds(spread)
    lone = numbers(spark, range(60), [v + (30 if v == 7 else 0.1 * (-1) ** v) for v in range(60)])
    assert "outliers" in kinds(lone)
    calm = numbers(spark, range(40), [v + 0.1 * (-1) ** v for v in range(40)])
    assert kinds(calm) == {"normal"}


def test_class_errors(spark):
    df = outcomes(spark, ["cat", "dog", "bird", "cat", "dog"], ["cat", "bird", "bird", "dog", "dog"], [.9, .95, .8, .6, .7])
    m = one(errors.misclassification(c.outcome_counts(df, []), []))
    assert m["error_rate"] == 0.4
    w = errors.worst_misclassifications(df, ["k"], F.col("score")).collect()
    assert (w[0]["actual"], w[0]["predicted"], w[0]["confidence"]) == ("dog", "bird", 0.95)
    assert errors.confused_pairs(c.outcome_counts(df, []), []).count() == 2


def test_regression_errors(spark):
    df = numbers(spark, [100, 200, 300, 400], [105, 250, 290, 401])
    w = errors.worst_regression_errors(df, ["k"]).first()
    assert (w["actual"], w["abs_error"], w["relative_error_pct"]) == (200.0, 50.0, 25.0)
    s = one(errors.error_summary(df, ["k"]))
    assert (s["max_absolute_error"], s["median_absolute_error"], s["top5_mean"]) == (50.0, 7.5, 16.5)


def board(spark, rows):
    schema = ("run_id string, model_id string, model_name string, engine string, status string, is_naive_baseline boolean, "
              "primary_metric string, validation_score double, train_score double, test_score double")
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("metric,scores,order", [
    ("accuracy", (0.55, 0.88, 0.79), ["rf", "logreg", "dummy"]),
    ("rmse", (9.0, 3.0, 5.0), ["rf", "logreg", "dummy"]),
])
def test_winner(spark, metric, scores, order):
    rows = [("r", m, m, "e", "success", m == "dummy", metric, s, s, s) for m, s in zip(("dummy", "rf", "logreg"), scores)]
    rows.append(("r", "broken", "broken", "e", "failed", False, metric, None, None, None))
    ranked = diagnosis.rank_models(board(spark, rows)).orderBy("rank").collect()
    assert [r["model_id"] for r in ranked] == order + ["broken"]
    assert [r["model_id"] for r in ranked if r["is_winner"]] == ["rf"]
    alone = diagnosis.rank_models(board(spark, rows[:1] + rows[3:])).filter("is_winner").first()
    assert alone["model_id"] == "dummy"


def test_missing_score_is_ranked_last(spark):
    rows = [("r", "a", "a", "e", "success", False, "rmse", None, None, None), ("r", "b", "b", "e", "success", False, "rmse", 4.0, 4.0, 4.0)]
    assert diagnosis.rank_models(board(spark, rows)).filter("is_winner").first()["model_id"] == "b"


@pytest.mark.parametrize("metric,val,test,naive,label", [
    ("accuracy", 0.9995, 0.99, 0.5, "Suspiciously High Performance"),
    ("rmse", 0.0, 0.1, 5.0, "Suspiciously High Performance"),
    ("accuracy", 0.55, 0.56, 0.60, "Worse than Baseline"),
    ("accuracy", 0.60, 0.60, 0.60, "Underfitting"),
    ("r2", 0.03, 0.02, -0.1, "Underfitting"),
    ("accuracy", 0.61, 0.605, 0.60, "Underfitting"),
    ("accuracy", 0.85, 0.60, 0.5, "Severe Overfitting"),
    ("accuracy", 0.85, 0.75, 0.5, "Possible Overfitting"),
    ("accuracy", 0.85, 0.84, 0.5, "Normal / Well-fit"),
    ("rmse", 3.0, 2.0, 9.0, "Normal / Well-fit"),
])
def test_fit_labels(spark, metric, val, test, naive, label):
    rows = [("r", "m", "m", "e", "success", False, metric, val, val, test), ("r", "n", "n", "e", "success", True, metric, naive, naive, naive)]
    out = diagnosis.fit_diagnosis(diagnosis.with_naive_score(board(spark, rows))).filter("model_id = 'm'").first()
    assert out["diagnostic_label"] == label


def test_gaps_and_neutral_labels(spark):
    rows = [("r", "a", "a", "e", "success", False, "accuracy", 0.85, 0.95, 0.60), ("s", "b", "b", "e", "success", False, "rmse", 5.0, 4.0, 8.0),
            ("t", "c", "c", "e", "success", False, "accuracy", 0.55, 0.6, 0.5), ("t", "n", "n", "e", "success", True, "accuracy", 0.6, 0.6, 0.6)]
    out = by(diagnosis.generalization_diagnosis(diagnosis.with_naive_score(board(spark, rows))), "model_id")
    assert out["a"]["generalization_gap"] == 0.25 and out["a"]["diagnostic_label"] == "Large generalization gap"
    assert out["a"]["train_validation_gap"] == 0.1
    assert out["b"]["generalization_gap"] == 3.0 and out["b"]["train_validation_gap"] == 1.0
    assert out["c"]["diagnostic_label"] == "Worse than Baseline"
    chart = diagnosis.comparison_chart(diagnosis.rank_models(board(spark, rows))).filter("run_id = 'r'")
    assert {r["series"]: r["score"] for r in chart.collect()} == {"validation": 0.85, "train": 0.95, "test": 0.6}


def test_metric_rules(spark):
    assert diagnosis.default_metric("binary_classification", 20.0) == "f1"
    assert diagnosis.default_metric("binary_classification", 40.0) == "accuracy"
    assert diagnosis.default_metric("multiclass_classification") == "f1_macro"
    assert diagnosis.default_metric("regression") == "rmse"
    df = spark.createDataFrame([("accuracy", .8, .7), ("rmse", .8, .7), ("mae", 1.0, 1.0000001)], "m string, a double, b double")
    assert [r[0] for r in df.select(diagnosis.compare(F.col("m"), F.col("a"), F.col("b"))).collect()] == [1, -1, 0]

"""Classification metrics over a predictions table.

Input columns: `y_true`, `y_pred` and, for curves, `score` (probability of the positive
class) with `y_true` compared to a positive label. All results group by `by`, so the models
and folds of a run are scored in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.functions import cells
from colonnade.functions.ranking import running_totals
from colonnade.settings import DEFAULTS, Settings

THRESHOLDS = [i / 20 for i in range(1, 20)]


def _safe(a: Column, b: Column) -> Column:
    return F.coalesce(cells.ratio(a, b), F.lit(0.0))


def largest(value, label: Column) -> Column:
    """Aggregate: the value at the largest label, by number where all labels are numbers, else by text."""
    number = cells.as_number(label, T.StringType())
    return F.when(F.count(label) == F.count(number), F.max_by(value, number)).otherwise(F.max_by(value, label))


def outcome_counts(predictions: DataFrame, by: list[str]) -> DataFrame:
    """`(by, y_true, y_pred, n)`: the only pass over the predictions; everything else works on it."""
    return predictions.groupBy(*by, F.col("y_true").cast("string").alias("y_true"),
                               F.col("y_pred").cast("string").alias("y_pred")).agg(F.count("*").alias("n"))


def class_table(counts: DataFrame, by: list[str]) -> DataFrame:
    """Per label of either side: support, predicted, hits and the three rates.

    Each cell contributes to its true label and to its predicted label, so one grouping
    replaces an outer join of two.
    """
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), zero.alias("predicted"),
                 hit.cast("long").alias("hits")),
        F.struct(F.col("y_pred").alias("label"), zero.alias("support"), F.col("n").alias("predicted"),
                 zero.alias("hits")),
    )
    sums = counts.select(*by, F.inline(sides)).groupBy(*by, "label").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "hits")]
    )
    precision = _safe(F.col("hits"), F.col("predicted"))
    recall = _safe(F.col("hits"), F.col("support"))
    f1 = _safe(2 * F.col("hits"), F.col("support") + F.col("predicted"))
    return sums.withColumns({"precision": precision, "recall": recall, "f1": f1})


def per_class(counts: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support per true label."""
    return class_table(counts, by).filter("support > 0").select(
        *by, F.col("label").alias("class_label"),
        *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support",
    )


def summary_metrics(counts: DataFrame, by: list[str], binary: bool) -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall, F1 (positive class or macro), weighted F1, percents.

    The positive class of a binary problem is the largest true label.
    """
    table = class_table(counts, by)
    true_label = F.when(F.col("support") > 0, F.col("label"))

    def pick(c):
        """Value of the positive class for binary problems, plain mean over labels otherwise."""
        return largest(c, true_label) if binary else F.avg(c)

    rates = table.groupBy(*by).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        pick("precision").alias("precision"), pick("recall").alias("recall"), pick("f1").alias("f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )
    names = ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "weighted_f1")
    out = rates.select(*by, *[F.round(c, 4).alias(c) for c in names])
    return out.withColumns({f"{c}_pct": F.round(F.col(c) * 100.0, 1) for c in ("accuracy", "precision", "recall", "f1")})


def accuracy_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """Correct and incorrect predictions with accuracy and error percent."""
    right = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    out = counts.groupBy(*by).agg(F.sum("n").alias("total"), right.cast("long").alias("correct"))
    accuracy = F.round(_safe(F.col("correct"), F.col("total")), 4)
    return out.select(
        *by, "total", "correct", (F.col("total") - F.col("correct")).alias("incorrect"),
        F.round(accuracy * 100.0, 1).alias("accuracy_pct"),
        F.round((1.0 - accuracy) * 100.0, 1).alias("error_pct"),
    )


def confusion_matrix(counts: DataFrame, by: list[str]) -> DataFrame:
    """Counts and row shares for every pair of true labels, zeros filled in.

    The grid is spread from one array of labels per group; its size is the square of the
    number of classes, which is what a confusion matrix is.
    """
    counts = counts.withColumn("labels", F.lit(True))
    true_labels = counts.groupBy(*by).agg(F.array_sort(F.collect_set("y_true")).alias("labels"))
    # classes only ever predicted have no row or column, as in the per-class table
    grid = (
        true_labels.select(*by, F.explode("labels").alias("y_true"), "labels")
        .select(*by, "y_true", F.explode("labels").alias("y_pred"))
    )
    cellsum = cells.join_by(grid, counts.drop("labels"), [*by, "y_true", "y_pred"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0)).cast("long")
    )
    row = F.sum("n").over(Window.partitionBy(*by, "y_true"))
    return cellsum.select(*by, "y_true", "y_pred", "n", F.round(_safe(F.col("n"), row), 4).alias("share"))


def binary_breakdown(counts: DataFrame, by: list[str]) -> DataFrame:
    """TN, FP, FN, TP, specificity and sensitivity; the larger label is positive."""
    top = counts.groupBy(*by).agg(largest("y_true", F.col("y_true")).alias("positive"))
    marked = cells.join_by(counts, top, by) if by else counts.withColumn(
        "positive", F.lit(top.first()["positive"])
    )
    is_pos, said_pos = F.col("y_true") == F.col("positive"), F.col("y_pred") == F.col("positive")

    def total(test):
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")

    sums = marked.groupBy(*by).agg(
        total(~is_pos & ~said_pos).alias("true_negatives"), total(~is_pos & said_pos).alias("false_positives"),
        total(is_pos & ~said_pos).alias("false_negatives"), total(is_pos & said_pos).alias("true_positives"),
    )
    tn, fp, fn, tp = (F.col(c) for c in ("true_negatives", "false_positives", "false_negatives", "true_positives"))
    return sums.select(
        "*", F.round(_safe(tn, tn + fp), 4).alias("specificity"), F.round(_safe(tp, tp + fn), 4).alias("sensitivity")
    )


def score_table(
    scored: DataFrame, by: list[str], settings: Settings = DEFAULTS, rows: int | None = None
) -> DataFrame:
    """Distinct scores, highest first: positives, negatives and their running totals.

    `scored` has `score` and `is_positive` (0/1). Rows are combined per score before the
    shuffle; the totals over the order are taken in two levels on large tables.
    """
    rows = scored.count() if rows is None else rows
    groups = scored.groupBy(*by, F.col("score").cast("double").alias("score")).agg(
        F.sum(F.col("is_positive").cast("long")).alias("pos"),
        F.sum(1 - F.col("is_positive").cast("long")).alias("neg"),
    ).withColumn("one", F.lit(1).cast("long"))
    placed = running_totals(groups, by, "score", ["pos", "neg", "one"], rows, settings, descending=True)
    sizes = groups.groupBy(*by).agg(
        F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), F.count("*").alias("points"),
    )
    # One row per model and fold on the right.
    if by:
        return cells.join_by(placed, sizes, by)
    size = sizes.first()
    return placed.withColumns({c: F.lit(size[c]).cast("long") for c in ("all_pos", "all_neg", "points")})


def _corner(table: DataFrame, by: list[str], columns: dict[str, Column]) -> DataFrame:
    heads = table.groupBy(*by).agg(F.max("points").alias("points"))
    return heads.select(*by, *[c.alias(n) for n, c in columns.items()])


def roc_points(table: DataFrame, by: list[str]) -> DataFrame:
    """(position, threshold, fpr, tpr) from the origin on; one row per distinct score."""
    points = table.select(
        *by, (F.col("one_before") + 1).alias("position"), (F.col("points") + 1).alias("points"),
        F.col("score").alias("threshold"),
        _safe(F.col("neg_before") + F.col("neg"), F.col("all_neg")).alias("fpr"),
        _safe(F.col("pos_before") + F.col("pos"), F.col("all_pos")).alias("tpr"),
    )
    origin = _corner(table, by, {
        "position": F.lit(0).cast("long"), "points": F.col("points") + 1, "threshold": F.lit(None).cast("double"),
        "fpr": F.lit(0.0), "tpr": F.lit(0.0),
    })
    return points.unionByName(origin)


def precision_recall_points(table: DataFrame, by: list[str]) -> DataFrame:
    """(position, threshold, precision, recall) from the lowest score to the (1, 0) end."""
    hits = F.col("pos_before") + F.col("pos")
    said = hits + F.col("neg_before") + F.col("neg")
    points = table.select(
        *by, (F.col("points") - F.col("one_before") - 1).alias("position"), (F.col("points") + 1).alias("points"),
        F.col("score").alias("threshold"), _safe(hits, said).alias("precision"),
        _safe(hits, F.col("all_pos")).alias("recall"),
    )
    end = _corner(table, by, {
        "position": F.col("points"), "points": F.col("points") + 1, "threshold": F.lit(None).cast("double"),
        "precision": F.lit(1.0), "recall": F.lit(0.0),
    })
    return points.unionByName(end)


def thin_curve(curve: DataFrame, max_points: int = 100) -> DataFrame:
    """At most `max_points` evenly spaced positions of a curve, both ends kept."""
    n, p, m = F.col("points"), F.col("position"), F.lit(max_points)
    span = F.greatest(n - 1, F.lit(1))
    step = F.ceil(p * (m - 1) / span)
    near = F.floor(step * span / (m - 1))
    return curve.filter((n <= m) | ((near == p) & (step <= m - 1)))


def auc(table: DataFrame, by: list[str]) -> DataFrame:
    """ROC AUC and average precision; AUC is null when one class is absent."""
    neg, pos, above = F.col("neg"), F.col("pos"), F.col("pos_before")
    hits = above + pos
    share = cells.ratio(hits, hits + F.col("neg_before") + neg)
    out = table.groupBy(*by).agg(
        F.sum(neg.cast("double") * (above + pos / 2.0)).alias("won"),
        F.sum(pos * share).alias("gained"),
        F.max("all_pos").alias("p"), F.max("all_neg").alias("n"),
    )
    return out.select(
        *by, F.round(cells.ratio(F.col("won"), F.col("p").cast("double") * F.col("n")), 4).alias("roc_auc"),
        F.round(cells.ratio(F.col("gained"), F.col("p")), 4).alias("pr_auc"),
    )


def multiclass_auc(
    scored: DataFrame, by: list[str], labels: list[str], settings: Settings = DEFAULTS, rows: int | None = None
) -> DataFrame:
    """One-vs-rest AUC, plain mean over classes; `probs` holds one probability per label in order."""
    rows = scored.count() if rows is None else rows
    spread = scored.select(*by, F.col("y_true").cast("string").alias("y_true"), F.posexplode("probs").alias("at", "score"))
    names = F.array(*map(F.lit, labels))
    each = spread.select(
        *by, F.element_at(names, F.col("at") + 1).alias("class_label"), "score",
        (F.col("y_true") == F.element_at(names, F.col("at") + 1)).cast("int").alias("is_positive"),
    )
    keys = [*by, "class_label"]
    table = score_table(each, keys, settings, rows * len(labels))
    won = F.sum(F.col("neg").cast("double") * (F.col("pos_before") + F.col("pos") / 2.0))
    single = table.groupBy(*keys).agg(won.alias("won"), F.max("all_pos").alias("p"), F.max("all_neg").alias("n"))
    area = cells.ratio(F.col("won"), F.col("p").cast("double") * F.col("n"))
    return single.groupBy(*by).agg(F.round(F.avg(area), 4).alias("roc_auc"))


def threshold_table(scored: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1, accuracy and outcome counts at 0.05, 0.10 .. 0.95. One map-side aggregate."""
    pos = F.col("is_positive").cast("int") == 1
    score = F.col("score")
    aggs = [F.count_if(pos).alias("p"), F.count_if(~pos).alias("n")]
    for i, t in enumerate(THRESHOLDS):
        aggs += [F.count_if(pos & (score >= t)).alias(f"tp_{i}"), F.count_if(~pos & (score >= t)).alias(f"fp_{i}")]
    long = scored.groupBy(*by).agg(*aggs).select(*by, "p", "n", F.inline(F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"tp_{i}").alias("tp"), F.col(f"fp_{i}").alias("fp"))
        for i, t in enumerate(THRESHOLDS)
    ])))
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("p") - tp, F.col("n") - fp
    return long.select(
        *by, "threshold",
        F.round(_safe(tp, tp + fp), 4).alias("precision"),
        F.round(_safe(tp, tp + fn), 4).alias("recall"),
        F.round(_safe(2 * tp, 2 * tp + fp + fn), 4).alias("f1"),
        F.round(_safe(tp + tn, F.col("p") + F.col("n")), 4).alias("accuracy"),
        tp.alias("true_positives"), fp.alias("false_positives"),
        tn.alias("true_negatives"), fn.alias("false_negatives"),
    )


def nearest_threshold(thresholds: DataFrame, by: list[str], cut: float) -> DataFrame:
    """The row of the threshold table closest to a cut-off, the lower one on a tie."""
    rest = [c for c in thresholds.columns if c not in by]
    away = F.struct(F.round(F.abs(F.col("threshold") - cut), 9), F.col("threshold"))
    best = thresholds.groupBy(*by).agg(F.min_by(F.struct(*rest), away).alias("r"))
    return best.select(*by, "r.*")


def calibration(scored: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Mean score and observed rate per equal-width bin; empty bins are left out."""
    b = F.greatest(F.lit(0), F.ceil(F.col("score") * bins) - 1).cast("long")
    return scored.groupBy(*by, b.alias("bin")).agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("prob_pred"),
        F.round(F.avg(F.col("is_positive").cast("double")), 4).alias("prob_true"),
    )


def brier_score(scored: DataFrame, by: list[str]) -> DataFrame:
    miss = F.col("score") - F.col("is_positive").cast("double")
    return scored.groupBy(*by).agg(F.round(F.avg(miss * miss), 4).alias("brier_score"))

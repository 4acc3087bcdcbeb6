"""Error analysis of predictions: confusions, worst cases, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colonnade.functions import cells
from colonnade.functions.quantiles import column_quantiles
from colonnade.operators.regression import numeric_pairs
from colonnade.settings import DEFAULTS, Settings


def misclassification(counts: DataFrame, by: list[str]) -> DataFrame:
    """Evaluated and wrong predictions and the error rate, from outcome counts."""
    wrong = F.sum(F.when(F.col("y_true") != F.col("y_pred"), F.col("n")).otherwise(0)).cast("long")
    out = counts.groupBy(*by).agg(F.sum("n").alias("total"), wrong.alias("wrong"))
    return out.withColumn("error_rate", F.round(cells.ratio(F.col("wrong"), F.col("total")), 4))


def confused_pairs(counts: DataFrame, by: list[str], top: int = 10) -> DataFrame:
    """Most frequent (actual, predicted) confusions per group, ties in label order."""
    wrong = counts.filter(F.col("y_true") != F.col("y_pred"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "y_true", "y_pred")
    ranked = wrong.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top)
    return ranked.select(*by, "rank", F.col("y_true").alias("actual"), F.col("y_pred").alias("predicted"), "n")


def worst_misclassifications(predictions: DataFrame, keys: list[str], confidence, top: int = 20) -> DataFrame:
    """Wrong predictions held with the highest confidence. A top-k, so no task keeps more than `top` rows.

    `confidence` is the expression for the probability of the predicted class.
    """
    wrong = predictions.filter(F.col("y_true").cast("string") != F.col("y_pred").cast("string"))
    return (
        wrong.select(
            *keys, F.col("y_true").cast("string").alias("actual"), F.col("y_pred").cast("string").alias("predicted"),
            F.round(F.coalesce(confidence, F.lit(1.0)), 4).alias("confidence"),
        )
        .orderBy(F.desc("confidence"), *keys)
        .limit(top)
    )


def worst_regression_errors(predictions: DataFrame, keys: list[str], top: int = 20) -> DataFrame:
    """Largest absolute errors with residual and relative error in percent."""
    df = numeric_pairs(predictions)
    size = F.abs("residual")
    relative = F.when(F.abs("y") > 1e-5, F.round(size / F.abs(F.nullif(F.col("y"), F.lit(0.0))) * 100.0, 2))
    return (
        df.select(*keys, "y", "p", "residual", size.alias("size"), relative.alias("relative_error_pct"))
        .orderBy(F.desc("size"), *keys)
        .limit(top)
        .select(*keys, F.round("y", 4).alias("actual"), F.round("p", 4).alias("predicted"),
                F.round("residual", 4).alias("residual"), F.round("size", 4).alias("abs_error"), "relative_error_pct")
    )


def error_summary(predictions: DataFrame, keys: list[str], settings: Settings = DEFAULTS, rows: int | None = None) -> DataFrame:
    """Mean, median and largest absolute error, and the mean of the five largest."""
    df = numeric_pairs(predictions)
    size = F.abs(F.col("residual"))
    median = column_quantiles(df.select(size.alias("m")), ["m"], [0.5], settings, rows)["m"][0]
    worst = df.select(size.alias("size"), *keys).orderBy(F.desc("size"), *keys).limit(5)
    top5 = worst.agg(F.round(F.avg("size"), 4).alias("top5_mean")).first()["top5_mean"]
    return df.agg(
        F.count("*").alias("total"), F.round(F.avg(size), 4).alias("mae"),
        F.round(F.lit(median).cast("double"), 4).alias("median_absolute_error"), F.round(F.max(size), 4).alias("max_absolute_error"),
        F.lit(top5).cast("double").alias("top5_mean"),
    )



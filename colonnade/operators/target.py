"""Target checks, problem type, class balance, regression target profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions import cells
from colonnade.operators import catalog, statistics
from colonnade.settings import DEFAULTS, Settings

BINARY = "binary_classification"
MULTICLASS = "multiclass_classification"
REGRESSION = "regression"
AMBIGUOUS = "ambiguous"


class InvalidTargetError(ValueError):
    pass


def is_classification(problem_type: str) -> bool:
    return "classification" in problem_type.lower()


def target_facts(df: DataFrame, target: str) -> DataFrame:
    """One row: counts, distinct values, whether any number has decimals, the id warning."""
    catalog.require_columns(df, target)
    dtype = cells.type_of(df, target)
    value = cells.without_nan(cells.quoted(target), dtype)
    number = cells.number(df, target)
    facts = df.agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count(value).alias("valid_count"),
        F.count_distinct(cells.distinct_key(cells.quoted(target), dtype)).alias("unique_count"),
        F.coalesce(F.bool_or(number != F.rint(number)), F.lit(False)).alias("has_decimals"),
    )
    unique_ratio = F.col("unique_count") / F.greatest(F.col("valid_count"), F.lit(1))
    return facts.select(
        F.lit(target).alias("target"),
        "total_count", "valid_count",
        (F.col("total_count") - F.col("valid_count")).alias("missing_count"),
        cells.percent(F.col("total_count") - F.col("valid_count"), F.col("total_count")).alias("missing_percentage"),
        "unique_count", "has_decimals",
        ((unique_ratio > 0.95) & (F.col("valid_count") > 50)).alias("id_warning"),
        F.when(F.col("valid_count") < 10, "fewer than 10 observations")
        .when(F.col("unique_count") <= 1, "constant").alias("problem"),
    )


def with_problem_type(facts: DataFrame, logical_type: str) -> DataFrame:
    """Problem type and confidence from the target facts and its logical type."""
    n = F.col("unique_count")
    numeric = logical_type in catalog.NUMERIC
    rules = [(n == 2, BINARY, "high", "two distinct outcomes")]
    if logical_type in catalog.CATEGORY_LIKE:
        rules += [
            (n <= 100, MULTICLASS, "high", "discrete classes"),
            (F.lit(True), AMBIGUOUS, "low", "too many distinct texts for classes"),
        ]
    elif numeric:
        rules += [
            (F.col("has_decimals") | (n > 30), REGRESSION, "high", "continuous number"),
            ((n >= 3) & (n <= 20), AMBIGUOUS, "medium", "few whole numbers: classes or a scale"),
            (F.lit(True), REGRESSION, "medium", "whole numbers with many levels"),
        ]
    else:
        rules.append((F.lit(True), AMBIGUOUS, "high", ""))

    def pick(k):
        chain = F
        for test, *words in rules:
            chain = chain.when(test, words[k])
        return chain

    return facts.withColumns({
        "inferred_dtype": F.lit(logical_type),
        "problem_type": pick(0),
        "confidence": pick(1),
        "reason": pick(2),
    })


def inspect_target(df: DataFrame, target: str, settings: Settings = DEFAULTS) -> dict:
    """Facts and problem type on the driver; an unusable target raises."""
    catalog.require_columns(df, target)
    kind = catalog.column_types(df.select(cells.quoted(target)), settings)[target]
    row = with_problem_type(target_facts(df, target), kind).first().asDict()
    if row["problem"]:
        raise InvalidTargetError(f"target {target!r}: {row['problem']}")
    return row


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Count and share per class with the minority share and the imbalance flag (below 15%)."""
    catalog.require_columns(df, target)
    value = cells.without_nan(cells.quoted(target), cells.type_of(df, target)).cast("string")
    counts = df.select(value.alias("class_label")).dropna().groupBy("class_label").agg(F.count("*").alias("n"))
    # One row of totals, read first: a target with very many values never meets in one task.
    whole = counts.agg(F.sum("n").alias("rows"), F.min("n").alias("low")).first()
    rows, low = whole["rows"] or 0, whole["low"] or 0
    least = cells.percent(F.lit(low), F.lit(rows))
    return counts.select(
        "class_label", "n", cells.percent(F.col("n"), F.lit(rows)).alias("percentage"),
        least.alias("minority_percentage"), (least < 15.0).alias("is_imbalanced"),
    )


def regression_target_profile(df: DataFrame, target: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Location, spread and the number of values beyond the 1.5 IQR fences."""
    catalog.require_columns(df, target)
    profile = statistics.numeric_profile(df, [target], settings)
    beyond = statistics.outliers(df, [target], 1.5, settings)
    extremes = beyond.select("column", F.col("outliers_count").alias("extreme_count"))
    return profile.select("column", "mean", "median", "std", "min", "max", "q1", "q3", "iqr").join(
        F.broadcast(extremes), "column"
    )

"""Whether a table, a target and a feature list can be trained on: blocking reasons and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions import cells
from colonnade.operators.target import REGRESSION, is_classification

SCHEMA = "severity string, code string, detail string"


def training_suitability(df: DataFrame, target: str, problem_type: str, features: list[str]) -> DataFrame:
    """(severity, code, detail) rows; `blocking` rows forbid training, `warning` rows do not."""
    spark = df.sparkSession
    if target not in df.columns:
        return spark.createDataFrame([("blocking", "target_missing", target)], SCHEMA)
    known = []
    if not features:
        known.append(("blocking", "no_features", ""))
    absent = [f for f in features if f not in df.columns]
    if absent:
        known.append(("blocking", "features_missing", ",".join(absent)))
    if target in features:
        known.append(("blocking", "target_in_features", target))
    for f in features:
        if target.lower() in f.lower() and f.lower() != target.lower():
            known.append(("warning", "resembles_target", f))

    value = cells.without_nan(cells.quoted(target), cells.type_of(df, target))
    number = cells.number(df, target)
    classes = df.select(value.alias("label"), number.alias("number")).groupBy("label").agg(
        F.count("*").alias("n"), F.count("number").alias("numbers")
    )
    facts = classes.agg(
        F.coalesce(F.sum(F.when(F.col("label").isNotNull(), F.col("n"))), F.lit(0)).alias("valid"),
        F.count_if(F.col("label").isNotNull()).alias("classes"),
        F.min(F.when(F.col("label").isNotNull(), F.col("n"))).alias("smallest"),
        F.max(F.when(F.col("label").isNotNull(), F.col("n"))).alias("largest"),
        F.coalesce(F.sum("numbers"), F.lit(0)).alias("numbers"),
        F.min_by("label", F.when(F.col("label").isNotNull(), F.struct("n", "label"))).cast("string").alias("rarest"),
    )
    tests = [
        ("blocking", "too_few_rows", F.col("valid") < 10, F.col("valid").cast("string")),
        ("warning", "small_table", (F.col("valid") >= 10) & (F.col("valid") < 100), F.col("valid").cast("string")),
        ("blocking", "constant_target", F.col("classes") <= 1, F.col("classes").cast("string")),
    ]
    if is_classification(problem_type):
        imbalance = F.col("largest") / F.greatest(F.col("smallest"), F.lit(1))
        tests += [
            ("blocking", "too_few_classes", F.col("classes") < 2, F.col("classes").cast("string")),
            ("warning", "tiny_class", F.col("smallest") < 2, F.col("rarest")),
            ("warning", "class_imbalance", imbalance > 4.0, F.round(imbalance, 1).cast("string")),
        ]
    elif problem_type.lower().strip() == REGRESSION:
        tests.append(("blocking", "too_few_numbers", F.col("numbers") < 10, F.col("numbers").cast("string")))
    rows = [
        F.when(test, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), detail.alias("detail")))
        for s, c, test, detail in tests
    ]
    found = facts.select(F.inline(F.array_compact(F.array(*rows))))
    return found.unionByName(spark.createDataFrame(known, SCHEMA)) if known else found


def is_suitable(findings: DataFrame) -> bool:
    return findings.filter("severity = 'blocking'").isEmpty()

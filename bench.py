"""Headline queries (the better of two runs) and model fits (one run); prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "src2_parquet_scan", "src7_preview", "exp5_safe_rounding", "prf2_column_summary", "prf2_sample_values", "prf3_duplicate_rows", "qlt2_quality_score", "src1_csv_scan",
    "eda1_numeric_profile", "eda1_numeric_profile_inferred", "eda3_categorical_profile", "eda4_missing_by_column",
    "eda6_temporal_profile", "eda7_correlation_matrix", "eda10_iqr_outliers", "cht2_histogram_prices", "cht7_scatter_sample",
    "cht9_time_series", "cht10_grouped_box", "cht11_contingency", "tgt3_class_balance", "aud1_feature_audit",
    "spl2_stratified_split", "spl5_three_way_split", "pre5_standard_scaling", "pre8_assembled_transform",
    "evc1_summary_binary", "evc6_roc_curve", "evc7_roc_auc", "evc11_threshold_table", "evr1_regression_metrics",
    "evr6_residual_histogram", "err4_worst_regression_errors", "trn12_model_ranking", "xai6_global_attribution",
]
# Timed once: each trains or scores many models. The first of them includes the fits that the others share.
RUNS = ["trn9_candidate_run", "evl1_full_evaluation", "xai3_permutation_importance", "xai5_sampled_shapley"]
# Timed at a tenth of the rows as well, to show how time grows.
GROWTH = ["eda1_numeric_profile", "eda10_iqr_outliers", "evr1_regression_metrics", "pre8_assembled_transform", "prf3_duplicate_rows"]


def fits(spark, sf):
    """Seconds per fit on the lines table: logistic regression, forest, boosted trees."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    from colonnade.operators import models

    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    labelled = lines.withColumn("label", (F.col("l_quantity") * (1 - F.col("l_discount")) > 24).cast("double"))
    rows = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_extendedprice", "l_tax"], outputCol="features").transform(labelled)
    rows = rows.select("label", "features").repartition(spark.sparkContext.defaultParallelism).persist()
    n = rows.count()
    out = {}
    for name, estimator in {
        "fit_logistic_regression": models.linear_classifier(n, 2),
        "fit_random_forest": RandomForestClassifier(numTrees=20, maxDepth=8, seed=42),
        "fit_boosted_trees": GBTClassifier(maxIter=10, maxDepth=5, seed=42),
    }.items():
        began = time.perf_counter()
        estimator.fit(rows)
        out[name] = round(time.perf_counter() - began, 3)
    rows.unpersist()
    return out


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from workload import QUERIES

    def run(name, sf=sf):
        began = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    times = {name: min(run(name), run(name)) for name in HEADLINE}
    times.update({name: run(name) for name in RUNS})
    times.update(fits(spark, sf))
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.01")
    growth = {name: min(run(name, small), run(name, small)) for name in GROWTH} if os.path.isdir(small) else {}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "queries_sf0.01": growth, "sf": sf.rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()

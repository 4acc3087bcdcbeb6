"""Result tables, fitted pipelines and run records on shared storage."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_result(df: DataFrame, path: str, form: str = "json") -> str:
    """Write a result table in parallel, one file per partition; nested parts stay nested."""
    df.write.mode("overwrite").format(form).save(path)
    return path


def read_result(spark: SparkSession, path: str, form: str = "json", schema=None) -> DataFrame:
    reader = spark.read.format(form)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def save_pipeline(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def append_run(summary: DataFrame, base: str, dataset: str) -> None:
    """Add the summary rows of a run to the run table, partitioned by dataset."""
    summary.withColumn("dataset", F.lit(dataset)).write.mode("append").partitionBy("dataset").parquet(base)


def list_runs(spark: SparkSession, base: str, dataset: str) -> DataFrame:
    """Runs of a dataset, newest first; only that dataset's partition is read."""
    return spark.read.parquet(base).filter(F.col("dataset") == dataset).orderBy(F.desc("run_id"))


def get_run(spark: SparkSession, base: str, run_id: str) -> DataFrame:
    return spark.read.parquet(base).filter(F.col("run_id") == run_id)

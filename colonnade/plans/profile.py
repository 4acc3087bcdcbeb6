"""Read, profile and score a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colonnade.operators import catalog, quality
from colonnade.settings import DEFAULTS, Settings
from colonnade.sources import csv_files, tables


def profile_table(df: DataFrame, keys: list[str], settings: Settings = DEFAULTS) -> dict[str, DataFrame]:
    """Everything shown after a table is loaded, by part name."""
    summary = catalog.column_summary(df, settings)
    duplicates = catalog.duplicate_rows(df)
    return {
        "summary": summary,
        "samples": catalog.sample_values(df, keys),
        "duplicates": duplicates,
        "overview": catalog.dataset_overview(summary, duplicates),
        "suspicious": quality.suspicious_columns(summary),
        "score": quality.quality_score(summary, duplicates),
        "checks": quality.quality_checks(summary, duplicates),
        "preview": tables.preview(df, keys, settings=settings),
    }


def ingest_csv(
    spark: SparkSession, paths: list[str], keys: list[str] | None = None, settings: Settings = DEFAULTS
) -> dict[str, DataFrame]:
    """Read and repair CSV files, then profile them."""
    df, report = csv_files.read_csv(spark, paths)
    keys = df.columns if keys is None else keys
    return {"table": df, "report": report.to_df(spark), "facts": report.facts(spark), **profile_table(df, keys, settings)}

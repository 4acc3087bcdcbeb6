"""Table scans and the row preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions import cells
from colonnade.operators import catalog
from colonnade.settings import DEFAULTS, Settings


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; filters and column choice of later steps reach it."""
    df = spark.read.parquet(path)
    return df.select(*[cells.quoted(c) for c in columns]) if columns else df


def preview(df: DataFrame, keys: list[str], limit: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """First rows in key order: fractions rounded to 6 places, NaN and infinities null, other types as text."""
    limit = settings.preview_rows if limit is None else limit
    if not 1 <= limit <= settings.preview_rows_max:
        raise ValueError(f"preview size must lie between 1 and {settings.preview_rows_max}")
    catalog.require_columns(df, *keys)

    def shown(c):
        dtype = cells.type_of(df, c)
        if isinstance(dtype, cells.INTEGER_TYPES):
            return cells.quoted(c)
        if isinstance(dtype, cells.FRACTION_TYPES):
            return cells.rounded(cells.quoted(c), 6).alias(c)
        return cells.quoted(c).cast("string").alias(c)

    return df.orderBy(*keys).limit(limit).select(*[shown(c) for c in df.columns])


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))

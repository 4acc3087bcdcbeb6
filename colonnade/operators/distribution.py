"""Per-column distribution bundles and target profiles, chosen by logical type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.operators import association, catalog, charts, statistics
from colonnade.settings import DEFAULTS, Settings


def column_distribution(
    df: DataFrame, column: str, kind: str | None = None, settings: Settings = DEFAULTS
) -> dict[str, DataFrame]:
    """The parts that describe one column, by part name."""
    catalog.require_columns(df, column)
    kind = catalog.column_types(df.select(column), settings)[column] if kind is None else kind
    if kind in catalog.NUMERIC:
        return {
            "stats": statistics.numeric_profile(df, [column], settings),
            "outliers": statistics.outliers(df, [column], settings=settings),
            "histogram": charts.histogram(df, column, settings=settings),
            "box": charts.box_numbers(df, [column], settings=settings),
        }
    if kind == "datetime-like":
        return {
            "temporal": statistics.temporal_profile(df, [column], settings),
            "chart": charts.records_over_time(df, column),
        }
    return {
        "stats": statistics.categorical_profile(df, [column], settings=settings),
        "chart": charts.category_bars(df, column, settings=settings),
    }


def imbalance(profile: DataFrame) -> DataFrame:
    """Categorical target profile with the flag for a top class above 80% of all rows."""
    return profile.withColumn("is_imbalanced", F.col("mode_percentage") > 80.0)


def target_analysis(
    df: DataFrame, target: str, types: dict[str, str] | None = None, settings: Settings = DEFAULTS
) -> dict[str, DataFrame]:
    """Profile of a chosen target: associations for a number, class balance for anything else."""
    catalog.require_columns(df, target)
    types = catalog.column_types(df, settings) if types is None else types
    parts = column_distribution(df, target, types[target] if types[target] != "datetime-like" else "categorical",
                                settings)
    if types[target] in catalog.NUMERIC:
        numeric = catalog.columns_of(types, *catalog.NUMERIC)
        parts["associations"] = association.target_associations(df, target, numeric, settings=settings)
    else:
        parts["stats"] = imbalance(parts["stats"])
    return parts

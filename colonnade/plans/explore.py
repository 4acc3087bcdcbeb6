"""All exploratory tables of one dataset, planned from one reading of the column types."""

from __future__ import annotations

from pyspark.sql import DataFrame

from colonnade.operators import association, catalog, charts, statistics
from colonnade.settings import DEFAULTS, Settings


def explore(df: DataFrame, settings: Settings = DEFAULTS) -> dict[str, DataFrame]:
    types = catalog.column_types(df, settings)
    numeric = catalog.columns_of(types, *catalog.NUMERIC)
    categories = catalog.columns_of(types, *catalog.CATEGORY_LIKE)
    dates = catalog.columns_of(types, "datetime-like")
    missing = statistics.missing_by_column(df)
    out = {
        "missing": missing,
        "missing_totals": statistics.missing_totals(missing),
        "missing_chart": charts.missingness_bars(missing),
    }
    if numeric:
        matrix = association.correlation_matrix(df, numeric, settings)
        out |= {
            "numeric": statistics.numeric_profile(df, numeric, settings),
            "outliers": statistics.outliers(df, numeric, settings=settings),
            "correlation": matrix,
            "strong_pairs": association.strong_pairs(matrix, settings=settings),
        }
    if categories:
        out |= {
            "categorical": statistics.categorical_profile(df, categories, settings=settings),
            "top_categories": statistics.top_categories(df, categories, settings=settings),
        }
    if dates:
        out["temporal"] = statistics.temporal_profile(df, dates, settings)
    return out

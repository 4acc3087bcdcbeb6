"""Thresholds and defaults used by the operators."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

ENV_PREFIX = "COLONNADE_"


@dataclass(frozen=True)
class Settings:
    # Heuristics on columns.
    high_cardinality_min: int = 50
    high_cardinality_ratio: float = 0.50
    id_ratio: float = 0.95
    constant_max_distinct: int = 1
    excessive_missing_ratio: float = 0.70
    max_one_hot_levels: int = 50

    # Exploration.
    preview_rows: int = 20
    preview_rows_max: int = 100
    top_categories: int = 10
    chart_categories: int = 8
    top_correlation_pairs: int = 10
    strong_correlation: float = 0.5
    iqr_multiplier: float = 1.5
    histogram_bins: int = 20
    chart_points: int = 2000

    # Preparation and training.
    seed: int = 42
    test_size: float = 0.20
    validation_size: float = 0.20
    target_score: float = 0.80
    shap_sample: int = 500
    shap_background: int = 30
    shap_orders: int = 16
    permutation_repeats: int = 5
    parallel_fits: int = 4              # candidates that are fitted at the same time
    search_rungs: tuple = (0.25, 0.5)   # parts of the training fold on which a search sorts out combinations
    search_rows: int = 1000             # rows a part must hold to be used for that

    # Physical limits. Work above these bounds takes the distributed form.
    one_task_rows: int = 2_000_000      # rows one task may hold as distinct values
    forest_rows: int = 250_000          # rows up to which a forest for classification is MLlib's
    range_rows: int = 250_000           # rows of a range of a global order, sorted by one task
    exact_percentile_rows: int = 100_000  # rows whose distinct values the built-in percentile may hold
    order_buckets: int = 5_000          # most ranges a global order is cut into; each is sorted with spilling
    quantile_bins: int = 4096           # histogram bins per order-statistic pass
    hash_digits: int = 4                # hex digits of md5 used as order buckets
    columns_per_aggregate: int = 8      # keeps generated methods small enough to be compiled
    pairs_per_aggregate: int = 30

    @classmethod
    def from_env(cls) -> "Settings":
        """Defaults, each replaceable by an environment variable named after its field."""
        given = {}
        for f in fields(cls):
            raw = os.environ.get(ENV_PREFIX + f.name.upper())
            if raw is not None:
                given[f.name] = tuple(map(float, raw.split(","))) if isinstance(f.default, tuple) else type(f.default)(raw)
        return cls(**given)


DEFAULTS = Settings()

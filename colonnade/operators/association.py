"""Pearson correlation in long form, strong pairs, association with a numeric target."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colonnade.functions import cells
from colonnade.operators import catalog
from colonnade.operators.statistics import _empty, _numeric, _union, column_ranges
from colonnade.settings import DEFAULTS, Settings


def rank_by_spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns by std / (|mean| + 1e-5), widest first: (position, column, spread, rank)."""
    aggs, rows = {}, []
    for i, c in enumerate(columns):
        aggs |= {f"n_{i}": f"count(v_{i})", f"s_{i}": f"stddev_samp(v_{i})", f"m_{i}": f"avg(v_{i})"}
        spread = f"CASE WHEN n_{i} > 1 THEN s_{i} / (abs(m_{i}) + 1e-5D) ELSE 0.0D END"
        rows.append({"position": f"{i}L", "column": cells.sql_text(c), "spread": spread})
    long = cells.inline_rows(cells.aggregate(cells.numbers(df, columns), aggs), rows)
    order = Window.partitionBy().orderBy(F.desc("spread"), "position")  # one row per column of the table
    return long.withColumn("rank", F.row_number().over(order).cast("long"))


def select_columns(
    df: DataFrame, columns: list[str], limit: int, settings: Settings = DEFAULTS
) -> list[str]:
    """All columns when few, else the `limit` most spread ones, widest first."""
    if len(columns) <= limit:
        return columns
    top = rank_by_spread(df, columns).filter(F.col("rank") <= limit).orderBy("rank").collect()
    return [r["column"] for r in top]


def pair_correlations(
    df: DataFrame, pairs: list[tuple[str, str]], settings: Settings = DEFAULTS
) -> DataFrame:
    """(feature_a, feature_b, n, std_a, std_b, r) over rows where both are present; r is null if undefined.

    Centred cross-product sums, map-side only: one row per partition is shuffled. Sums of a
    single column are shared by all pairs of columns without gaps.
    """
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    ranges = column_ranges(df, columns, settings)
    complete = {c: r["n"] == r["total"] for c, r in ranges.items()}
    # Squared deviation per row below which a column counts as constant: rounding of its largest value.
    floor = {
        c: math.inf if r["min"] == r["max"] else (1e-13 * max(abs(r["min"]), abs(r["max"]))) ** 2 for c, r in ranges.items()
    }
    at = {c: i for i, c in enumerate(columns)}
    wide = df.select(*[(cells.number(df, c) - F.lit(ranges[c]["mean"] or 0.0)).alias(f"x_{i}") for c, i in at.items()])
    parts = []
    for k in range(0, len(pairs), settings.pairs_per_aggregate):
        sums, rows = {"rows": "count(1)"}, []
        for i, (a, b) in enumerate(pairs[k:k + settings.pairs_per_aggregate]):
            x, y = f"x_{at[a]}", f"x_{at[b]}"
            whole = complete[a] and complete[b]
            sides = {}
            for side, c, v, other in (("a", a, x, y), ("b", b, y, x)):
                key = f"c{at[c]}" if whole else f"p{i}{side}"
                only = "" if whole else f" FILTER (WHERE {other} IS NOT NULL)"
                sums |= {f"{key}_s": f"sum({v}){only}", f"{key}_q": f"sum({v} * {v}){only}"}
                sides |= {f"s_{side}": f"{key}_s", f"q_{side}": f"{key}_q", f"floor_{side}": cells.sql_double(floor[c])}
            sums[f"xy_{i}"] = f"sum({x} * {y})"
            if not whole:
                sums[f"n_{i}"] = f"count({x}) FILTER (WHERE {y} IS NOT NULL)"
            rows.append({
                "feature_a": cells.sql_text(a), "feature_b": cells.sql_text(b),
                "n": "rows" if whole else f"n_{i}", **sides, "xy": f"xy_{i}",
            })
        parts.append(cells.inline_rows(cells.aggregate(wide, sums), rows))
    n = F.col("n").cast("double")

    def spread(side):
        """Sum of squared deviations, 0 where only rounding is left of it."""
        left = F.col(f"q_{side}") - F.try_divide(F.col(f"s_{side}") * F.col(f"s_{side}"), n)
        return F.when(left > n * F.col(f"floor_{side}"), left).otherwise(0.0)

    out = _union(parts).withColumns({"d_a": spread("a"), "d_b": spread("b")})
    cross = F.col("xy") - F.try_divide(F.col("s_a") * F.col("s_b"), n)
    out = out.withColumn("r", F.try_divide(cross, F.sqrt("d_a") * F.sqrt("d_b")))
    return out.select(
        "feature_a", "feature_b", "n",
        F.sqrt(F.try_divide(F.col("d_a"), n - 1)).alias("std_a"), F.sqrt(F.try_divide(F.col("d_b"), n - 1)).alias("std_b"),
        F.when(F.col("r").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r")))).alias("r"),
    )


CELL_SCHEMA = "position_a long, position_b long, feature_a string, feature_b string, r double, correlation double"


def correlation_matrix(
    df: DataFrame, columns: list[str] | None = None, settings: Settings = DEFAULTS, limit: int | None = None
) -> DataFrame:
    """All cells of the matrix; an undefined correlation is 0.0, also on the diagonal.

    Every numeric column takes part, or every given one. A `limit` keeps the most spread of the columns found here;
    `rank_by_spread` tells which those are.
    """
    found = _numeric(df, columns, settings)
    columns = found if limit is None or columns is not None else select_columns(df, found, limit, settings)
    if len(columns) < 2:
        return _empty(df, CELL_SCHEMA)
    at = {c: i for i, c in enumerate(columns)}
    half = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    upper = pair_correlations(df, half, settings)
    place = F.create_map(*[x for c, i in at.items() for x in (F.lit(c), F.lit(i).cast("long"))])
    cell = F.coalesce(F.col("r"), F.lit(0.0))
    both = F.array(
        F.struct(F.col("feature_a").alias("feature_a"), F.col("feature_b").alias("feature_b"), cell.alias("r")),
        F.when(
            F.col("feature_a") != F.col("feature_b"),
            F.struct(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), cell.alias("r")),
        ),
    )
    cells_long = upper.select(F.inline(F.array_compact(both)))
    return cells_long.select(
        place[F.col("feature_a")].alias("position_a"),
        place[F.col("feature_b")].alias("position_b"),
        "feature_a", "feature_b", "r",
        F.round("r", 4).alias("correlation"),
    )


def strong_pairs(
    matrix: DataFrame, threshold: float | None = None, top: int | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Unique pairs with |r| at the threshold or above, strongest first."""
    threshold = settings.strong_correlation if threshold is None else threshold
    top = settings.top_correlation_pairs if top is None else top
    r = F.col("r")
    return (
        matrix.filter((F.col("position_a") < F.col("position_b")) & (F.abs(r) >= threshold))
        .select(
            "position_a", "position_b", "feature_a", "feature_b", "correlation",
            F.abs("correlation").alias("abs_correlation"),
            F.when(F.abs(r) >= 0.7, "strong").otherwise("moderate").alias("relationship_strength"),
            F.when(r > 0, "positive").otherwise("negative").alias("direction"),
        )
        .orderBy(F.desc("abs_correlation"), "position_a", "position_b")
        .limit(top)
    )


def target_associations(
    df: DataFrame, target: str, columns: list[str] | None = None, top: int = 5, settings: Settings = DEFAULTS
) -> DataFrame:
    """Numeric columns most correlated with a numeric target.

    Only pairs with more than two complete rows and both spreads above 1e-9 count.
    """
    catalog.require_columns(df, target)
    others = [c for c in _numeric(df, columns, settings) if c != target]
    if not others:
        return _empty(df, "feature string, correlation double, abs_correlation double")
    found = pair_correlations(df, [(c, target) for c in others], settings)
    known = found.filter(
        (F.col("n") > 2) & (F.col("std_a") > 1e-9) & (F.col("std_b") > 1e-9) & F.col("r").isNotNull()
    )
    return (
        known.select(
            F.col("feature_a").alias("feature"),
            F.round("r", 4).alias("correlation"),
            F.round(F.abs("r"), 4).alias("abs_correlation"),
        )
        .orderBy(F.desc("abs_correlation"), "feature")
        .limit(top)
    )

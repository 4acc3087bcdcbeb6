"""Feature audit against a target: identical columns, identifiers, missingness, text, cardinality."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions import cells
from colonnade.operators import catalog
from colonnade.settings import DEFAULTS, Settings


class TargetLeakageError(ValueError):
    pass


def verify_no_target(features: list[str], target: str) -> None:
    if target in features:
        raise TargetLeakageError(f"target {target!r} is among the features")


def target_copies(df: DataFrame, target: str) -> DataFrame:
    """(column, is_copy): whether a column of the target's type equals it in every row. One map-side aggregate."""
    catalog.require_columns(df, target)
    dtype = cells.type_of(df, target)
    others = [c for c in catalog.profiled_columns(df) if c != target]
    tests = [
        F.coalesce(F.bool_and(cells.same_cell(df, c, target)), F.lit(False)) if cells.type_of(df, c) == dtype
        else F.lit(False)
        for c in others
    ]
    one = df.agg(F.count(F.lit(1)).alias("n"), *[t.alias(f"t_{i}") for i, t in enumerate(tests)])
    return cells.inline_rows(one, [
        {"column": cells.sql_text(c), "is_copy": f"t_{i}"} for i, c in enumerate(others)
    ])


def _fingerprint(df: DataFrame, name: str) -> Column:
    """Order-free digest of a column: cells hashed with the rest of their row, combined by xor."""
    value = cells.without_nan(cells.quoted(name), cells.type_of(df, name))
    anchor = [cells.quoted(c) for c in catalog.profiled_columns(df)]
    return F.bit_xor(F.xxhash64(F.xxhash64(*anchor), value))


def identical_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, first_column): later columns that equal an earlier one in every row.

    One scan takes a fingerprint per column; only columns of equal type and fingerprint are
    compared cell by cell, in a second scan. The number of comparisons stays near the number
    of true copies instead of growing with the square of the columns.
    """
    columns = catalog.profiled_columns(df) if columns is None else columns
    schema = "`column` string, first_column string"
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], schema)
    marks = df.agg(*[_fingerprint(df, c).alias(f"f_{i}") for i, c in enumerate(columns)]).first()
    alike: dict[tuple, list[str]] = defaultdict(list)
    for i, c in enumerate(columns):
        alike[(cells.type_of(df, c).simpleString(), marks[f"f_{i}"])].append(c)
    pairs = [(group[0], later) for group in alike.values() for later in group[1:]]
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    one = df.agg(*[F.bool_and(cells.same_cell(df, a, b)).alias(f"e_{i}") for i, (a, b) in enumerate(pairs)])
    return cells.inline_rows(one, [
        {"column": cells.sql_text(b), "first_column": cells.sql_text(a), "equal": f"e_{i}"}
        for i, (a, b) in enumerate(pairs)
    ]).filter("equal").select("column", "first_column")


def audit_flags(summary: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Column summary with its array of flags that need no look at other columns."""
    unique, kind = F.col("unique_count"), F.col("inferred_dtype")
    share = unique / F.greatest(F.col("row_count"), F.lit(1))
    flags = {
        "constant_column": unique <= settings.constant_max_distinct,
        "potential_id": (unique > settings.high_cardinality_min) & (share >= settings.id_ratio),
        "excessive_missingness": F.col("missing_percentage") >= settings.excessive_missing_ratio * 100,
        "free_form_text": kind == "text",
        "high_cardinality_categorical": (kind == "categorical") & (unique > settings.max_one_hot_levels),
    }
    marks = F.array(*[F.when(test, F.lit(name)) for name, test in flags.items()])
    return summary.withColumn("flags", F.array_compact(marks))


def feature_audit(df: DataFrame, target: str, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per candidate feature: facts, flags, status, recommended action and reason."""
    catalog.require_columns(df, target)
    features = [c for c in catalog.profiled_columns(df) if c != target]
    flagged = audit_flags(catalog.column_summary(df, settings), settings).filter(F.col("column") != target)
    copies = target_copies(df, target).filter("is_copy").select("column", F.lit("target").alias("copy_of"))
    repeats = identical_columns(df, features).select("column", F.col("first_column").alias("repeat_of"))
    joined = flagged.join(F.broadcast(copies), "column", "left").join(F.broadcast(repeats), "column", "left")
    duplicate = F.col("copy_of").isNotNull() | F.col("repeat_of").isNotNull()
    # A copy of the target never counts as the first of a pair of copies.
    flags = F.when(duplicate, F.array_union(F.col("flags"), F.array(F.lit("duplicate_feature")))).otherwise(F.col("flags"))
    unique, missing = F.col("unique_percentage").cast("string"), F.col("missing_percentage").cast("string")

    def has(name):
        return F.array_contains("flags", name)

    reason = F.concat_ws(
        " | ",
        F.when(has("constant_column"), F.format_string("constant: %d distinct value", "unique_count")),
        F.when(F.col("copy_of").isNotNull(), F.lit(f"identical to the target {target} (severe leakage)")),
        F.when(F.col("copy_of").isNull() & F.col("repeat_of").isNotNull(),
               F.concat(F.lit("identical to feature "), F.col("repeat_of"))),
        F.when(has("potential_id"), F.concat(unique, F.lit("% of values are distinct: likely an identifier"))),
        F.when(has("excessive_missingness"), F.concat(missing, F.lit("% of values are missing"))),
        F.when(has("free_form_text"), F.lit("free-form text")),
        F.when(has("high_cardinality_categorical"), F.format_string("%d distinct categories", "unique_count")),
    )
    status = (
        F.when(has("constant_column") | has("duplicate_feature"), "flagged_exclude")
        .when(F.size("flags") > 0, "review_recommended")
        .otherwise("included")
    )
    return joined.withColumn("flags", flags).select(
        "position", "column", "raw_dtype", "inferred_dtype", "missing_count", "missing_percentage",
        "unique_count", "unique_percentage", "flags",
        status.alias("status"),
        F.when(F.size("flags") > 0, "exclude").otherwise("include").alias("recommended_action"),
        F.when(F.size("flags") > 0, reason).alias("reason"),
    )


def audit_totals(audit: DataFrame) -> DataFrame:
    """Counts by recommendation; review is counted by status."""
    return audit.agg(
        F.count("*").alias("total_candidates"),
        F.count_if(F.col("recommended_action") == "include").alias("included_count"),
        F.count_if(F.col("recommended_action") == "exclude").alias("excluded_count"),
        F.count_if(F.col("status") == "review_recommended").alias("review_count"),
    )


def active_features(
    audit: DataFrame, target: str, selected: list[str] | None = None, excluded: list[str] | None = None
) -> DataFrame:
    """Features that go on: the given list, everything but the given list, or all that are not flagged out."""
    chosen = audit.filter(F.col("column") != target)
    if selected is not None:
        chosen = chosen.filter(F.col("column").isin(selected))
    elif excluded is not None:
        chosen = chosen.filter(~F.col("column").isin(excluded))
    else:
        chosen = chosen.filter(F.col("status") != "flagged_exclude")
    return chosen.select("position", "column", "inferred_dtype")

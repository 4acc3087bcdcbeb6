"""Running totals over a global order without a one-partition window on large tables."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.functions import cells
from colonnade.settings import DEFAULTS, Settings


def order_buckets(df: DataFrame, position: str, rows: int, settings: Settings) -> DataFrame:
    """Add `bucket`: ranges of `position` of about equal row count, in ascending order.

    The cut points are a bounded array from the built-in quantile sketch; any cut points
    give the same totals, so the sketch's error does not reach the result.
    """
    parts = min(math.ceil(rows / settings.range_rows), settings.order_buckets)
    if parts <= 1:
        return df.withColumn("bucket", F.lit(0.0))
    probs = [i / parts for i in range(1, parts)]
    cuts = df.agg(
        F.percentile_approx(position, F.array(*map(F.lit, probs)), F.lit(min(100 * parts, 100_000))).alias("q")
    ).first()["q"]
    splits = [-math.inf] + sorted(set(cuts or [])) + [math.inf]
    return Bucketizer(splits=splits, inputCol=position, outputCol="bucket").transform(df)


def running_totals(
    df: DataFrame,
    keys: list[str],
    position: str,
    sums: list[str],
    rows: int,
    settings: Settings = DEFAULTS,
    descending: bool = False,
    ties: list[Column] | None = None,
) -> DataFrame:
    """Add `<sum>_before`, the total of all rows of the same keys that come earlier.

    `df` holds one row per (keys, position, ties); `position` is a double and `rows` an
    upper bound of the row count. Totals per bucket are summed first (a small table), then each
    bucket is summed on its own, at every size.
    """
    order = [F.col(position).desc() if descending else F.col(position).asc()] + (ties or [])
    bucketed = order_buckets(df, position, rows, settings)
    totals = bucketed.groupBy(*keys, "bucket").agg(*[F.sum(s).alias(s) for s in sums])
    bucket_order = F.col("bucket").desc() if descending else F.col("bucket").asc()
    earlier = Window.partitionBy(*keys).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "bucket", *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}_offset") for s in sums]
    )
    inner = Window.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = bucketed.withColumns({f"{s}_inner": F.coalesce(F.sum(s).over(inner), F.lit(0)) for s in sums})
    joined = cells.join_by(summed, offsets, [*keys, "bucket"])
    out = joined.withColumns({f"{s}_before": F.col(f"{s}_offset") + F.col(f"{s}_inner") for s in sums})
    return out.drop("bucket", *[f"{s}_{x}" for s in sums for x in ("offset", "inner")])

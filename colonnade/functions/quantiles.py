"""Exact quantiles with linear interpolation.

Spark's `percentile` keeps every distinct value of a group in one task. That is used
only for tables whose row count is checked to be small. Larger tables take repeated
histogram passes: each pass counts rows per bin of the bracket that holds the wanted
rank and keeps only that bin, so no task ever holds more than the bins.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.functions import cells
from colonnade.settings import DEFAULTS, Settings

LONG_SCHEMA = "bracket long, grp string, lo double, hi double, width double, scale double"


def _positions(n: int, p: float) -> tuple[int, int, float]:
    at = p * (n - 1)
    low = min(int(math.floor(at)), n - 1)
    return low, min(low + 1, n - 1), at - low


def _brackets(spark, open_targets: list[dict]) -> tuple[DataFrame, DataFrame]:
    ids: dict[tuple, int] = {}
    for t in open_targets:
        t["bracket"] = ids.setdefault((t["grp"], t["lo"], t["hi"]), len(ids))
    rows = []
    for (grp, lo, hi), i in ids.items():
        scale = 1.0 if math.isfinite(hi - lo) else 0.5
        rows.append((i, grp, lo, hi, hi * scale - lo * scale, scale))
    brackets = spark.createDataFrame(rows, LONG_SCHEMA)
    wanted = spark.createDataFrame(
        [(t["bracket"], t["id"], t["k"]) for t in open_targets], "bracket long, id long, k long"
    )
    return F.broadcast(brackets), F.broadcast(wanted)


def order_statistics(
    long: DataFrame, probs: Iterable[float], settings: Settings = DEFAULTS,
    heads: dict[str, tuple[int, float, float]] | None = None,
) -> dict[str, list[float | None]]:
    """Quantiles per group of a `(grp string, v double)` table, by bracket narrowing.

    The number of groups is bounded by the caller (columns, models or top categories);
    the driver sees one row per group and two ranks per quantile. `heads` gives count and
    range per group where the caller knows them.
    """
    spark = long.sparkSession
    probs = list(probs)
    long = long.filter(F.col("v").isNotNull())
    if heads is None:
        found = long.groupBy("grp").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        heads = {r["grp"]: (r["n"], r["lo"], r["hi"]) for r in found.collect()}
    heads = {grp: head for grp, head in heads.items() if head[0]}

    targets: list[dict] = []
    shares: dict[tuple[str, int], tuple[int, int, float]] = {}
    for grp, (n, lo, hi) in heads.items():
        for i, p in enumerate(probs):
            low, high, frac = _positions(n, p)
            for k in (low, high):
                targets.append({"id": len(targets), "grp": grp, "k": k, "lo": lo, "hi": hi, "n": n})
            shares[(grp, i)] = (len(targets) - 2, len(targets) - 1, frac)

    while True:
        open_targets = [t for t in targets if t["lo"] < t["hi"]]
        if not open_targets:
            break
        brackets, wanted = _brackets(spark, open_targets)
        inside = cells.join_by(long, brackets, ["grp"]).filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        held = {t["bracket"]: t["n"] for t in open_targets}
        if sum(held.values()) <= settings.one_task_rows:
            bins = F.col("v")
        else:
            share = (F.col("v") * F.col("scale") - F.col("lo") * F.col("scale")) / F.col("width")
            bins = F.least(F.floor(share * settings.quantile_bins), F.lit(settings.quantile_bins - 1)).cast("double")
        counted = inside.groupBy("bracket", bins.alias("bin")).agg(
            F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
        )
        upto = Window.partitionBy("bracket").orderBy("bin")
        counted = counted.withColumn("upto", F.sum("n").over(upto)).withColumn("before", F.col("upto") - F.col("n"))
        found = (
            counted.join(wanted, "bracket")
            .filter((F.col("k") >= F.col("before")) & (F.col("k") < F.col("upto")))
            .select("id", "before", "n", "lo", "hi")
            .collect()
        )
        if len(found) < len(open_targets):
            raise RuntimeError(f"{len(open_targets) - len(found)} of {len(open_targets)} ranks lie in no bracket")
        for r in found:
            t = targets[r["id"]]
            t.update(k=t["k"] - r["before"], n=r["n"], lo=r["lo"], hi=r["hi"])

    out: dict[str, list[float | None]] = {}
    for grp in heads:
        values = []
        for i in range(len(probs)):
            a, b, frac = shares[(grp, i)]
            va, vb = targets[a]["lo"], targets[b]["lo"]
            values.append(va + (vb - va) * frac)
        out[grp] = values
    return out


def is_small(df: DataFrame, settings: Settings, rows: int | None = None) -> bool:
    """Whether the table is proven small enough for a one-task aggregate."""
    return (df.count() if rows is None else rows) <= settings.exact_percentile_rows


def column_quantiles(
    df: DataFrame, names: list[str], probs: list[float], settings: Settings = DEFAULTS, rows: int | None = None,
    heads: dict[str, tuple[int, float, float]] | None = None,
) -> dict[str, list[float | None]]:
    """Quantiles of the named double columns, on the driver."""
    empty: list[float | None] = [None] * len(probs)
    if is_small(df, settings, rows):
        wanted = ", ".join(f"{p}D" for p in probs)
        row = df.agg(*[F.expr(f"percentile({n}, array({wanted}))").alias(n) for n in names]).first()
        return {n: row[n] or empty for n in names}
    pairs = F.expr("inline(array(" + ", ".join(f"named_struct('grp', '{n}', 'v', {n})" for n in names) + "))")
    solved = order_statistics(df.select(pairs), probs, settings, heads)
    return {n: solved.get(n, empty) for n in names}


def grouped_quantiles(
    df: DataFrame,
    group: str,
    value: Column,
    probs: list[float],
    settings: Settings = DEFAULTS,
    rows: int | None = None,
) -> DataFrame:
    """`(group, q array<double>)` for a grouping column with a bounded number of values."""
    if is_small(df, settings, rows):
        return df.groupBy(group).agg(F.percentile(value, F.array(*map(F.lit, probs))).alias("q"))
    long = df.select(F.col(group).cast("string").alias("grp"), value.cast("double").alias("v"))
    solved = order_statistics(long, probs, settings)
    rows_ = [(g, [float(v) for v in q]) for g, q in solved.items()]
    named = df.sparkSession.createDataFrame(rows_, "__group string, q array<double>")
    return named.select(F.col("__group").cast(df.schema[group].dataType).alias(group), "q")

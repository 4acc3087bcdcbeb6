"""Regression metrics over a predictions table with `y_true` and `y_pred`, grouped by `by`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.functions import cells
from colonnade.functions.quantiles import is_small, order_statistics
from colonnade.settings import DEFAULTS, Settings

# Group separators used to carry composite group keys through the quantile passes.


def numeric_pairs(predictions: DataFrame) -> DataFrame:
    """y, p and residual as doubles; cells that are no number count as 0."""
    y = F.coalesce(cells.number(predictions, "y_true"), F.lit(0.0))
    p = F.coalesce(cells.number(predictions, "y_pred"), F.lit(0.0))
    return predictions.withColumns({"y": y, "p": p}).withColumn("residual", F.col("y") - F.col("p"))


def quantiles_by(
    df: DataFrame, by: list[str], value: Column, probs: list[float], settings: Settings, rows: int | None
) -> DataFrame:
    """`(by, q)`; groups are models and folds, so there are few of them."""
    if is_small(df, settings, rows):
        return df.groupBy(*by).agg(F.percentile(value, F.array(*map(F.lit, probs))).alias("q"))
    key = cells.row_text([F.col(b) for b in by])
    solved = order_statistics(df.select(key.alias("grp"), value.alias("v")), probs, settings)
    table = df.sparkSession.createDataFrame([(k, [float(x) for x in q]) for k, q in solved.items()], "k string, q array<double>")
    heads = df.groupBy(*by).agg(F.lit(1).alias("one")) if by else table.limit(1).select(F.lit(1).alias("one"))
    return heads.withColumn("k", key).join(F.broadcast(table), "k").select(*by, "q")


def _with_group(df: DataFrame, by: list[str], heads: DataFrame) -> DataFrame:
    """Attach one-row-per-group figures to every row."""
    if by:
        return cells.join_by(df, heads, by)
    one = heads.first()
    return df.withColumns({
        f.name: F.lit(one[f.name]).cast(f.dataType) for f in heads.schema.fields
    })


def _determination(unexplained: Column, spread: Column) -> Column:
    """1 - unexplained / spread; a constant target scores 1 when hit exactly, else 0."""
    flat = F.when(unexplained == 0, 1.0).otherwise(0.0)
    return F.when(spread == 0, flat).otherwise(1.0 - F.try_divide(unexplained, spread))


def regression_metrics(
    predictions: DataFrame, by: list[str], settings: Settings = DEFAULTS, rows: int | None = None,
    zero_tolerance: float = 1e-5,
) -> DataFrame:
    """MAE, RMSE, R2, median absolute error, explained variance, MAPE, tolerance shares, clamped R2 percent.

    MAPE is null when any true value is (near) zero. Tolerance shares are relative on the
    non-zero targets; when there is none they are relative to the target's deviation.
    """
    df = numeric_pairs(predictions)
    y, e = F.col("y"), F.col("residual")
    near_zero = F.abs(y) <= zero_tolerance
    rel = F.when(~(F.abs(y) <= 1e-5), F.abs(e / F.when(y == 0, None).otherwise(y)))
    sums = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        F.var_pop(y).alias("var_y"), F.var_pop(e).alias("var_e"),
        F.count_if(near_zero).alias("zeros"),
        F.avg(F.when(~near_zero, F.abs(e) / F.abs(F.when(y == 0, None).otherwise(y)))).alias("mape"),
        F.count(rel).alias("rated"),
        *[F.avg(F.when(rel.isNotNull(), F.when(rel <= t, 100.0).otherwise(0.0))).alias(f"rel_{int(t * 100)}") for t in (0.1, 0.2)],
    )
    # One row per group, read now: it tells the row count and whether the fallback shares are needed at all.
    known = sums.collect()
    sums = df.sparkSession.createDataFrame(known, sums.schema)
    rows = sum(r["n"] for r in known) if rows is None else rows
    medians = quantiles_by(df, by, F.abs(e), [0.5], settings, rows).select(*by, F.col("q")[0].alias("median"))
    joined = cells.join_by(sums, medians, by) if by else sums.withColumn("median", F.lit(medians.first()["median"]))
    if all(r["rated"] for r in known):
        joined = joined.withColumns({c: F.lit(None).cast("double") for c in ("flat_10", "flat_20")})
    else:
        flat = _flat_shares(df, by, sums)
        joined = cells.join_by(joined, flat, by, "left") if by else joined.withColumns(
            {c: F.lit(v).cast("double") for c, v in flat.first().asDict().items()})
    r2 = F.round(_determination(F.col("mse"), F.col("var_y")), 4)
    share = lambda k: F.round(F.when(F.col("rated") > 0, F.col(f"rel_{k}")).otherwise(F.col(f"flat_{k}")), 1)
    return joined.select(
        *by, "n", F.round("mae", 4).alias("mae"), F.round(F.sqrt("mse"), 4).alias("rmse"), r2.alias("r2"),
        F.round("median", 4).alias("median_absolute_error"),
        F.round(_determination(F.col("var_e"), F.col("var_y")), 4).alias("explained_variance"),
        F.round(F.when(F.col("zeros") == 0, F.col("mape")), 4).alias("mape"),
        share(10).alias("accuracy_within_10_pct"), share(20).alias("accuracy_within_20_pct"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), r2)) * 100.0, 1).alias("r2_pct"),
    )


def _flat_shares(df: DataFrame, by: list[str], sums: DataFrame) -> DataFrame:
    """Share of errors within 10% and 20% of the target's deviation."""
    spread = F.sqrt("var_y")
    unit = sums.select(*by, F.when(spread > 1e-5, spread).otherwise(1.0).alias("unit"))
    e = F.abs("residual")
    return _with_group(df, by, unit).groupBy(*by).agg(*[
        F.avg(F.when(e <= F.col("unit") * t, 100.0).otherwise(0.0)).alias(f"flat_{int(t * 100)}") for t in (0.1, 0.2)
    ])


def residual_statistics(
    predictions: DataFrame, by: list[str], settings: Settings = DEFAULTS, rows: int | None = None
) -> DataFrame:
    """Mean, median, population deviation, range, deciles and quartiles of the residuals."""
    df = numeric_pairs(predictions)
    e = F.col("residual")
    sums = df.groupBy(*by).agg(
        F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.min(e).alias("min"), F.max(e).alias("max")
    )
    q = quantiles_by(df, by, e, [0.1, 0.25, 0.5, 0.75, 0.9], settings, rows)
    joined = _with_group(sums, by, q)
    at = lambda i: F.round(F.col("q")[i], 4)
    return joined.select(
        *by, *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")], at(2).alias("median"),
        at(0).alias("p10"), at(1).alias("p25"), at(3).alias("p75"), at(4).alias("p90"),
        F.round(at(3) - at(1), 4).alias("iqr"),
    )


def residual_histogram(predictions: DataFrame, by: list[str], bins: int = 20) -> DataFrame:
    """Equal bins from the smallest to the largest residual, last one closed, empty bins included."""
    df = numeric_pairs(predictions)
    e = F.col("residual")
    heads = df.groupBy(*by).agg(F.min(e).alias("lo"), F.max(e).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    heads = heads.select(
        *by, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    b = F.least(F.width_bucket(e, F.col("lo"), F.col("hi"), F.lit(bins)), F.lit(bins))
    counted = _with_group(df.select(*by, "residual"), by, heads).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))
    every = heads.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(bins).cast("long"))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    start = F.col("lo") + (F.col("bin") - 1) * width
    return every.join(F.broadcast(counted), [*by, "bin"], "left").select(
        *by, "bin", F.round(start, 4).alias("bin_start"), F.round(start + width, 4).alias("bin_end"),
        F.round(start + width / 2, 4).alias("bin_center"), F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def actual_vs_predicted(
    predictions: DataFrame, keys: list[str], max_points: int = 500, extremes: int = 15, settings: Settings = DEFAULTS
) -> DataFrame:
    """Sample of points that always holds the most negative and most positive residuals.

    Three top-k selections, each bounded per task; the rest is chosen by the hash of the key.
    """
    df = numeric_pairs(predictions).select(*keys, "y", "p", "residual")
    low = df.orderBy(F.asc("residual"), *keys).limit(extremes)
    high = df.orderBy(F.desc("residual"), *keys).limit(extremes)
    edge = low.union(high).dropDuplicates(keys)
    held = F.broadcast(edge.select(*keys))  # at most 2 * extremes rows
    h = cells.hash_order(keys, settings.seed)
    rest = df.join(held, keys, "left_anti").withColumn("h", h).orderBy("h", *keys).limit(max_points).withColumn("first", F.lit(1))
    both = edge.withColumn("h", h).withColumn("first", F.lit(0)).unionByName(rest)
    return both.orderBy("first", "h", *keys).limit(max_points).select(
        *keys, F.round("y", 4).alias("actual"), F.round("p", 4).alias("predicted"),
        F.round("residual", 4).alias("residual"), F.round(F.abs("residual"), 4).alias("abs_error"),
    )


def reference_line(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Ends of the diagonal: smallest and largest value on either axis."""
    df = numeric_pairs(predictions)
    return df.groupBy(*by).agg(
        F.round(F.min(F.least("y", "p")), 4).alias("min"), F.round(F.max(F.greatest("y", "p")), 4).alias("max")
    )


def residual_diagnostics(
    predictions: DataFrame, by: list[str], settings: Settings = DEFAULTS, rows: int | None = None
) -> DataFrame:
    """One row per finding: bias, unequal spread, large residuals, or `normal` when there is none."""
    df = numeric_pairs(predictions)
    e = F.col("residual")
    heads = df.groupBy(*by).agg(
        F.round(F.avg(e), 4).alias("mean_e"), F.round(F.stddev_pop(e), 4).alias("std_e"), F.stddev_pop("y").alias("std_y")
    )
    middle = quantiles_by(df, by, F.col("p"), [0.5], settings, rows).select(*by, F.col("q")[0].alias("mid"))
    heads = _with_group(heads, by, middle)
    rows_ = _with_group(df.select(*by, "p", "residual"), by, heads)
    below = F.col("p") <= F.col("mid")
    facts = rows_.groupBy(*by, "mean_e", "std_e", "std_y").agg(
        F.var_pop(F.when(below, e)).alias("v_low"), F.var_pop(F.when(~below, e)).alias("v_high"),
        F.count_if(below).alias("n_low"), F.count_if(~below).alias("n_high"),
        F.count_if((F.col("std_e") > 1e-6) & (F.abs(e - F.col("mean_e")) > 3 * F.col("std_e"))).alias("large"),
    )
    unit = F.when(F.col("std_y") > 1e-6, F.col("std_y")).otherwise(1.0)
    spread = F.when(F.col("v_low") > 1e-6, F.try_divide(F.col("v_high"), F.col("v_low"))).otherwise(1.0)
    uneven = (F.col("n_low") > 5) & (F.col("n_high") > 5) & ((spread > 3.0) | (spread < 0.33))

    def finding(test, kind, severity, detail):
        return F.when(test, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
                                     detail.cast("double").alias("value")))

    found = F.array_compact(F.array(
        finding(F.abs("mean_e") > 0.10 * unit, "residual_bias", "moderate", F.col("mean_e")),
        finding(uneven, "heteroscedasticity", "mild", F.round(spread, 4)),
        finding(F.col("large") > 0, "outliers", "info", F.col("large")),
    ))
    normal = F.array(F.struct(F.lit("normal").alias("type"), F.lit("info").alias("severity"),
                              F.lit(None).cast("double").alias("value")))
    return facts.select(*by, F.inline(F.when(F.size(found) > 0, found).otherwise(normal)))

"""Feature importance and attribution: native, permutation, linear and sampled Shapley values."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.functions import cells
from colonnade.functions.storage import stored
from colonnade.settings import DEFAULTS, Settings

Lineage = list[tuple[str, str]]


def native_importance(spark, model, lineage: Lineage) -> DataFrame | None:
    """Tree importances or mean absolute coefficients, scaled to sum 1; None when the model has neither."""
    if hasattr(model, "models"):  # one-vs-rest: mean over the classes' models
        parts = [native_importance(spark, m, lineage) for m in model.models]
        if any(p is None for p in parts):
            return None
        stacked = parts[0]
        for p in parts[1:]:
            stacked = stacked.unionByName(p)
        return stacked.groupBy("feature", "original_feature").agg(
            F.round(F.avg("importance"), 4).alias("importance"), F.round(F.avg("raw_value"), 4).alias("raw_value")
        )
    if hasattr(model, "featureImportances"):
        raw = [float(v) for v in model.featureImportances.toArray()]
    elif hasattr(model, "numClasses") and hasattr(model, "coefficientMatrix"):
        raw = [float(v) for v in abs(model.coefficientMatrix.toArray()).mean(axis=0)]
    elif hasattr(model, "coefficients"):
        raw = [abs(float(v)) for v in model.coefficients.toArray()]
    else:
        return None
    total = sum(raw)
    shares = [v / total for v in raw] if total > 1e-7 else raw
    rows = [(f, o, round(s, 4), round(v, 4)) for (f, o), s, v in zip(lineage, shares, raw)]
    return spark.createDataFrame(rows, "feature string, original_feature string, importance double, raw_value double")


def by_original_feature(importances: DataFrame, value: str = "importance") -> DataFrame:
    """Importance summed over the features made from one column."""
    return importances.groupBy("original_feature").agg(
        F.round(F.sum(value), 4).alias(value), F.count("*").alias("features")
    )


def with_donor(df: DataFrame, keys: list[str], vector: str, salt, rows: int, settings: Settings = DEFAULTS) -> DataFrame:
    """Pair every row with another row's vector: one random permutation of all rows.

    In the order of the key's salted hash every row takes the vector of the next one, the last row that of the first, so
    the rows form one cycle. The order is cut by the hash, which is uniform, into ranges of about `range_rows` rows; one
    exchange sorts them. Only each range's last row looks into another range, for its first vector: one row per range.
    """
    ranges = max(1, math.ceil(rows / settings.range_rows))
    h = cells.hash_order(keys, salt)
    part = F.conv(F.substring("h", 1, 13), 16, 10).cast("bigint") / F.lit(float(16 ** 13))  # in [0, 1), ascending with h
    dealt = df.withColumn("h", h).withColumn("deal", F.floor(part * ranges))
    order = Window.partitionBy("deal").orderBy("h", *keys)
    first = F.first(F.struct(vector)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    led = dealt.select("*", F.lead(F.struct(vector)).over(order).alias("next"), first.alias("head"))
    inner = led.filter("next IS NOT NULL")
    across = Window.orderBy("deal")
    ends = led.filter("next IS NULL").withColumn("next", F.coalesce(
        F.lead("head").over(across), F.first("head").over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    return inner.unionByName(ends).withColumn("donor", F.col("next")[vector]).drop("h", "deal", "next", "head")


def permutation_importance(
    df: DataFrame,
    keys: list[str],
    score: Callable[[DataFrame], DataFrame],
    lineage: Lineage,
    classification: bool,
    repeats: int | None = None,
    settings: Settings = DEFAULTS,
    by_column: bool = False,
) -> DataFrame:
    """Mean and deviation of the score lost when one feature is shuffled, per feature.

    `df` has the keys, `label` and `features`; `score` adds `prediction` from `features`. Per repeat the rows are
    permuted once. A row is scored again only for the features in which it differs from its donor: elsewhere its
    prediction stays, so mostly empty features (one-hot levels) cost few rows. by_column: all features made from one
    column are shuffled together, and `feature` is that column.
    """
    repeats = settings.permutation_repeats if repeats is None else repeats
    if not 1 <= repeats <= 20:
        raise ValueError("repeats must lie between 1 and 20")
    if by_column:
        groups: dict[str, list[int]] = {}
        for i, (_, origin) in enumerate(lineage):
            groups.setdefault(origin, []).append(i)
        parts = [(origin, origin, at) for origin, at in groups.items()]
    else:
        parts = [(f, o, [i]) for i, (f, o) in enumerate(lineage)]
    gain = (F.col("label") == F.col("prediction")).cast("double") if classification else -F.pow(F.col("label") - F.col("prediction"), F.lit(2.0))
    base = score(df.select(*keys, "label", "features")).select(*keys, "label", vector_to_array("features").alias("x"), gain.alias("before"))
    total = base.agg(F.count("*").alias("n"), F.sum("before").alias("sum"), F.var_pop("label").alias("spread")).first()
    rows = total["n"]

    def quality(sums):
        """Accuracy, or r2, from the rows' sum of gains."""
        mean = sums / F.lit(float(rows) if rows else None)
        return mean if classification else 1.0 + F.try_divide(mean, F.lit(total["spread"]))

    differs = lambda at: F.exists(F.array(*map(F.lit, at)), lambda i: ~F.get("x", i).eqNullSafe(F.get("donor", i)))
    names = F.array_compact(F.array(*[F.when(differs(at), F.struct(F.lit(k).alias("part"), F.array(*map(F.lit, at)).alias("at"))) for k, (_, _, at) in enumerate(parts)]))
    shuffled = None
    for r in range(repeats):
        donors = with_donor(base, keys, "x", f"{settings.seed}-repeat-{r}", rows, settings)
        spread = donors.select("*", F.inline(names))
        hybrid = F.transform("x", lambda v, i: F.when(F.array_contains("at", i), F.get("donor", i)).otherwise(v))
        one = spread.select("label", "before", "part", F.lit(r).alias("repeat"), array_to_vector(hybrid).alias("features"))
        shuffled = one if shuffled is None else shuffled.unionByName(one)
    changes = score(shuffled).groupBy("part", "repeat").agg(F.sum(gain - F.col("before")).alias("change"))
    every = df.sparkSession.createDataFrame([(k, r, f, o) for k, (f, o, _) in enumerate(parts) for r in range(repeats)],
                                            "part int, repeat int, feature string, original_feature string")
    whole = F.lit(total["sum"])
    lost = every.join(changes, ["part", "repeat"], "left").withColumn(
        "drop", quality(whole) - quality(whole + F.coalesce("change", F.lit(0.0))))
    return lost.groupBy("feature", "original_feature").agg(
        F.round(F.avg("drop"), 4).alias("importance_mean"), F.round(F.stddev_pop("drop"), 4).alias("importance_std")
    )


def linear_attributions(df: DataFrame, keys: list[str], weights: dict[str, float], means: dict[str, float]) -> DataFrame:
    """Long table (keys, feature, feature_value, phi) with phi = weight * (value - mean)."""
    parts = F.array(*[
        F.struct(
            F.lit(c).alias("feature"), F.col(c).cast("double").alias("feature_value"),
            (F.lit(float(w)) * (F.col(c).cast("double") - F.lit(float(means[c])))).alias("phi"),
        )
        for c, w in weights.items()
    ])
    return df.select(*keys, F.inline(parts))


def sample_rows(df: DataFrame, keys: list[str], n: int, salt) -> DataFrame:
    """Reproducible sample of n rows, chosen by the hash of the key; no sort of the table."""
    return df.orderBy(cells.hash_order(keys, salt), *keys).limit(n)


def sampled_shapley(
    rows: DataFrame,
    background: list[list[float]],
    keys: list[str],
    score: Callable[[DataFrame], DataFrame],
    output: Column,
    lineage: Lineage,
    orders: int | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Shapley values of any model by sampling feature orders (Strumbelj and Kononenko 2014).

    Per row and order, features are switched from a background row to the row's own values
    one by one; the change of the model output at each step goes to the switched feature.
    `output` is the value to explain in the scored table. The background is a bounded sample
    that travels with the plan.
    """
    orders = settings.shap_orders if orders is None else orders
    width = len(lineage)
    base = rows.select(*keys, vector_to_array("features").alias("x"))
    reference = F.array(*[F.array(*map(F.lit, b)) for b in background])
    draws = base.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))))
    mix = lambda i: F.md5(F.concat_ws("|", *keys, F.col("draw"), i, F.lit(settings.seed)))
    shuffled = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.struct(mix(i), i.alias("i"))))
    pick = F.pmod(F.xxhash64(*keys, F.col("draw")), F.lit(len(background))).cast("int") + 1
    ready = draws.select(
        *keys, "x", "draw", F.transform(shuffled, lambda s: s["i"]).alias("turns"),
        F.element_at(reference, pick).alias("b"),
    )
    # each feature's turn, found once per order, so a step only compares numbers
    ready = ready.withColumn("place", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.array_position("turns", i)))
    steps = ready.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(width))))
    hybrid = F.transform("b", lambda v, i: F.when(F.element_at("place", i + 1) <= F.col("step"), F.element_at("x", i + 1)).otherwise(v))
    stacked = steps.withColumn("features", array_to_vector(hybrid))
    valued = score(stacked).withColumn("v", output)
    # The output after step k counts for the k-th feature in turn and against the next one.
    credit = F.array(
        F.when(F.col("step") > 0, F.struct(F.element_at("turns", F.greatest("step", F.lit(1))).alias("at"), F.col("v").alias("part"))),
        F.when(F.col("step") < width, F.struct(F.element_at("turns", F.least(F.col("step") + 1, F.lit(width))).alias("at"),
                                               (-F.col("v")).alias("part"))),
    )
    parts = valued.select(*keys, F.inline(F.array_compact(credit)))
    names = F.array(*[F.lit(f) for f, _ in lineage])
    origins = F.array(*[F.lit(o) for _, o in lineage])
    phi = parts.groupBy(*keys, "at").agg((F.sum("part") / orders).alias("phi"))
    with_value = phi.join(base, keys)
    return with_value.select(
        *keys, F.element_at(names, F.col("at") + 1).alias("feature"),
        F.element_at(origins, F.col("at") + 1).alias("original_feature"),
        F.element_at("x", F.col("at") + 1).alias("feature_value"), "phi",
    )


def global_attribution(phi: DataFrame, top: int | None = None) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    out = phi.groupBy("feature").agg(F.round(F.avg(F.abs("phi")), 4).alias("mean_abs_phi"), F.count("*").alias("n"))
    out = out.orderBy(F.desc("mean_abs_phi"), "feature")
    return out if top is None else out.limit(top)


def summary_points(phi: DataFrame, keys: list[str], top: int, points: int = 100, settings: Settings = DEFAULTS) -> DataFrame:
    """Up to `points` rows per top feature with value, attribution and min-max-scaled value.

    The rows are the same for every feature: the first ones in hash order of the row key.
    """
    phi = stored(phi, "attributions")  # read for the ranking, the choice of rows and the points
    best = [r["feature"] for r in global_attribution(phi, top).collect()]
    kept = phi.filter(F.col("feature").isin(best))
    # Every row has every feature, so a bounded top-n over one of them names the rows.
    chosen = sample_rows(kept.filter(F.col("feature") == F.lit(best[0] if best else None)), keys, points, settings.seed).select(*keys)
    few = cells.join_by(kept, F.broadcast(chosen), keys)
    every = Window.partitionBy("feature")
    low, high = F.min("feature_value").over(every), F.max("feature_value").over(every)
    span = F.when(high - low > 1e-6, high - low).otherwise(1.0)
    return few.select(
        *keys, "feature", F.round("phi", 4).alias("phi"), F.round("feature_value", 4).alias("feature_value"),
        F.round((F.col("feature_value") - low) / span, 3).alias("normalized_value"),
    )


def local_explanation(phi: DataFrame, keys: list[str], top: int = 15) -> DataFrame:
    """The strongest contributions per row with their sign."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs("phi")), "feature")
    return phi.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top).select(
        *keys, "rank", "feature", F.round("feature_value", 4).alias("feature_value"), F.round("phi", 4).alias("phi"),
        F.round(F.abs("phi"), 4).alias("abs_phi"), F.when(F.col("phi") >= 0, "positive").otherwise("negative").alias("direction"),
    )


def dependence(points: DataFrame, feature: str) -> DataFrame:
    """Summary points of one feature, by its own or its original column's name."""
    test = F.col("feature") == feature
    if "original_feature" in points.columns:
        test = test | (F.col("original_feature") == feature)
    return points.filter(test)

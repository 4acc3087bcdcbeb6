"""Reproducible, exact-size train/validation/test splits from the hash of the row key.

A row's place in the random order is md5(key | salt): it never depends on partitioning,
task order or retries. Sizes are exact: per class the split takes the rows with the
smallest hashes. The cut-off hash is found by radix selection: counts per hash prefix
(uniform, so no prefix is hot however large a class is), again within the prefix that holds
the cut-off until that is small, and a ranking of what is left. Tagging the table is then a
comparison per row, after a join with the cut-offs of the classes where there are any.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.functions import cells
from colonnade.functions.storage import stored
from colonnade.operators import catalog
from colonnade.settings import DEFAULTS, Settings

TRAIN, VALIDATION, TEST = "train", "validation", "test"
HELD = "__held"
HASH_DIGITS = 32  # hex digits of an md5
STRATIFIED, RANDOM = "Stratified Shuffle Split", "Random Shuffle Split"


class SplitError(ValueError):
    pass


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows that have a target value."""
    return df.filter(~cells.is_missing(df, target))


def allocation(counts: DataFrame, share: float) -> DataFrame:
    """Held-out rows per class: ceil(share * n) in all, by largest remainder of the kept part.

    `counts` is `(cls, n)`, one row per class, so its windows are tiny.
    """
    every = Window.partitionBy()
    total = F.sum("n").over(every)
    kept_total = total - F.ceil(F.lit(float(share)) * total)
    sized = counts.withColumn("exact", kept_total.cast("double") * F.col("n") / total).withColumn("kept_total", kept_total)
    sized = sized.withColumn("base", F.floor("exact")).withColumn("rest", F.col("exact") - F.floor("exact"))
    order = Window.partitionBy().orderBy(F.desc("rest"), F.asc("cls"))
    left = F.col("kept_total") - F.sum("base").over(every)
    kept = F.col("base") + F.when(F.row_number().over(order) <= left, 1).otherwise(0)
    return sized.withColumn("held", F.col("n") - kept).select("cls", "n", "held")


def _edges(prefixed: DataFrame, held: DataFrame | None, share: float) -> DataFrame:
    """`(cls, prefix, n, need)`: per class the hash prefix that holds its cut-off, its rows, and which of them is the last held out.

    `held` says how many of the given rows each class holds out; None: what `allocation` gives.
    """
    hist = prefixed.groupBy("cls", "prefix").agg(F.count("*").alias("n"))
    if held is None:
        held = allocation(hist.groupBy("cls").agg(F.sum("n").alias("n")), share).select("cls", "held")
    upto = Window.partitionBy("cls").orderBy("prefix")
    reached = cells.join_by(hist.withColumn("upto", F.sum("n").over(upto)), held, ["cls"])
    inside = (F.col("upto") - F.col("n") < F.col("held")) & (F.col("held") <= F.col("upto"))
    return reached.filter(inside).select("cls", "prefix", "n", (F.col("held") - (F.col("upto") - F.col("n"))).alias("need"))


def cutoffs(rows: DataFrame, share: float, settings: Settings = DEFAULTS) -> DataFrame:
    """`(cls, cutoff)` from `(cls, h)` rows: the largest hash that is held out, per class.

    Radix selection for all classes at once: each pass counts rows by some more digits of the hash and keeps, per
    class, the one cell that holds its cut-off. A cell of at most `range_rows` rows is ranked by one task; larger
    ones go on to the next pass. The number of passes grows with the logarithm of the largest class.
    """
    parts, held, digits = [], None, 0
    while True:
        digits += settings.hash_digits
        prefixed = rows.withColumn("prefix", F.substring("h", 1, digits))
        edges = stored(_edges(prefixed, held, share), "edges")
        last = digits >= HASH_DIGITS or not edges.filter(F.col("n") > settings.range_rows).limit(1).count()
        ready = edges if last else edges.filter(F.col("n") <= settings.range_rows)
        near = cells.join_by(prefixed, ready.select("cls", "prefix", "need"), ["cls", "prefix"])
        rank = F.row_number().over(Window.partitionBy("cls").orderBy("h"))
        parts.append(near.withColumn("rank", rank).filter(F.col("rank") == F.col("need")).select("cls", F.col("h").alias("cutoff")))
        if last:
            return reduce(DataFrame.unionByName, parts)
        wide = edges.filter(F.col("n") > settings.range_rows)
        rows = cells.join_by(prefixed, wide.select("cls", "prefix"), ["cls", "prefix"]).select("cls", "h")
        held = wide.select("cls", F.col("need").alias("held"))


def _class_column(df: DataFrame, target: str | None) -> Column:
    return F.lit("all") if target is None else cells.quoted(target).cast("string")


def can_stratify(df: DataFrame, target: str) -> bool:
    """At least two classes, each with two rows or more."""
    sizes = df.select(_class_column(df, target).alias("cls")).groupBy("cls").count()
    low = sizes.agg(F.min("count").alias("low"), F.count("*").alias("classes")).first()
    return low["classes"] > 1 and low["low"] >= 2


def hold_out(
    df: DataFrame, keys: list[str], share: float, salt, strata: str | None = None, settings: Settings = DEFAULTS,
    among: Column | None = None,
) -> DataFrame:
    """`df` with the boolean column HELD, true for the rows held out of those for which `among` holds (all by default).

    The cut-offs are computed now, so every later use sees the same split: one hash as a literal, or a stored table
    of one row per class that is joined, whatever the number of classes.
    """
    catalog.require_columns(df, *keys)
    h = cells.hash_order(keys, salt)
    cls = _class_column(df, strata)
    among = F.lit(True) if among is None else among
    found = cutoffs(df.filter(among).select(cls.alias("cls"), h.alias("h")), share, settings)
    if strata is None:
        cut = found.first()
        return df.withColumn(HELD, F.lit(False) if cut is None else among & (h <= F.lit(cut["cutoff"])))
    table = stored(found.select(F.col("cls").alias("__cut_class"), F.col("cutoff").alias("__cutoff")), "cutoffs")
    joined = df.join(table, cls.eqNullSafe(F.col("__cut_class")), "left")
    return joined.withColumn(HELD, among & F.coalesce(h <= F.col("__cutoff"), F.lit(False))).drop("__cut_class", "__cutoff")


def train_test_split(
    df: DataFrame,
    target: str,
    keys: list[str],
    problem_type: str,
    test_size: float | None = None,
    seed: int | None = None,
    settings: Settings = DEFAULTS,
) -> tuple[DataFrame, str]:
    """Rows with a target plus a `fold` column, and the strategy that was used."""
    test_size = settings.test_size if test_size is None else test_size
    seed = settings.seed if seed is None else seed
    if not 0 < test_size < 1:
        raise SplitError("test_size must lie between 0 and 1")
    valid = with_target(df, target)
    if not problem_type.endswith("classification"):
        valid = valid.filter(cells.number(df, target).isNotNull())  # text that is no number and infinities are no target
    classes = problem_type.endswith("classification") and can_stratify(valid, target)
    held = hold_out(valid, keys, test_size, seed, target if classes else None, settings)
    tagged = held.withColumn("fold", F.when(F.col(HELD), TEST).otherwise(TRAIN)).drop(HELD)
    return tagged, STRATIFIED if classes else RANDOM


def three_way_split(
    df: DataFrame,
    target: str,
    keys: list[str],
    problem_type: str,
    test_size: float | None = None,
    validation_size: float | None = None,
    seed: int | None = None,
    settings: Settings = DEFAULTS,
) -> tuple[DataFrame, str]:
    """Test rows first, then a share of the rest as validation, drawn with another salt."""
    seed = settings.seed if seed is None else seed
    validation_size = settings.validation_size if validation_size is None else validation_size
    tagged, strategy = train_test_split(df, target, keys, problem_type, test_size, seed, settings)
    rest = F.col("fold") == TRAIN
    classes = problem_type.endswith("classification") and can_stratify(tagged.filter(rest), target)
    held = hold_out(tagged, keys, validation_size, f"{seed}-validation", target if classes else None, settings, rest)
    return held.withColumn("fold", F.when(F.col(HELD), VALIDATION).otherwise(F.col("fold"))).drop(HELD), strategy


def overlap(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Row keys present on both sides; a correct split has none."""
    return train.select(*keys).intersect(test.select(*keys))


def check_disjoint(train: DataFrame, test: DataFrame, keys: list[str]) -> None:
    if not overlap(train, test, keys).isEmpty():
        raise SplitError("train and test share rows")


def split_report(tagged: DataFrame, strategy: str, target: str, classes: bool) -> DataFrame:
    """Rows and share per fold, and per class within the fold when the target has classes."""
    label = cells.quoted(target).cast("string") if classes else F.lit(None).cast("string")
    counts = tagged.groupBy("fold", label.alias("class_label")).agg(F.count("*").alias("n"))
    every, side = Window.partitionBy(), Window.partitionBy("fold")
    return counts.select(
        "fold", "class_label", "n",
        F.sum("n").over(side).alias("fold_rows"),
        cells.percent(F.sum("n").over(side), F.sum("n").over(every)).alias("fold_percentage"),
        F.lit(strategy).alias("strategy"),
    )


def check_folds(tagged: DataFrame, folds: tuple[str, ...] = (TRAIN, VALIDATION, TEST)) -> DataFrame:
    """(fold, n) for every expected fold; an empty fold raises."""
    counts = tagged.groupBy("fold").agg(F.count("*").alias("n"))
    have = {r["fold"]: r["n"] for r in counts.collect()}
    empty = [f for f in folds if not have.get(f)]
    if empty:
        raise SplitError(f"empty fold(s): {empty}")
    return counts

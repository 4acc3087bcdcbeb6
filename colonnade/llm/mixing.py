"""Mixing sources to target weights over a training run, by a curriculum of weights that change with time.

Each source has a schedule, its weight as a piecewise linear function of training time from 0 to 1. A source's share of
the words read at a time is its weight times a factor that makes its integral the source's target. The documents of a
source, in an order drawn from their ids, are laid end to end, round after round, until the target is full; the place of
a copy's first word in that line is demand, and the inverse of the integrated schedule gives the time when it is read.
Sorting all copies by time gives the training order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.llm.runtime import quoted, stored

WEIGHTS = (1, 2, 3)
MOST = 3
ROWS_PER_CELL = 4096
#: (time, weight) knots by place in the cycle of `WEIGHTS`: light sources fade out, heavy ones fade in.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def words(text: Column) -> Column:
    """Runs of bytes other than space and 9 to 13; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """From (source, source_size): also weight, target.

    Sources by code point, null last, weigh 1, 2, 3, repeating. The targets share the sum of all sizes by weight; a
    target above `MOST` times its size stops there and the excess is shared again. With sources by size per weight the
    stopped ones come first, so a running sum over them finds the common level. One row per source is sorted here.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("_rank") - 1) % len(WEIGHTS) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", MOST * F.col("source_size"))
    by_level = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    levels = ranked.withColumn("_level", level).withColumn("_open", F.col("_cap") >= F.col("_level") * F.col("weight"))
    first = F.min(F.when(F.col("_open"), F.struct((F.col("_cap") / F.col("weight")).alias("r"), "_rank", "_level"))).over(everything)
    chosen = levels.withColumn("_common", first["_level"])
    target = F.least(F.col("_cap").cast("double"), F.col("weight") * F.coalesce("_common", F.lit(0.0)))
    return chosen.select("source", "source_size", "weight", F.when(F.col("source_size") == 0, 0.0).otherwise(target).alias("target"), ((F.col("_rank") - 1) % len(SCHEDULES)).alias("cycle"))


def order_key(doc_id: Column) -> Column:
    """The order of documents within a source: hex digits of the md5 of the id."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def laid_out(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text, source used) with size, source_size, target, cycle and before: the words of their source that
    come before them in one round. Rows with the same id come by md5 of their text.

    A source may hold most rows, so its line is cut by the first digits of the order key into cells of about
    `ROWS_PER_CELL` rows. Sums per cell, a small table, place the cells; rows are sorted within cells only.
    """
    digits = max(1, min(12, math.ceil(math.log(max(1, docs.count() / ROWS_PER_CELL), 16))))
    own = docs.withColumn("_size", words(F.col("text"))).withColumn("_order", order_key(F.col("doc_id")))
    own = own.withColumn("_cell", F.substring("_order", 1, digits)).withColumn("_tie", F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    cells = own.groupBy(F.col("source").alias("_source"), F.col("_cell").alias("_c")).agg(F.sum("_size").alias("_sum"))
    ahead = Window.partitionBy("_source").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
    aims = targets(cells.groupBy(F.col("_source").alias("source")).agg(F.sum("_sum").alias("source_size")))
    placed = cells.join(aims, F.col("_source").eqNullSafe(F.col("source"))).select("_source", "_c", "_ahead", "source_size", "target", "cycle")
    within = Window.partitionBy("source", "_cell").orderBy("_order", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    lined = own.withColumn("_inside", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_cell") == F.col("_c"))
    return lined.join(placed, same).withColumn("before", F.col("_ahead") + F.col("_inside"))


def time_of(demand: Column, target: Column, cycle: Column) -> Column:
    """The time at which a source's integrated schedule reaches `demand` words of its target."""
    out = F.lit(0.0)
    for i, knots in enumerate(SCHEDULES):
        (_, start), (_, end) = knots
        share = demand / F.when(target > 0, target) * ((start + end) / 2)  # area under start + (end - start) t
        bend = end - start
        at = share / start if bend == 0 else (F.sqrt(F.greatest(F.lit(0.0), start * start + 2 * bend * share)) - start) / bend
        out = F.when(cycle == i, at).otherwise(out)
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), out)), F.lit(0.0))


def copies(lined: DataFrame) -> DataFrame:
    """The rows of `laid_out` once per round that takes them, with _round, _got (words taken) and _time."""
    whole = F.round("target").cast("long")
    rounds = F.ceil(whole / F.when(F.col("source_size") > 0, F.col("source_size")))
    each = lined.filter("_size > 0").select("*", F.explode(F.expr("sequence(0L, cast(:m as bigint) - 1)".replace(":m", str(MOST)))).alias("_round")).filter(F.col("_round") < rounds)
    start = F.col("before") + F.col("_round") * F.col("source_size")
    got = F.least(F.col("_size"), whole - start)
    return each.withColumn("_got", got).filter("_got > 0").withColumn("_time", time_of(start.cast("double"), F.col("target"), F.col("cycle")))


def time_sorted(timed: DataFrame) -> DataFrame:
    """Copies in training order: ranges of the time, sorted within."""
    return timed.repartitionByRange(F.col("_time"), F.col("_order")).sortWithinPartitions("_time", "_order")


def mixture(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, position (the time of its first copy, in [0, 1]).

    Words and times are read off the copies in training order, which is written as a table of numbers without texts. A
    document without a copy stands where its first one would be. Null texts have size 0; a null source is a source of its
    own, the last. The last document that a source's target reaches is taken in part, so every source meets its target to
    the word. Extra columns are not read.
    """
    lined = laid_out(docs.select("doc_id", "text", "source"))
    numbers = ["doc_id", "source", "_size", "source_size", "target", "cycle", "before", "_order"]
    lined = stored(lined.select(F.monotonically_increasing_id().alias("_row"), *numbers), "lined")  # written, so the numbers of rows stay
    order = stored(time_sorted(copies(lined)).select(F.col("_row").alias("_copy_of"), "_got", "_time"), "order")
    placed = order.groupBy("_copy_of").agg(F.sum("_got").alias("taken"), F.min("_time").alias("first"))
    else_at = time_of(F.col("before").cast("double"), F.col("target"), F.col("cycle"))
    return lined.join(placed, F.col("_row") == F.col("_copy_of"), "left").select(
        "doc_id", "source", F.col("_size").alias("size"), "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce(F.col("first"), else_at).alias("position"))


def training_order(docs: DataFrame) -> DataFrame:
    """The copies that the mix takes, sorted by their time over ranges, with the documents' columns.

    A document comes once per round that takes it; the copy that a target cuts keeps its words up to there. n_chars, if
    it is a column, follows the text. Documents without words have no place in the mix.
    """
    columns = docs.columns
    rest = [F.lit(0).alias("_none"), *[F.col(quoted(c)) for c in columns if c.lower() != "text"]]
    inner = docs.select("doc_id", "text", "source", F.struct(*rest).alias("_row"))
    timed = copies(laid_out(inner))
    cut = F.when(F.col("_got") < F.col("_size"), first_words(F.col("text"), F.col("_got"))).otherwise(F.col("text"))
    out = timed.withColumn("_text", cut)
    fields = [F.col("_text").alias(c) if c.lower() == "text" else F.length("_text").cast(dict(docs.dtypes)[c]).alias(c) if c.lower() == "n_chars" else F.col("_row")[c].alias(c) for c in columns]
    return time_sorted(out).select(*fields)


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word."""
    all_words = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.array_join(F.slice(all_words, F.lit(1), n.cast("int")), "")

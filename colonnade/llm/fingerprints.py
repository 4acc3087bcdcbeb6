"""Document fingerprints: threshold-scaled sketches of word runs, with DataFrame functions only.

The sketch of a text holds every hash of its runs of five words that lies below a fixed fraction of the hash range.
Sketches of a union are the union of sketches, and the share of one sketch's hashes found in another estimates how much
of one text the other contains, however unequal they are. A text of at most `WHOLE` distinct runs keeps all hashes
(fraction 1), for a fraction of few is nothing. Two sketches are compared below the smaller of their fractions.

A fingerprint is `<d>:<hash>,<hash>,...`: 1/d is the fraction, the hashes are the first 16 hex digits of the md5 of the
run's words joined by spaces, ascending.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.llm.runtime import text_of

RUN, FRACTION, WHOLE = 5, 8, 128
BELOW = "2"  # hashes whose hex digits sort before this: 2 of 16, one in `FRACTION`
DOCS_PER_BUCKET, MOST_BUCKETS = 1024, 20_000


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text without nulls. A text of fewer than five words has one run, all its words; one without words has none."""
    hashed = lambda words: F.md5(F.array_join(words, " ").cast("binary"))
    runs = lambda words: (
        F.when(F.size(words) >= RUN, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (RUN - 1))), lambda i: hashed(F.slice(words, i, RUN))))
        .when(F.size(words) > 0, F.array(hashed(words))).otherwise(F.array().cast("array<string>")))
    return _let(_let(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), runs), _print)


def _print(hashes: Column) -> Column:
    """The fingerprint of an array of md5 hashes."""
    listed = lambda h: F.array_join(F.sort_array(F.array_distinct(F.transform(h, lambda x: F.substring(x, 1, 16)))), ",")
    return F.when(F.size(F.array_distinct(hashes)) <= WHOLE, F.concat(F.lit("1:"), listed(hashes))).otherwise(
        F.concat(F.lit(f"{FRACTION}:"), listed(F.filter(hashes, lambda x: x < BELOW))))


def _hashes(print_: Column) -> Column:
    return F.array_remove(F.split(F.substring_index(print_, ":", -1), ","), "")


def merged(a: Column, b: Column) -> Column:
    """The fingerprint of two texts' runs together, from their fingerprints alone."""
    both = F.sort_array(F.array_union(_hashes(a), _hashes(b)))
    whole = lambda h: a.startswith("1:") & b.startswith("1:") & (F.size(h) <= WHOLE)
    return _let(both, lambda h: F.when(whole(h), F.concat(F.lit("1:"), F.array_join(h, ","))).otherwise(
        F.concat(F.lit(f"{FRACTION}:"), F.array_join(F.filter(h, lambda x: x < BELOW), ","))))


def compared(a: Column, b: Column) -> Column:
    """(containment, resemblance) of two fingerprints, a struct: shared hashes over those of the smaller one, and over all.

    Two equal fingerprints give 1, also two empty ones; an empty one beside another gives 0.
    """
    coarse = ~(a.startswith("1:") & b.startswith("1:"))
    cut = lambda p: _let(_hashes(p), lambda h: F.when(coarse, F.filter(h, lambda x: x < BELOW)).otherwise(h))
    sizes = _let(cut(a), lambda x: _let(cut(b), lambda y: F.struct(
        F.size(F.array_intersect(x, y)).alias("shared"), F.least(F.size(x), F.size(y)).alias("smaller"), (F.size(x) + F.size(y)).alias("both"))))
    scaled = lambda s, whole: F.when(a == b, 1.0).when(s["smaller"] == 0, 0.0).otherwise(s["shared"] / whole)
    return _let(sizes, lambda s: F.struct(scaled(s, s["smaller"]).alias("contained"), scaled(s, s["both"] - s["shared"]).alias("alike")))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with `next_<column>`: the values of the next row by doc_id (nulls first, equal ids by md5 of the text),
    the first row following the last.

    Ids are cut at quantiles into buckets of about `DOCS_PER_BUCKET` rows, each sorted by itself. A bucket also gets the
    rows of the next bucket's smallest id, so one exchange is enough. The cuts decide where rows meet, not the result.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    keyed = keyed.withColumn("_place", F.col("_key").cast("double"))
    n = docs.count()
    count = max(1, min(MOST_BUCKETS, math.ceil(n / DOCS_PER_BUCKET)))
    at = [i / count for i in range(count)]
    cuts = keyed.select(F.percentile_approx("_place", at, 10 * count + 1000), F.min("_place")).first()
    firsts = sorted({*(cuts[0] or []), *([cuts[1]] if n else [])})
    splits = [-math.inf, *firsts[1:], math.inf]
    if len(splits) < 3:
        placed = keyed.withColumn("_bucket", F.lit(0.0))
    else:
        placed = Bucketizer(splits=splits, inputCol="_place", outputCol="_bucket").transform(keyed)
    last = len(splits) - 2
    # the rows of a bucket's smallest id also close the bucket before it
    heads = spark.createDataFrame([(float(f),) for f in firsts] or [(0.0,)], "_head double")
    marked = placed.join(F.broadcast(heads), F.col("_place") == F.col("_head"), "left")
    before = F.when(F.col("_bucket") > 0, F.col("_bucket") - 1).otherwise(F.lit(float(last)))
    homes = F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("closing")))
    homes = F.when(F.col("_head").isNull(), homes).otherwise(F.concat(homes, F.array(F.struct(before.alias("b"), F.lit(True).alias("closing")))))
    each = marked.select("*", F.explode(homes).alias("_home")).select(*keyed.columns, F.col("_home.b").alias("_b"), F.col("_home.closing").alias("_closing"))
    order = Window.partitionBy("_b").orderBy("_closing", "_key", F.md5(F.col("text").cast("binary")))
    led = each.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.filter(~F.col("_closing")).drop("_key", "_place", "_b", "_closing")


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    resemblance_edited, resemblance_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next document (all,
    if it has fewer); near_* is the containment, resemblance_* the Jaccard estimate. A null text is empty. Other columns
    are not read. Rows that repeat an id follow each other.
    """
    plain = docs.select("doc_id", text_of().alias("text"))
    own = plain.withColumn("fingerprint", fingerprint(F.col("text")))
    led = with_next(own, ["text", "fingerprint"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = led.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("_edited"), "fingerprint", "next_fingerprint")
    rows = rows.select("*", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("_edited")).alias("edited_fingerprint"))
    rows = rows.select("*", compared(F.col("fingerprint"), F.col("edited_fingerprint")).alias("_edit"), compared(F.col("fingerprint"), F.col("next_fingerprint")).alias("_next"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.col("_edit.contained").alias("near_edited"),
                       F.col("_next.contained").alias("near_next"), F.col("_edit.alike").alias("resemblance_edited"), F.col("_next.alike").alias("resemblance_next"))

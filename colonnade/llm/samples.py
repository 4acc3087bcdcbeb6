"""Labelled documents that the classifiers learn from, and the fold that they never see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 modulo 4; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def clean_labels(labels: DataFrame) -> DataFrame:
    """(_id, quality) outside the held-out fold; without labels other than 0 and 1, null ids and ids with both labels."""
    return (labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"))
            .filter(F.col("_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("_id"))
            .groupBy("_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
            .filter("quality = _most").drop("_most"))


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All labelled texts outside the held-out fold, as (doc_id, text, quality); a doc_id that several rows share brings its smallest text."""
    known = docs.filter(F.col("doc_id").isNotNull() & ~held_out())
    return (known.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .join(clean_labels(labels), F.col("doc_id") == F.col("_id"))
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")))

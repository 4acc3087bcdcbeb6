"""Collects queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.settings import Settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Limits small enough to send the test tables through the forms meant for large ones.
LARGE = Settings(one_task_rows=2_000, range_rows=2_000, exact_percentile_rows=2_000, quantile_bins=64)
TINY = Settings(one_task_rows=100, range_rows=100, exact_percentile_rows=100, quantile_bins=16)

LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def query(name: str, sql: str | None = None):
    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def gapped(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with gaps and infinities: zero discounts and taxes are missing, price per tax is infinite there."""
    price_per_tax = F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(
        F.col("l_extendedprice") / F.when(F.col("l_tax") != 0, F.col("l_tax")))
    return table(spark, sf, "lineitem").select(
        *LINE_KEYS, "l_quantity", "l_extendedprice",
        F.expr("nullif(l_discount, 0.0D)").alias("discount"),
        F.expr("CASE WHEN l_tax = 0.0D THEN double('NaN') ELSE l_tax END").alias("tax"),
        price_per_tax.alias("price_per_tax"), "l_returnflag",
    )


GAPPED = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  NULLIF(l_discount, 0.0) AS discount, CASE WHEN l_tax = 0.0 THEN 'NaN'::DOUBLE ELSE l_tax END AS tax,
  CASE WHEN l_tax = 0.0 THEN 'inf'::DOUBLE ELSE l_extendedprice / l_tax END AS price_per_tax, l_returnflag
  FROM lineitem)"""
# The same with every non-finite value as null.
GAPPED_CLEAN = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  NULLIF(l_discount, 0.0) AS discount, NULLIF(l_tax, 0.0) AS tax,
  CASE WHEN l_tax <> 0.0 THEN l_extendedprice / l_tax END AS price_per_tax, l_returnflag FROM lineitem)"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their labels, missing for most."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


LABELLED = """(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def hash_sql(keys: list[str] | str, salt) -> str:
    """The row order of `cells.hash_order` in SQL."""
    names = keys.split(", ") if isinstance(keys, str) else keys
    parts = " || ".join(f"coalesce(length({k}::VARCHAR) || ':' || {k}::VARCHAR, 'n')" for k in names)
    return f"md5({parts} || '|{salt}')"


def pct(n: str, d: str, places: int = 2) -> str:
    return f"round(({n})::DOUBLE / greatest({d}, 1)::DOUBLE * 100.0::DOUBLE, {places})"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)

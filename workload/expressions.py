"""Cell-level expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.functions import cells
from colonnade.operators import statistics
from workload.registry import GAPPED, LINE_KEYS, gapped, labelled, pct, query, table


@query("exp1_numeric_coercion", """
SELECT event_id, TRY_CAST(regexp_extract(props, ':\\s*([0-9.]+)', 1) AS DOUBLE) AS k,
  TRY_CAST(event_type AS DOUBLE) AS t FROM events""")
def exp1(spark, sf):
    e = table(spark, sf, "events").withColumn("raw", F.regexp_extract("props", r":\s*([0-9.]+)", 1))
    return e.select("event_id", cells.number(e, "raw").alias("k"), cells.number(e, "event_type").alias("t"))


@query("exp2_infinity_to_null", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax <> 0.0 THEN l_extendedprice / l_tax END AS ratio,
  NULLIF(l_tax, 0.0) AS tax FROM lineitem""")
def exp2(spark, sf):
    g = gapped(spark, sf)
    return g.select(*LINE_KEYS, cells.number(g, "price_per_tax").alias("ratio"), cells.number(g, "tax").alias("tax"))


@query("exp3_missing_predicate", f"""
SELECT count(*) FILTER (WHERE discount IS NULL) AS discount,
  count(*) FILTER (WHERE tax IS NULL OR isnan(tax)) AS tax,
  count(*) FILTER (WHERE price_per_tax IS NULL OR isnan(price_per_tax)) AS price_per_tax FROM {GAPPED}""")
def exp3(spark, sf):
    g = gapped(spark, sf)
    return g.agg(*[F.count_if(cells.is_missing(g, c)).alias(c) for c in ("discount", "tax", "price_per_tax")])


@query("exp4_category_normalisation", """
SELECT o_orderpriority AS category, count(*) AS n FROM orders GROUP BY 1""")
def exp4(spark, sf):
    padded = F.concat(F.lit(" \t"), "o_orderpriority", F.lit("\n "))
    o = table(spark, sf, "orders").withColumn("padded", padded)
    return o.groupBy(cells.category(o, "padded").alias("category")).agg(F.count("*").alias("n"))


@query("exp5_safe_rounding", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_tax <> 0.0 THEN round(l_extendedprice / l_tax, 4) END AS ratio FROM lineitem""")
def exp5(spark, sf):
    return gapped(spark, sf).select(*LINE_KEYS, cells.rounded(F.col("price_per_tax")).alias("ratio"))


@query("exp6_guarded_percentage", f"""
SELECT lang, {pct('count(quality)', 'count(*)')} AS labelled_pct,
  {pct('count(*) FILTER (WHERE toxic = 1)', 'count(toxic)')} AS toxic_pct
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def exp6(spark, sf):
    return labelled(spark, sf).groupBy("lang").agg(
        cells.percent(F.count("quality"), F.count("*")).alias("labelled_pct"),
        cells.percent(F.count_if(F.col("toxic") == 1), F.count("toxic")).alias("toxic_pct"),
    )


@query("exp7_datetime_parse", """
SELECT o_orderkey, o_orderdate AS us, o_orderdate AS iso, o_orderdate AS named, NULL::TIMESTAMP AS bad FROM orders""")
def exp7(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "MM/dd/yyyy").alias("us"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("iso"),
        F.date_format("o_orderdate", "MMM d, yyyy").alias("named"))
    return o.select("o_orderkey", *[cells.time(o, c).alias(c) for c in ("us", "iso", "named")],
                    cells.time(o, "o_orderpriority").alias("bad"))


@query("exp1_codes_are_text", """
SELECT o_orderkey, NULL::DOUBLE AS code, NULL::DOUBLE AS flag, o_custkey * 1000.0::DOUBLE AS number FROM orders""")
def exp1_codes(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", *[
        F.concat(F.col("o_custkey").cast("string"), F.lit(end)).alias(name) for name, end in (("code", "d"), ("flag", "F"), ("number", "e3"))])
    return o.select("o_orderkey", *[cells.number(o, c).alias(c) for c in ("code", "flag", "number")])


@query("exp7_day_leads", """
SELECT o_orderkey, o_orderdate AS parsed, CASE WHEN day(o_orderdate) <= 12 OR o_orderkey % 50 > 0 THEN o_orderdate END AS mixed FROM orders""")
def exp7_days(spark, sf):
    d = F.col("o_orderdate")
    # in `mixed` a few dates lead with the day; those that fit only so are unreadable in a column that leads with the month
    swapped = (F.col("o_orderkey") % 50 == 0) & (F.dayofmonth(d) > 12)
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format(d, "dd/MM/yyyy").alias("parsed"), F.when(
        swapped, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy")).alias("mixed"))
    return o.select("o_orderkey", *[cells.time(o, c).alias(c) for c in ("parsed", "mixed")])


@query("exp8_row_filters", """
WITH top AS (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 3)
SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id) WHERE source IN (SELECT source FROM top)""")
def exp8(spark, sf):
    d = labelled(spark, sf)
    top = statistics.top_values(table(spark, sf, "documents"), ["source"], 3)
    few = F.broadcast(top.select(F.col("value").alias("source")))  # three rows
    return cells.complete_rows(d, "quality").join(few, "source", "left_semi").select("doc_id", "source", "quality")


@query("exp9_projection", "SELECT c_custkey AS customer, c_acctbal AS balance, c_mktsegment FROM customer")
def exp9(spark, sf):
    c = table(spark, sf, "customer")
    return c.drop("c_name", "c_nationkey").withColumnsRenamed({"c_custkey": "customer", "c_acctbal": "balance"})

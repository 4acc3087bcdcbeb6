"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.functions.storage import scratch_path
from colonnade.operators import statistics
from colonnade.plans.prepare import prepare
from colonnade.sources import csv_files, sinks, tables
from workload.registry import LINE_KEYS, gapped, query, table


def _orders_csv(spark, sf, sep=",", rename=None):
    path = scratch_path(spark, "orders_csv")
    orders = table(spark, sf, "orders")
    if rename:
        orders = orders.withColumnRenamed("o_orderkey", rename)
    orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")).write.csv(path, header=True, sep=sep)
    return path


@query("src1_csv_scan", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
  o_orderpriority FROM orders""")
def src1(spark, sf):
    return csv_files.read_csv(spark, _orders_csv(spark, sf, sep=";"))[0]


@query("src1_csv_line_breaks", "SELECT doc_id, 'n' || n_chars AS code, '| ' || text || ' |' AS body FROM documents")
def src1_breaks(spark, sf):
    path = scratch_path(spark, "texts_csv")
    texts = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("n"), "n_chars").alias("code"), F.concat(F.lit("| "), "text", F.lit(" |")).alias("body"))
    texts.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return csv_files.read_csv(spark, path, delimiter=",")[0]


@query("src2_parquet_scan", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem")
def src2(spark, sf):
    return tables.read_table(spark, f"{sf}/lineitem.parquet", [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"])


_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


@query("src3_delimiter_vote", f"""
WITH lines AS (
  SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
head AS (
  SELECT file, line, row_number() OVER (PARTITION BY file ORDER BY pos) AS r FROM lines
  WHERE trim(line, {_BLANK}) <> ''),
n AS (
  SELECT file, sum(length(line) - length(replace(line, ',', ''))) AS c,
    sum(length(line) - length(replace(line, ';', ''))) AS s,
    sum(length(line) - length(replace(line, chr(9), ''))) AS t,
    sum(length(line) - length(replace(line, '|', ''))) AS p
  FROM head WHERE r <= 5 GROUP BY file)
SELECT file, CASE WHEN greatest(c, s, t, p) = 0 OR c = greatest(c, s, t, p) THEN ','
  WHEN s = greatest(c, s, t, p) THEN ';' WHEN t = greatest(c, s, t, p) THEN chr(9) ELSE '|' END AS delimiter FROM n""")
def src3(spark, sf):
    lines = table(spark, sf, "documents").select(
        F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return csv_files.delimiter_votes(lines)


@query("src4_encoding_check", """
SELECT CASE WHEN lang IN ('es', 'fr', 'de') AND bool_or(n_chars <> strlen(text)) THEN 'latin-1' ELSE 'utf-8' END AS encoding, count(*) AS documents, 1::BIGINT AS files
FROM documents GROUP BY lang""")
def src4(spark, sf):
    """One folder per language, all but the English one in latin-1; a folder is latin-1 if one of its files is."""
    docs, parts = table(spark, sf, "documents").select("lang", "text"), None
    for lang in ("de", "en", "es", "fr"):
        path = scratch_path(spark, lang)
        own = docs.filter(F.col("lang") == lang)
        own.select("text").write.csv(path, encoding="UTF-8" if lang == "en" else "ISO-8859-1")
        foreign = F.bool_or(F.col("encoding") == "latin-1")
        found = csv_files.detect_encodings(spark, [path]).groupBy(F.regexp_extract("file", "([^/]+)/[^/]*$", 1).alias("folder")).agg(
            F.when(foreign, "latin-1").otherwise("utf-8").alias("encoding")).groupBy("encoding").agg(F.count("*").alias("files"))
        one = found.withColumn("documents", F.lit(own.count()).cast("long")).select("encoding", "documents", "files")
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query("src5_index_column_drop", """
SELECT o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority
FROM orders""")
def src5(spark, sf):
    return csv_files.read_csv(spark, _orders_csv(spark, sf, rename="index"))[0]


@query("src5_index_column_kept", """
SELECT CASE WHEN o_orderkey <= 100 THEN o_orderkey ELSE o_orderkey * 2 END AS "index", o_custkey FROM orders""")
def src5_kept(spark, sf):
    path = scratch_path(spark, "gaps_csv")
    key = F.when(F.col("o_orderkey") <= 100, F.col("o_orderkey")).otherwise(F.col("o_orderkey") * 2)
    table(spark, sf, "orders").select(key.alias("index"), "o_custkey").orderBy("index").write.csv(path, header=True)
    return csv_files.read_csv(spark, path)[0]


@query("src6_ingestion_report", """
SELECT 1::BIGINT AS files, 'utf-8' AS encoding, '|' AS delimiter, count(*) AS raw_rows, 6::BIGINT AS raw_columns,
  0::BIGINT AS skipped_rows FROM orders""")
def src6(spark, sf):
    return csv_files.read_csv(spark, _orders_csv(spark, sf, sep="|"))[1].facts(spark)


@query("src7_preview", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity, 6) AS l_quantity,
  round(l_extendedprice, 6) AS l_extendedprice, round(NULLIF(l_discount, 0.0), 6) AS discount,
  round(NULLIF(l_tax, 0.0), 6) AS tax,
  CASE WHEN l_tax <> 0.0 THEN round(l_extendedprice / l_tax, 6) END AS price_per_tax, l_returnflag
FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20""")
def src7(spark, sf):
    return tables.preview(gapped(spark, sf), LINE_KEYS)


@query("snk1_result_round_trip", """
WITH c AS (SELECT o_orderpriority AS category, count(*) AS n FROM orders GROUP BY 1)
SELECT 'o_orderpriority' AS "column", row_number() OVER (ORDER BY n DESC, category) AS rank, category, n,
  round(n::DOUBLE / (SELECT count(*) FROM orders)::DOUBLE * 100.0::DOUBLE, 2) AS percentage FROM c""")
def snk1(spark, sf):
    result = statistics.top_categories(table(spark, sf, "orders"), ["o_orderpriority"])
    path = sinks.write_result(result, scratch_path(spark, "result"), "json")
    return sinks.read_result(spark, path, "json", result.schema).select(*result.columns)


@query("snk2_pipeline_round_trip", "SELECT count(*) AS rows, 0::BIGINT AS changed FROM orders")
def snk2(spark, sf):
    orders = table(spark, sf, "orders")
    done = prepare(orders, "o_orderstatus", ["o_orderkey"], "multiclass_classification",
                   selected=["o_totalprice", "o_orderdate", "o_orderpriority"])
    again = sinks.load_pipeline(sinks.save_pipeline(done.pipeline, scratch_path(spark, "pipeline")))
    before = done.transformed().select("o_orderkey", F.col("features").alias("a"))
    after = again.transform(done.folds).select("o_orderkey", F.col("features").alias("b"))
    both = before.join(after, "o_orderkey")
    same = F.col("a").cast("string") == F.col("b").cast("string")
    return both.agg(F.count("*").alias("rows"), F.count_if(~same).alias("changed"))



"""Column catalogue and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.operators import catalog, quality
from workload.registry import GAPPED, LABELLED, gapped, labelled, pct, query, table, union_all

# (column, kind, Spark type) per table; kind: int, real, time or text.
ORDERS = [
    ("o_orderkey", "int", "bigint"), ("o_custkey", "int", "bigint"), ("o_orderstatus", "text", "string"),
    ("o_totalprice", "real", "double"), ("o_orderdate", "time", "timestamp_ntz"), ("o_orderpriority", "text", "string"),
]
DOCUMENTS = [
    ("doc_id", "int", "bigint"), ("text", "text", "string"), ("lang", "text", "string"), ("source", "text", "string"),
    ("n_chars", "int", "bigint"), ("quality", "int", "int"), ("toxic", "int", "int"),
]
ITEMS = [
    ("l_orderkey", "int", "bigint"), ("l_linenumber", "int", "int"), ("l_partkey", "int", "bigint"),
    ("l_suppkey", "int", "bigint"), ("l_quantity", "real", "double"), ("l_extendedprice", "real", "double"),
    ("discount", "real", "double"), ("tax", "real", "double"), ("price_per_tax", "real", "double"),
    ("l_returnflag", "text", "string"),
]
# Documents with a constant column, an empty one, a date name and a date text.
WIDE = DOCUMENTS + [("constant_flag", "text", "string"), ("empty_value", "real", "double"), ("created_date", "text", "string")]
WIDE_SQL = f"""(SELECT *, 'same' AS constant_flag, NULL::DOUBLE AS empty_value,
  strftime(DATE '2020-01-01' + (n_chars % 365)::INTEGER, '%Y-%m-%d') AS created_date FROM {LABELLED})"""


def wide_documents(spark, sf):
    day = F.date_add(F.to_date(F.lit("2020-01-01")), (F.col("n_chars") % 365).cast("int"))
    return labelled(spark, sf).select(
        "*", F.lit("same").alias("constant_flag"), F.lit(None).cast("double").alias("empty_value"),
        F.date_format(day, "yyyy-MM-dd").alias("created_date"))


def type_sql(c: str, kind: str) -> str:
    if kind == "time":
        return "'datetime-like'"
    if kind == "int":
        return f"CASE WHEN min({c}) >= 0 AND max({c}) <= 1 THEN 'boolean' ELSE 'integer' END"
    if kind == "real":
        v = f"CASE WHEN NOT isnan({c}) THEN {c} END"
        return f"CASE WHEN bool_and(({v}) = round({v})) AND max({v}) < 1e12 THEN 'integer' ELSE 'float' END"
    n = f"TRY_CAST(trim({c}) AS DOUBLE)"
    return f"""CASE WHEN count({c}) = 0 THEN 'mixed'
  WHEN bool_and(lower(trim({c})) IN ('true','false','yes','no','t','f','1','0')) THEN 'boolean'
  WHEN count(*) FILTER (WHERE regexp_matches({c}, '[-/:]')) >= 0.8 * count({c})
    AND bool_and(TRY_CAST(trim({c}) AS TIMESTAMP) IS NOT NULL) FILTER (WHERE {c} IS NOT NULL) THEN 'datetime-like'
  WHEN bool_and({n} IS NOT NULL) FILTER (WHERE {c} IS NOT NULL)
    THEN CASE WHEN bool_and({n} = round({n})) THEN 'integer' ELSE 'float' END
  WHEN avg(length(trim({c}))) > 60 AND count(DISTINCT {c})::DOUBLE / count(*) > 0.70 THEN 'text'
  ELSE 'categorical' END"""


def summary_sql(columns, source: str) -> str:
    parts = []
    for i, (c, kind, spark_type) in enumerate(columns):
        gone = f"{c} IS NULL OR isnan({c})" if kind == "real" else f"{c} IS NULL"
        distinct = f"count(DISTINCT CASE WHEN NOT isnan({c}) THEN {c} END)" if kind == "real" else f"count(DISTINCT {c})"
        parts.append(f"""SELECT {i}::BIGINT AS position, '{c}' AS "column", '{spark_type}' AS raw_dtype,
  {type_sql(c, kind)} AS inferred_dtype, count(*) AS row_count, count(*) FILTER (WHERE {gone}) AS missing_count,
  {distinct} AS unique_count FROM {source}""")
    return f"""SELECT *, {pct('missing_count', 'row_count')} AS missing_percentage,
  {pct('unique_count', 'row_count')} AS unique_percentage, unique_count <= 1 AS is_constant,
  unique_count > 50 AND unique_count::DOUBLE / greatest(row_count, 1) >= 0.5 AS is_high_cardinality
FROM ({union_all(parts)})"""


def duplicates_sql(columns, source: str) -> str:
    names = ", ".join(c for c, *_ in columns)
    return f"""SELECT row_count, duplicate_rows, {pct('duplicate_rows', 'row_count')} AS duplicate_percentage FROM (
  SELECT sum(n)::BIGINT AS row_count, sum(n - 1)::BIGINT AS duplicate_rows
  FROM (SELECT count(*) AS n FROM {source} GROUP BY {names}))"""


def _three(f, kinds):
    """The same small result for three tables, with the table's name."""
    def run(spark, sf):
        made = {"orders": lambda: table(spark, sf, "orders"), "documents": lambda: labelled(spark, sf),
                "items": lambda: gapped(spark, sf)}
        out = None
        for k in kinds:
            one = f(made[k]()).select(F.lit(k).alias("source_table"), "*")
            out = one if out is None else out.unionByName(one)
        return out
    return run


_SUMMARIES = union_all([
    f"SELECT '{k}' AS source_table, * FROM ({summary_sql(c, s)})"
    for k, c, s in (("orders", ORDERS, "orders"), ("documents", DOCUMENTS, LABELLED), ("items", ITEMS, GAPPED))
])

query("prf1_logical_types", f'SELECT source_table, "column", inferred_dtype FROM ({_SUMMARIES})')(
    _three(lambda df: catalog.column_summary(df).select("column", "inferred_dtype"), ("orders", "documents", "items")))
query("prf2_column_summary", _SUMMARIES)(_three(catalog.column_summary, ("orders", "documents", "items")))


@query("prf2_sample_values", """
WITH l AS (SELECT doc_id, 'lang' AS c, lang AS v FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents
  UNION ALL SELECT doc_id, 'doc_id', doc_id::VARCHAR FROM documents UNION ALL SELECT doc_id, 'text', text FROM documents
  UNION ALL SELECT doc_id, 'n_chars', n_chars::VARCHAR FROM documents)
SELECT c AS "column", r AS rank, v AS value FROM (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY doc_id) AS r FROM l)
WHERE r <= 5""")
def prf2_samples(spark, sf):
    return catalog.sample_values(table(spark, sf, "documents"), ["doc_id"]).select("column", F.col("rank").cast("long").alias("rank"), "value")


@query("prf3_duplicate_rows", union_all([
    "SELECT 'documents' AS source_table, * FROM (" + duplicates_sql(DOCUMENTS, LABELLED) + ")",
    "SELECT 'without_key' AS source_table, * FROM (" + duplicates_sql(DOCUMENTS[1:], LABELLED) + ")",
    "SELECT 'orders' AS source_table, * FROM (" + duplicates_sql(ORDERS, "orders") + ")",
]))
def prf3(spark, sf):
    documents = labelled(spark, sf)
    frames = {"documents": documents, "without_key": documents.drop("doc_id"), "orders": table(spark, sf, "orders")}
    parts = [catalog.duplicate_rows(f).select(F.lit(k).alias("source_table"), "*") for k, f in frames.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_WIDE_SUMMARY = f"({summary_sql(WIDE, WIDE_SQL)})"


@query("prf4_constant_columns", f'SELECT position, "column", unique_count FROM {_WIDE_SUMMARY} WHERE is_constant')
def prf4(spark, sf):
    return catalog.constant_columns(catalog.column_summary(wide_documents(spark, sf)))


@query("prf5_high_cardinality", f"""SELECT position, "column", inferred_dtype, unique_count, unique_percentage
FROM {_WIDE_SUMMARY} WHERE is_high_cardinality""")
def prf5(spark, sf):
    return catalog.high_cardinality_columns(catalog.column_summary(wide_documents(spark, sf)))


def _names(test: str) -> str:
    return f"""coalesce(string_agg("column", ',' ORDER BY position) FILTER (WHERE {test}), '')"""


_CLASSES = {"numeric": "inferred_dtype IN ('integer', 'float')", "categorical": "inferred_dtype IN ('categorical', 'mixed')",
            "boolean": "inferred_dtype = 'boolean'", "datetime": "inferred_dtype = 'datetime-like'",
            "text": "inferred_dtype = 'text'"}


@query("prf6_dataset_overview", f"""
SELECT max(s.row_count) AS rows, count(*) AS columns,
  {', '.join(f"count(*) FILTER (WHERE {t}) AS {k}_columns" for k, t in _CLASSES.items())},
  sum(missing_count)::BIGINT AS missing_cells,
  {', '.join(f"{_names(t)} AS {k}_names" for k, t in _CLASSES.items())},
  {_names('is_constant')} AS constant_names, {_names('is_high_cardinality')} AS high_cardinality_names,
  {pct('sum(missing_count)', 'max(s.row_count) * count(*)')} AS missing_percentage,
  max(d.duplicate_rows) AS duplicate_rows, max(d.duplicate_percentage) AS duplicate_percentage
FROM {_WIDE_SUMMARY} s, ({duplicates_sql(WIDE, WIDE_SQL)}) d""")
def prf6(spark, sf):
    df = wide_documents(spark, sf)
    out = catalog.dataset_overview(catalog.column_summary(df), catalog.duplicate_rows(df))
    return out.select(*[F.array_join(c, ",").alias(c) if c.endswith("_names") else F.col(c) for c in out.columns])


_SUSPICIOUS = f"""(
SELECT position, "column", 'constant' AS issue_type, 'warning' AS severity FROM s WHERE is_constant
UNION ALL SELECT position, "column", 'id_like', 'warning' FROM s WHERE {{ids}}
UNION ALL SELECT position, "column", 'high_cardinality', 'warning' FROM s
  WHERE is_high_cardinality AND inferred_dtype IN ('categorical', 'text')
UNION ALL SELECT position, "column", 'timestamp_like', 'info' FROM s WHERE inferred_dtype = 'datetime-like'
  OR regexp_matches(lower("column"), '(^|_)(date|time|timestamp|datetime|year|month|day)($|_)')
UNION ALL SELECT position, "column", 'high_missingness', 'warning' FROM s WHERE missing_percentage >= 50)"""
_IDS = """((regexp_matches(lower("column"), '(^|_)(id|uuid|pk|key|index|account|customer_id|user_id)($|_)')
    AND unique_percentage > 50) OR (unique_percentage >= 95 AND row_count > 30
    AND inferred_dtype IN ('integer', 'categorical', 'text')))"""


@query("qlt1_suspicious_columns", f"WITH s AS {_WIDE_SUMMARY} SELECT * FROM {_SUSPICIOUS.format(ids=_IDS)}")
def qlt1(spark, sf):
    return quality.suspicious_columns(catalog.column_summary(wide_documents(spark, sf)))


_SCORED = f"""WITH s AS {_WIDE_SUMMARY}, d AS ({duplicates_sql(WIDE, WIDE_SQL)}),
f AS (SELECT count(*) AS columns, sum(missing_percentage) / count(*) AS avg_missing,
  count(*) FILTER (WHERE missing_count > 0) AS missing_columns, {_names('missing_count > 0')} AS missing_names,
  count(*) FILTER (WHERE is_constant) AS constant_columns, {_names('is_constant')} AS constant_names,
  count(*) FILTER (WHERE is_high_cardinality) AS wide_columns, {_names('is_high_cardinality')} AS wide_names,
  count(*) FILTER (WHERE {_IDS}) AS id_columns, {_names(_IDS)} AS id_names FROM s),
p AS (SELECT
  CASE WHEN avg_missing > 0 THEN least(30, floor(avg_missing * 0.75) + CASE WHEN missing_columns > 0 THEN 5 ELSE 0 END)
    ELSE 0 END::BIGINT AS missing_data,
  CASE WHEN duplicate_percentage > 0 THEN least(20, floor(duplicate_percentage * 1.5) + 3) ELSE 0 END::BIGINT AS duplicate_rows,
  least(15, constant_columns * 5)::BIGINT AS constant_columns, least(15, wide_columns * 4)::BIGINT AS high_cardinality,
  least(10, id_columns * 3)::BIGINT AS suspicious_ids FROM f, d),
q AS (SELECT *, greatest(0, 100 - missing_data - duplicate_rows - constant_columns - high_cardinality - suspicious_ids)::BIGINT
  AS quality_score FROM p)"""


@query("qlt2_quality_score", f"{_SCORED} SELECT * FROM q")
def qlt2(spark, sf):
    df = wide_documents(spark, sf)
    return quality.quality_score(catalog.column_summary(df), catalog.duplicate_rows(df)).drop("rating")


@query("qlt3_rating", f"""{_SCORED} SELECT quality_score, CASE WHEN quality_score >= 85 THEN 'Excellent'
  WHEN quality_score >= 70 THEN 'Good' WHEN quality_score >= 50 THEN 'Fair' ELSE 'Needs Attention' END AS rating FROM q""")
def qlt3(spark, sf):
    df = wide_documents(spark, sf)
    return quality.quality_score(catalog.column_summary(df), catalog.duplicate_rows(df)).select("quality_score", "rating")


@query("qlt4_quality_checks", f"""{_SCORED}
SELECT 1::BIGINT AS position, 'Missing Data' AS check_name, CASE WHEN missing_columns = 0 THEN 'pass'
  WHEN avg_missing < 20 THEN 'warning' ELSE 'fail' END AS status, missing_names AS affected_columns FROM f
UNION ALL SELECT 2, 'Duplicate Rows', CASE WHEN duplicate_rows = 0 THEN 'pass' WHEN duplicate_percentage < 10 THEN 'warning'
  ELSE 'fail' END, '' FROM d
UNION ALL SELECT 3, 'Constant Columns', CASE WHEN constant_columns = 0 THEN 'pass' ELSE 'warning' END, constant_names FROM f
UNION ALL SELECT 4, 'High Cardinality', CASE WHEN wide_columns = 0 THEN 'pass' ELSE 'warning' END, wide_names FROM f
UNION ALL SELECT 5, 'Suspicious Identifiers', CASE WHEN id_columns = 0 THEN 'pass' ELSE 'warning' END, id_names FROM f""")
def qlt4(spark, sf):
    df = wide_documents(spark, sf)
    checks = quality.quality_checks(catalog.column_summary(df), catalog.duplicate_rows(df))
    return checks.select("position", "check_name", "status", F.array_join("affected_columns", ",").alias("affected_columns"))

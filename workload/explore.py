"""Exploratory statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.operators import association, distribution, statistics
from workload.profile import WIDE, WIDE_SQL, wide_documents
from workload.registry import (
    GAPPED_CLEAN, LABELLED, LARGE, TINY, gapped, labelled, pct, query, table, union_all,
)

ITEM_NUMBERS = ["l_quantity", "l_extendedprice", "discount", "tax", "price_per_tax"]
LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def profile_sql(columns: list[str], source: str) -> str:
    return union_all([f"""SELECT '{c}' AS "column", count(*) AS "count", count({c}) AS valid_count,
  count(*) - count({c}) AS missing_count, {pct(f'count(*) - count({c})', 'count(*)')} AS missing_percentage,
  round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std,
  round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round(quantile_cont({c}, 0.25), 4) AS q1,
  round(quantile_cont({c}, 0.75), 4) AS q3, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr,
  CASE WHEN count({c}) >= 3 AND stddev_samp({c}) > 1e-9 THEN round(skewness({c}), 4) END AS skewness,
  CASE WHEN count({c}) >= 3 AND stddev_samp({c}) > 1e-9 THEN round(kurtosis({c}), 4) END AS kurtosis
FROM (SELECT {c}::DOUBLE AS {c} FROM {source})""" for c in columns])


@query("eda1_numeric_profile", profile_sql(ITEM_NUMBERS, GAPPED_CLEAN))
def eda1(spark, sf):
    return statistics.numeric_profile(gapped(spark, sf), ITEM_NUMBERS)


@query("eda1_numeric_profile_large", profile_sql(ITEM_NUMBERS, GAPPED_CLEAN))
def eda1_large(spark, sf):
    return statistics.numeric_profile(gapped(spark, sf), ITEM_NUMBERS, LARGE)


@query("eda1_numeric_profile_inferred", profile_sql(LINE_NUMBERS, "lineitem"))
def eda1_inferred(spark, sf):
    return statistics.numeric_profile(table(spark, sf, "lineitem"))


@query("eda2_skewness_kurtosis", union_all([f"""SELECT '{c}' AS "column", round(skewness({c}), 4) AS skewness,
  round(kurtosis({c}), 4) AS kurtosis FROM (SELECT {c}::DOUBLE AS {c} FROM {t})""" for c, t in (
    ("n_chars", "documents"), ("value", "events"), ("p_size", "part"), ("c_acctbal", "customer"))]))
def eda2(spark, sf):
    parts = [statistics.numeric_profile(table(spark, sf, t), [c]).select("column", "skewness", "kurtosis") for c, t in (
        ("n_chars", "documents"), ("value", "events"), ("p_size", "part"), ("c_acctbal", "customer"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def counts_sql(columns: list[str], source: str) -> str:
    return union_all([f"""SELECT '{c}' AS col, trim({c}::VARCHAR) AS v, count(*) AS n FROM {source}
WHERE {c} IS NOT NULL GROUP BY 1, 2""" for c in columns])


def categorical_sql(columns: list[str], source: str, top: int = 10) -> str:
    return f"""WITH c AS ({counts_sql(columns, source)}),
r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS rank FROM c),
t AS (SELECT unnest({columns}) AS col, count(*) AS total FROM {source}),
a AS (SELECT col, sum(n) AS valid, count(*) AS uniq, max(n) AS best, min(CASE WHEN rank = 1 THEN v END) AS mode,
  sum(n) FILTER (WHERE rank <= {top}) AS topn FROM r GROUP BY col)
SELECT col AS "column", total AS "count", coalesce(valid, 0)::BIGINT AS valid_count,
  (total - coalesce(valid, 0))::BIGINT AS missing_count, {pct('total - coalesce(valid, 0)', 'total')} AS missing_percentage,
  coalesce(uniq, 0) AS unique_values, mode, coalesce(best, 0) AS mode_count, {pct('coalesce(best, 0)', 'total')} AS mode_percentage,
  (coalesce(valid, 0) - coalesce(topn, 0))::BIGINT AS other_count,
  {pct('coalesce(valid, 0) - coalesce(topn, 0)', 'total')} AS other_percentage FROM t LEFT JOIN a USING (col)"""


DOCUMENT_CATEGORIES = ["lang", "source", "quality", "toxic"]


@query("eda3_categorical_profile", categorical_sql(DOCUMENT_CATEGORIES, LABELLED))
def eda3(spark, sf):
    return statistics.categorical_profile(labelled(spark, sf), DOCUMENT_CATEGORIES)


@query("eda3_categorical_profile_inferred", categorical_sql(["o_orderstatus", "o_orderpriority"], "orders"))
def eda3_inferred(spark, sf):
    return statistics.categorical_profile(table(spark, sf, "orders"))


@query("eda3_top_categories", f"""WITH c AS ({counts_sql(DOCUMENT_CATEGORIES, LABELLED)}),
r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS rank FROM c)
SELECT col AS "column", rank, v AS category, n, {pct('n', '(SELECT count(*) FROM documents)')} AS percentage
FROM r WHERE rank <= 10""")
def eda3_top(spark, sf):
    return statistics.top_categories(labelled(spark, sf), DOCUMENT_CATEGORIES)


def missing_sql(columns, source: str) -> str:
    parts = [f"""SELECT {i}::BIGINT AS position, '{c}' AS "column", count(*) AS row_count,
  count(*) - count({c}) AS missing_count FROM {source}""" for i, (c, *_) in enumerate(columns)]
    return f"""SELECT *, {pct('missing_count', 'row_count')} AS missing_percentage, row_count - missing_count AS present_count,
  round(100.0::DOUBLE - {pct('missing_count', 'row_count')}, 2) AS present_percentage FROM ({union_all(parts)})"""


@query("eda4_missing_by_column", missing_sql(WIDE, WIDE_SQL))
def eda4(spark, sf):
    return statistics.missing_by_column(wide_documents(spark, sf))


@query("eda5_missing_totals", f"""WITH m AS ({missing_sql(WIDE, WIDE_SQL)})
SELECT sum(row_count)::BIGINT AS total_cells, sum(missing_count)::BIGINT AS total_missing_cells,
  {pct('sum(missing_count)', 'sum(row_count)')} AS missing_percentage,
  count(*) FILTER (WHERE missing_count > 0) AS columns_with_missing_count,
  string_agg("column", ',' ORDER BY position) FILTER (WHERE missing_count > 0) AS columns_with_missing,
  string_agg("column", ',' ORDER BY position) FILTER (WHERE missing_percentage >= 50) AS severe_missing_columns FROM m""")
def eda5(spark, sf):
    out = statistics.missing_totals(statistics.missing_by_column(wide_documents(spark, sf)))
    return out.withColumns({c: F.array_join(c, ",") for c in ("columns_with_missing", "severe_missing_columns")})


def temporal_sql(c: str, source: str) -> str:
    return f"""SELECT '{c}' AS "column", count(*) AS total_count, count(t) AS valid_dates_count,
  count(*) - count(t) AS missing_count, min(t) AS min_date, max(t) AS max_date,
  round((epoch_us(max(t)) - epoch_us(min(t)))::DOUBLE / 86400000000.0::DOUBLE, 2) AS date_range_days
FROM (SELECT TRY_CAST({c} AS TIMESTAMP) AS t FROM {source})"""


@query("eda6_temporal_profile", union_all([
    temporal_sql("ts", "events"), temporal_sql("o_orderdate", "orders"), temporal_sql("created_date", WIDE_SQL)]))
def eda6(spark, sf):
    parts = [statistics.temporal_profile(d) for d in (
        table(spark, sf, "events"), table(spark, sf, "orders"), wide_documents(spark, sf))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def correlation_cells_sql(columns: list[str], source: str) -> str:
    return union_all([f"""SELECT {i}::BIGINT AS position_a, {j}::BIGINT AS position_b, '{a}' AS feature_a, '{b}' AS feature_b,
  CASE WHEN stddev_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) > 0 AND stddev_pop(CASE WHEN {a} IS NOT NULL THEN {b} END) > 0
    THEN corr({a}::DOUBLE, {b}::DOUBLE) ELSE 0.0 END AS r FROM {source}"""
                      for i, a in enumerate(columns) for j, b in enumerate(columns)])


NET = """(SELECT *, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 + l_tax) AS gross,
  7 AS seven FROM lineitem)"""
NET_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "net", "gross", "seven"]


def net_items(spark, sf):
    price = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").withColumns({
        "net": price * (1 - F.col("l_discount")), "gross": price * (1 + F.col("l_tax")), "seven": F.lit(7)})


@query("eda7_correlation_matrix", f"""SELECT position_a, position_b, feature_a, feature_b, round(r, 4) AS correlation
FROM ({correlation_cells_sql(ITEM_NUMBERS, GAPPED_CLEAN)})""")
def eda7(spark, sf):
    return association.correlation_matrix(gapped(spark, sf), ITEM_NUMBERS).drop("r")


@query("eda8_column_preselection", f"""WITH s AS (
{union_all([f'''SELECT {i}::BIGINT AS position, '{c}' AS "column", stddev_samp({c}) / (abs(avg({c})) + 1e-5) AS spread
FROM lineitem''' for i, c in enumerate(LINE_NUMBERS)])})
SELECT position, "column", round(spread, 6) AS spread, row_number() OVER (ORDER BY spread DESC, position) AS rank FROM s""")
def eda8(spark, sf):
    return association.rank_by_spread(table(spark, sf, "lineitem"), LINE_NUMBERS).withColumn("spread", F.round("spread", 6))


@query("eda9_strong_pairs", f"""SELECT position_a, position_b, feature_a, feature_b, round(r, 4) AS correlation,
  abs(round(r, 4)) AS abs_correlation, CASE WHEN abs(r) >= 0.7 THEN 'strong' ELSE 'moderate' END AS relationship_strength,
  CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM ({correlation_cells_sql(NET_NUMBERS, NET)}) WHERE position_a < position_b AND abs(r) >= 0.5
ORDER BY abs_correlation DESC, position_a, position_b LIMIT 10""")
def eda9(spark, sf):
    return association.strong_pairs(association.correlation_matrix(net_items(spark, sf), NET_NUMBERS))


def outlier_sql(columns: list[str], source: str) -> str:
    return union_all([f"""SELECT '{c}' AS "column", round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr,
  round(q1 - 1.5 * (q3 - q1), 4) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 4) AS upper_bound,
  lo + hi AS outliers_count, {pct('lo + hi', 'n')} AS outliers_percentage, lo AS lower_count, hi AS upper_count,
  round(mn, 4) AS min_val, round(mx, 4) AS max_val, lo + hi > 0 AS has_outliers
FROM (SELECT any_value(q1) AS q1, any_value(q3) AS q3, count(v) AS n, min(v) AS mn, max(v) AS mx,
    count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1)) AS lo, count(*) FILTER (WHERE v > q3 + 1.5 * (q3 - q1)) AS hi
  FROM (SELECT {c}::DOUBLE AS v FROM {source}),
    (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {source}))""" for c in columns])


@query("eda10_iqr_outliers", outlier_sql(ITEM_NUMBERS, GAPPED_CLEAN))
def eda10(spark, sf):
    return statistics.outliers(gapped(spark, sf), ITEM_NUMBERS)


@query("eda10_iqr_outliers_large", outlier_sql(["n_chars", "quality"], LABELLED))
def eda10_large(spark, sf):
    return statistics.outliers(labelled(spark, sf), ["n_chars", "quality"], settings=TINY)


@query("eda11_numeric_distribution", profile_sql(["n_chars"], "documents"))
def eda11_numeric(spark, sf):
    return distribution.column_distribution(table(spark, sf, "documents"), "n_chars")["stats"]


@query("eda11_datetime_distribution", "SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, count(*) AS n FROM events GROUP BY 1")
def eda11_time(spark, sf):
    return distribution.column_distribution(table(spark, sf, "events"), "ts")["chart"]


@query("eda11_category_distribution", categorical_sql(["event_type"], "events"))
def eda11_category(spark, sf):
    return distribution.column_distribution(table(spark, sf, "events"), "event_type")["stats"]


@query("eda12_target_associations", f"""SELECT feature_a AS feature, round(r, 4) AS correlation, round(abs(r), 4) AS abs_correlation
FROM ({correlation_cells_sql(NET_NUMBERS, NET)}) WHERE feature_b = 'net' AND feature_a NOT IN ('net', 'seven')
ORDER BY abs_correlation DESC, feature LIMIT 5""")
def eda12(spark, sf):
    return association.target_associations(net_items(spark, sf), "net", NET_NUMBERS)


@query("eda13_categorical_target", f"""SELECT *, mode_percentage > 80 AS is_imbalanced
FROM ({categorical_sql(['quality'], 'labels')})""")
def eda13(spark, sf):
    return distribution.target_analysis(table(spark, sf, "labels"), "quality")["stats"]

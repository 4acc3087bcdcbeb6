"""Chart-ready tables."""

from __future__ import annotations

from colonnade.operators import catalog, charts, statistics
from workload.explore import ITEM_NUMBERS, NET, NET_NUMBERS, correlation_cells_sql, missing_sql, net_items
from workload.profile import ORDERS, WIDE, WIDE_SQL, summary_sql, wide_documents
from workload.registry import GAPPED_CLEAN, LARGE, LINE_KEYS, gapped, hash_sql, query, table, union_all

_KEYS = ", ".join(LINE_KEYS)


@query("cht1_missingness_bars", f"""SELECT position, "column", missing_count, missing_percentage,
  CASE WHEN missing_percentage >= 50 THEN 'severe' WHEN missing_percentage > 10 THEN 'moderate' ELSE 'low' END AS severity
FROM ({missing_sql(WIDE, WIDE_SQL)})""")
def cht1(spark, sf):
    return charts.missingness_bars(statistics.missing_by_column(wide_documents(spark, sf)))


def histogram_sql(c: str, source: str, bins: int) -> str:
    return f"""WITH e AS (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM {source}),
h AS (SELECT least(floor(({c} - lo) * {bins} / (hi - lo))::BIGINT + 1, {bins}) AS bin, count(*) AS n
  FROM {source}, e WHERE {c} IS NOT NULL GROUP BY 1)
SELECT g.bin, round(lo + (g.bin - 1) * ((hi - lo) / {bins}), 4) AS bin_start,
  round(lo + g.bin * ((hi - lo) / {bins}), 4) AS bin_end, coalesce(n, 0) AS n
FROM (SELECT unnest(generate_series(1, {bins}))::BIGINT AS bin) g CROSS JOIN e LEFT JOIN h USING (bin)"""


@query("cht2_histogram", histogram_sql("n_chars", "documents", 20))
def cht2(spark, sf):
    return charts.histogram(table(spark, sf, "documents"), "n_chars")


@query("cht2_histogram_prices", histogram_sql("l_extendedprice", "lineitem", 40))
def cht2_prices(spark, sf):
    return charts.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 40)


@query("cht3_box_numbers", union_all([f"""SELECT '{c}' AS "column", round(any_value(q1), 4) AS q1,
  round(any_value(q2), 4) AS median, round(any_value(q3), 4) AS q3,
  round(min(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS lower_whisker,
  round(max(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS upper_whisker,
  count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers_count
FROM (SELECT {c} AS v FROM {GAPPED_CLEAN}), (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2,
  quantile_cont({c}, 0.75) AS q3 FROM {GAPPED_CLEAN})""" for c in ITEM_NUMBERS]))
def cht3(spark, sf):
    return charts.box_numbers(gapped(spark, sf), ITEM_NUMBERS)


@query("cht4_category_bars", """WITH c AS (SELECT source AS v, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS rank FROM c)
SELECT rank, v AS category, n FROM r WHERE rank <= 10
UNION ALL SELECT 11, 'Other', sum(n)::BIGINT FROM r WHERE rank > 10 HAVING sum(n) > 0""")
def cht4(spark, sf):
    return charts.category_bars(table(spark, sf, "documents"), "source")


@query("cht5_correlation_heatmap", f"""SELECT position_a AS row, position_b AS col, feature_a, feature_b, round(r, 4) AS z
FROM ({correlation_cells_sql(NET_NUMBERS, NET)})""")
def cht5(spark, sf):
    return charts.correlation_heatmap(net_items(spark, sf), NET_NUMBERS)


@query("cht6_records_over_time", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS bucket, count(*) AS n FROM orders GROUP BY 1")
def cht6(spark, sf):
    return charts.records_over_time(table(spark, sf, "orders"), "o_orderdate", "month")


@query("cht7_scatter_sample", f"""SELECT {_KEYS}, round(l_quantity, 4) AS x, round(price_per_tax, 4) AS y,
  (SELECT count(*) FROM {GAPPED_CLEAN} WHERE price_per_tax IS NOT NULL) > 2000 AS sampled,
  (SELECT count(*) FROM {GAPPED_CLEAN} WHERE price_per_tax IS NOT NULL) AS total_points
FROM {GAPPED_CLEAN} WHERE price_per_tax IS NOT NULL ORDER BY {hash_sql(_KEYS, 42)}, {_KEYS} LIMIT 2000""")
def cht7(spark, sf):
    return charts.scatter_sample(gapped(spark, sf), "l_quantity", "price_per_tax", LINE_KEYS)


@query("cht8_trend_line", """SELECT n, round(s, 6) AS slope, round(i, 4) AS intercept, round(lo, 4) AS x_min, round(hi, 4) AS x_max,
  round(s * lo + i, 4) AS y_at_min, round(s * hi + i, 4) AS y_at_max
FROM (SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i,
  min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)""")
def cht8(spark, sf):
    return charts.trend_line(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


def series_sql(t: str, v: str, key: str, source: str) -> str:
    return f"""WITH o AS (SELECT {t} AS t, round({v}, 4) AS v, {key}, count(*) OVER () AS total,
  row_number() OVER (ORDER BY {t}, {hash_sql(key, 42)}, {key}) - 1 AS pos FROM {source})
SELECT t, v, {key} FROM o WHERE total <= 2000 OR pos % greatest(total // 2000, 1) = 0"""


@query("cht9_time_series", series_sql("ts", "value", "event_id", "events"))
def cht9(spark, sf):
    return charts.time_series(table(spark, sf, "events"), "ts", "value", ["event_id"])


@query("cht9_time_series_large", series_sql("o_orderdate", "o_totalprice", "o_orderkey", "orders"))
def cht9_large(spark, sf):
    return charts.time_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", ["o_orderkey"], settings=LARGE)


@query("cht9_bucketed_series", """SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, count(*) AS n, round(avg(value), 4) AS mean,
  min(value) AS low, max(value) AS high FROM events GROUP BY 1""")
def cht9_buckets(spark, sf):
    return charts.bucketed_series(table(spark, sf, "events"), "ts", "value", "day")


def grouped_box_sql(c: str, v: str, source: str) -> str:
    return f"""WITH g AS (SELECT {c} AS category, count(*) AS n, round(min({v})::DOUBLE, 4) AS min,
  round(quantile_cont({v}::DOUBLE, 0.25), 4) AS q1, round(quantile_cont({v}::DOUBLE, 0.5), 4) AS median,
  round(quantile_cont({v}::DOUBLE, 0.75), 4) AS q3, round(max({v})::DOUBLE, 4) AS max FROM {source}
  WHERE {c} IS NOT NULL AND {v} IS NOT NULL GROUP BY 1)
SELECT row_number() OVER (ORDER BY n DESC, category) AS rank, * FROM g ORDER BY n DESC, category LIMIT 8"""


@query("cht10_grouped_box", grouped_box_sql("source", "n_chars", "documents"))
def cht10(spark, sf):
    return charts.grouped_box(table(spark, sf, "documents"), "source", "n_chars")


@query("cht10_grouped_box_large", grouped_box_sql("o_orderpriority", "o_totalprice", "orders"))
def cht10_large(spark, sf):
    return charts.grouped_box(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", settings=LARGE)


@query("cht11_contingency", """WITH x AS (SELECT lang AS x, row_number() OVER (ORDER BY count(*) DESC, lang) AS x_rank FROM documents GROUP BY 1),
y AS (SELECT source AS y, row_number() OVER (ORDER BY count(*) DESC, source) AS y_rank FROM documents GROUP BY 1)
SELECT x_rank, y_rank, x, y, count(d.doc_id) AS n FROM x CROSS JOIN y LEFT JOIN documents d ON d.lang = x AND d.source = y
WHERE x_rank <= 8 AND y_rank <= 8 GROUP BY ALL""")
def cht11(spark, sf):
    return charts.contingency(table(spark, sf, "documents"), "lang", "source")


@query("cht12_chart_recommendation", f"""WITH s AS ({summary_sql(ORDERS, 'orders')}),
f AS (SELECT position, "column", CASE WHEN inferred_dtype IN ('integer', 'float') THEN 'number'
  WHEN inferred_dtype = 'datetime-like' THEN 'time'
  WHEN inferred_dtype IN ('categorical', 'boolean', 'text') THEN 'category' ELSE 'none' END AS family FROM s)
SELECT a."column" AS x, CASE WHEN a.position < b.position THEN b."column" END AS y,
  CASE WHEN a.position = b.position THEN CASE WHEN a.family IN ('number', 'time') THEN 'histogram' ELSE 'bar' END
    WHEN a.family = 'number' AND b.family = 'number' THEN 'scatter'
    WHEN a.family || b.family IN ('numbertime', 'timenumber') THEN 'line'
    WHEN a.family || b.family IN ('numbercategory', 'categorynumber') THEN 'box'
    WHEN a.family = 'category' AND b.family = 'category' THEN 'heatmap' ELSE 'unsupported' END AS chart
FROM f a JOIN f b ON a.position <= b.position""")
def cht12(spark, sf):
    return charts.recommend_charts(catalog.column_summary(table(spark, sf, "orders")))


@query("cht12_chart_data", series_sql("ts", "value", "event_id", "events"))
def cht12_data(spark, sf):
    return charts.chart_data(table(spark, sf, "events"), "value", "ts", ["event_id"])[1]



"""Evaluation of predictions that are formulas over the tables, so every figure can be checked.

Binary: is the discounted quantity above 24? Two scores answer it. Multiclass: the order
status guessed from the priority. Regression: the price of a line guessed from the part's
retail price.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from colonnade.functions import cells
from colonnade.operators import classification, diagnosis, errors, regression
from workload.registry import LARGE, LINE_KEYS, hash_sql, query, table, union_all

BY = ["model", "fold"]
_KEYS = ", ".join(LINE_KEYS)

BINARY = f"""(SELECT {_KEYS}, m AS model, l_linestatus AS fold,
  CASE WHEN l_quantity * (1 - l_discount) > 24 THEN 1 ELSE 0 END AS is_positive,
  CASE m WHEN 'by_quantity' THEN l_quantity / 50 ELSE l_extendedprice / 105000 END AS score
  FROM lineitem, (SELECT unnest(['by_quantity', 'by_price']) AS m))"""
BINARY_CLASSES = f"""(SELECT *, CASE WHEN is_positive = 1 THEN 'high' ELSE 'a_low' END AS y_true,
  CASE WHEN score >= 0.5 THEN 'high' ELSE 'a_low' END AS y_pred FROM {BINARY})"""


def binary(spark, sf):
    high = F.col("l_quantity") * (1 - F.col("l_discount")) > 24
    scores = F.array(
        F.struct(F.lit("by_quantity").alias("model"), (F.col("l_quantity") / 50).alias("score")),
        F.struct(F.lit("by_price").alias("model"), (F.col("l_extendedprice") / 105000).alias("score")))
    out = table(spark, sf, "lineitem").select(
        *LINE_KEYS, F.col("l_linestatus").alias("fold"), high.cast("int").alias("is_positive"), F.inline(scores))
    return out.withColumns({
        "y_true": F.when(F.col("is_positive") == 1, "high").otherwise("a_low"),
        "y_pred": F.when(F.col("score") >= 0.5, "high").otherwise("a_low")})


MULTI = """(SELECT o_orderkey, m AS model, o_orderstatus AS y_true, CASE m WHEN 'by_priority' THEN
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'F' WHEN '2' THEN 'O' WHEN '3' THEN 'P' WHEN '4' THEN 'F' ELSE 'X' END
    ELSE CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 300000 THEN 'O' ELSE 'P' END END AS y_pred,
  o_totalprice / 1000000 AS p_f, year(o_orderdate) / 5000.0::DOUBLE AS p_o,
  1 - o_totalprice / 1000000 - year(o_orderdate) / 5000.0::DOUBLE AS p_p
  FROM orders, (SELECT unnest(['by_priority', 'by_price']) AS m))"""


def multi(spark, sf):
    first = F.substring("o_orderpriority", 1, 1)
    by_priority = (F.when(first.isin("1", "4"), "F").when(first == "2", "O").when(first == "3", "P").otherwise("X"))
    price = F.col("o_totalprice")
    by_price = F.when(price < 150000, "F").when(price < 300000, "O").otherwise("P")
    p_f, p_o = price / 1000000, F.year("o_orderdate") / F.lit(5000.0)
    return table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("y_true"), F.array(p_f, p_o, 1 - p_f - p_o).alias("probs"),
        F.inline(F.array(F.struct(F.lit("by_priority").alias("model"), by_priority.alias("y_pred")),
                         F.struct(F.lit("by_price").alias("model"), by_price.alias("y_pred")))))


REGRESSION = f"""(SELECT {_KEYS}, l_linestatus AS fold, m AS model, l_extendedprice AS y,
  CASE m WHEN 'by_retail' THEN l_quantity * p_retailprice WHEN 'flat' THEN 50000 + l_quantity * 100
    ELSE CASE WHEN l_extendedprice < 52500 THEN l_extendedprice * 0.98::DOUBLE ELSE 52500 + l_quantity * 10 END END AS p,
  l_extendedprice - CASE m WHEN 'by_retail' THEN l_quantity * p_retailprice WHEN 'flat' THEN 50000 + l_quantity * 100
    ELSE CASE WHEN l_extendedprice < 52500 THEN l_extendedprice * 0.98::DOUBLE ELSE 52500 + l_quantity * 10 END END AS e
  FROM lineitem JOIN part ON p_partkey = l_partkey, (SELECT unnest(['by_retail', 'flat', 'half_known']) AS m))"""


def numbers(spark, sf):
    guess = F.array(
        F.struct(F.lit("by_retail").alias("model"), (F.col("l_quantity") * F.col("p_retailprice")).alias("y_pred")),
        F.struct(F.lit("flat").alias("model"), (50000 + F.col("l_quantity") * 100).alias("y_pred")),
        F.struct(F.lit("half_known").alias("model"), F.when(
            F.col("l_extendedprice") < 52500, F.col("l_extendedprice") * 0.98
        ).otherwise(52500 + F.col("l_quantity") * 10).alias("y_pred")))
    joined = table(spark, sf, "lineitem").join(
        table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    return joined.select(
        *LINE_KEYS, F.col("l_linestatus").alias("fold"), F.col("l_extendedprice").alias("y_true"), F.inline(guess))


def _div(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0)"


def class_sql(source: str, by: str) -> str:
    return f"""(SELECT {by}, label, sum(s)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(h)::BIGINT AS hits,
  {_div('sum(h)', 'sum(p)')} AS precision, {_div('sum(h)', 'sum(s)')} AS recall, {_div('2 * sum(h)', 'sum(s) + sum(p)')} AS f1
FROM (SELECT {by}, y_true AS label, 1 AS s, 0 AS p, (y_true = y_pred)::INT AS h FROM {source}
  UNION ALL SELECT {by}, y_pred, 0, 1, 0 FROM {source}) GROUP BY {by}, label)"""


def summary_sql(source: str, by: str, is_binary: bool) -> str:
    pick = (lambda c: f"arg_max({c}, label) FILTER (WHERE support > 0)") if is_binary else (lambda c: f"avg({c})")
    return f"""SELECT {by}, accuracy, balanced_accuracy, precision, recall, f1, weighted_f1,
  {', '.join(f'round({c} * 100.0::DOUBLE, 1) AS {c}_pct' for c in ('accuracy', 'precision', 'recall', 'f1'))} FROM (
SELECT {by}, round(sum(hits)::DOUBLE / sum(support), 4) AS accuracy, round(avg(recall) FILTER (WHERE support > 0), 4) AS balanced_accuracy,
  {', '.join(f'round({pick(c)}, 4) AS {c}' for c in ('precision', 'recall', 'f1'))},
  round(sum(f1 * support) / sum(support), 4) AS weighted_f1 FROM {class_sql(source, by)} GROUP BY {by})"""


@query("evc1_summary_binary", summary_sql(BINARY_CLASSES, "model, fold", True))
def evc1(spark, sf):
    return classification.summary_metrics(classification.outcome_counts(binary(spark, sf), BY), BY, True)


NUMBERED = f"""(SELECT *, CASE WHEN y_true = 'high' THEN 9 ELSE 10 END AS t, CASE WHEN y_pred = 'high' THEN 9 ELSE 10 END AS p FROM {BINARY_CLASSES})"""


@query("evc1_numbered_labels", summary_sql(f"(SELECT model, fold, t AS y_true, p AS y_pred FROM {NUMBERED})", "model, fold", True))
def evc1_numbered(spark, sf):
    ten = {c: F.when(F.col(c) == "high", 9).otherwise(10) for c in ("y_true", "y_pred")}
    return classification.summary_metrics(classification.outcome_counts(binary(spark, sf).withColumns(ten), BY), BY, True)


@query("evc3_null_groups", f"""WITH q AS (SELECT NULLIF(fold, 'F') AS fold, t, p FROM {NUMBERED}), n AS (SELECT fold, count(*) FILTER (WHERE t = 9 AND p = 9) AS tn,
  count(*) FILTER (WHERE t = 9 AND p = 10) AS fp, count(*) FILTER (WHERE t = 10 AND p = 9) AS fn, count(*) FILTER (WHERE t = 10 AND p = 10) AS tp FROM q GROUP BY fold)
SELECT fold, tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives,
  round({_div('tn', 'tn + fp')}, 4) AS specificity, round({_div('tp', 'tp + fn')}, 4) AS sensitivity FROM n""")
def evc3_null(spark, sf):
    ten = {c: F.when(F.col(c) == "high", 9).otherwise(10) for c in ("y_true", "y_pred")}
    gaps = binary(spark, sf).withColumns(ten).withColumn("fold", F.expr("nullif(fold, 'F')"))
    return classification.binary_breakdown(classification.outcome_counts(gaps, ["fold"]), ["fold"])


@query("evr1_null_groups", f"""SELECT model, NULLIF(fold, 'F') AS fold, count(*) AS n, round(avg(abs(e)), 4) AS mae,
  round(median(abs(e)), 4) AS median_absolute_error FROM {REGRESSION} GROUP BY 1, 2""")
def evr1_null(spark, sf):
    gaps = numbers(spark, sf).withColumn("fold", F.expr("nullif(fold, 'F')"))
    return regression.regression_metrics(gaps, BY).select(*BY, "n", "mae", "median_absolute_error")


@query("evc1_summary_multiclass", summary_sql(MULTI, "model", False))
def evc1_multi(spark, sf):
    return classification.summary_metrics(classification.outcome_counts(multi(spark, sf), ["model"]), ["model"], False)


@query("evc2_confusion_matrix", f"""WITH l AS (SELECT DISTINCT model, y_true FROM {MULTI}),
g AS (SELECT a.model, a.y_true, b.y_true AS y_pred FROM l a JOIN l b USING (model)),
c AS (SELECT model, y_true, y_pred, count(*) AS n FROM {MULTI} GROUP BY 1, 2, 3)
SELECT model, y_true, y_pred, coalesce(n, 0) AS n,
  round({_div('coalesce(n, 0)', 'sum(coalesce(n, 0)) OVER (PARTITION BY model, y_true)')}, 4) AS share
FROM g LEFT JOIN c USING (model, y_true, y_pred)""")
def evc2(spark, sf):
    return classification.confusion_matrix(classification.outcome_counts(multi(spark, sf), ["model"]), ["model"])


@query("evc3_binary_breakdown", f"""SELECT *, round({_div('true_negatives', 'true_negatives + false_positives')}, 4) AS specificity,
  round({_div('true_positives', 'true_positives + false_negatives')}, 4) AS sensitivity FROM (
SELECT model, fold, count(*) FILTER (WHERE y_true = 'a_low' AND y_pred = 'a_low') AS true_negatives,
  count(*) FILTER (WHERE y_true = 'a_low' AND y_pred = 'high') AS false_positives,
  count(*) FILTER (WHERE y_true = 'high' AND y_pred = 'a_low') AS false_negatives,
  count(*) FILTER (WHERE y_true = 'high' AND y_pred = 'high') AS true_positives FROM {BINARY_CLASSES} GROUP BY 1, 2)""")
def evc3(spark, sf):
    return classification.binary_breakdown(classification.outcome_counts(binary(spark, sf), BY), BY)


@query("evc4_accuracy_counts", f"""SELECT *, total - correct AS incorrect, round(round({_div('correct', 'total')}, 4) * 100.0::DOUBLE, 1) AS accuracy_pct,
  round((1.0::DOUBLE - round({_div('correct', 'total')}, 4)) * 100.0::DOUBLE, 1) AS error_pct FROM (
SELECT model, count(*) AS total, count(*) FILTER (WHERE y_true = y_pred) AS correct FROM {MULTI} GROUP BY 1)""")
def evc4(spark, sf):
    return classification.accuracy_counts(classification.outcome_counts(multi(spark, sf), ["model"]), ["model"])


@query("evc5_per_class", f"""SELECT model, label AS class_label, round(precision, 4) AS precision, round(recall, 4) AS recall,
  round(f1, 4) AS f1, support FROM {class_sql(MULTI, 'model')} WHERE support > 0""")
def evc5(spark, sf):
    return classification.per_class(classification.outcome_counts(multi(spark, sf), ["model"]), ["model"])


# Distinct scores with running totals from the highest score down.
SCORES = f"""(SELECT model, fold, score, pos, neg, row_number() OVER w - 1 AS before, count(*) OVER (PARTITION BY model, fold) AS points,
  (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp,
  (sum(pos) OVER (PARTITION BY model, fold))::BIGINT AS all_pos, (sum(neg) OVER (PARTITION BY model, fold))::BIGINT AS all_neg
FROM (SELECT model, fold, score, sum(is_positive) AS pos, sum(1 - is_positive) AS neg FROM {BINARY} GROUP BY 1, 2, 3)
WINDOW w AS (PARTITION BY model, fold ORDER BY score DESC))"""
ROC = f"""(SELECT model, fold, before + 1 AS position, points + 1 AS points, score AS threshold, fp::DOUBLE / all_neg AS fpr,
  tp::DOUBLE / all_pos AS tpr FROM {SCORES}
UNION ALL SELECT DISTINCT model, fold, 0, points + 1, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM {SCORES})"""
PR = f"""(SELECT model, fold, points - before - 1 AS position, points + 1 AS points, score AS threshold, tp::DOUBLE / (tp + fp) AS precision,
  tp::DOUBLE / all_pos AS recall FROM {SCORES}
UNION ALL SELECT DISTINCT model, fold, points, points + 1, NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM {SCORES})"""


def _curve(columns):
    return [*BY, "position", "points", "threshold", *[F.round(c, 6).alias(c) for c in columns]]


def _curve_sql(source, columns, where=""):
    return f"""SELECT model, fold, position, points, threshold, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM {source} {where}"""


@query("evc6_roc_curve", _curve_sql(ROC, ("fpr", "tpr")))
def evc6(spark, sf):
    return classification.roc_points(classification.score_table(binary(spark, sf), BY), BY).select(*_curve(("fpr", "tpr")))


@query("evc6_roc_curve_large", _curve_sql(ROC, ("fpr", "tpr")))
def evc6_large(spark, sf):
    scores = classification.score_table(binary(spark, sf), BY, LARGE)
    return classification.roc_points(scores, BY).select(*_curve(("fpr", "tpr")))


_AREA = f"""SELECT model, fold, round(sum(neg::DOUBLE * (tp - pos + pos / 2.0::DOUBLE)) / max(all_pos::DOUBLE * all_neg), 4) AS roc_auc,
  round(sum(pos * (tp::DOUBLE / (tp + fp))) / max(all_pos), 4) AS pr_auc FROM {SCORES} GROUP BY 1, 2"""


@query("evc7_roc_auc", _AREA)
def evc7(spark, sf):
    return classification.auc(classification.score_table(binary(spark, sf), BY), BY)


@query("evc7_roc_auc_large", _AREA)
def evc7_large(spark, sf):
    return classification.auc(classification.score_table(binary(spark, sf), BY, LARGE), BY)


@query("evc8_multiclass_auc", f"""WITH s AS ({union_all([f"SELECT model, '{c}' AS c, (y_true = '{c}')::INT AS pos, {p} AS score FROM {MULTI}"
                                                     for c, p in (('F', 'p_f'), ('O', 'p_o'), ('P', 'p_p'))])}),
g AS (SELECT model, c, score, sum(pos) AS pos, sum(1 - pos) AS neg FROM s GROUP BY 1, 2, 3),
r AS (SELECT *, sum(pos) OVER (PARTITION BY model, c ORDER BY score DESC) AS tp FROM g),
a AS (SELECT model, c, sum(neg::DOUBLE * (tp - pos + pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) AS auc FROM r GROUP BY 1, 2)
SELECT model, round(avg(auc), 4) AS roc_auc FROM a GROUP BY 1""")
def evc8(spark, sf):
    return classification.multiclass_auc(multi(spark, sf), ["model"], ["F", "O", "P"])


@query("evc9_precision_recall_curve", _curve_sql(PR, ("precision", "recall")))
def evc9(spark, sf):
    scores = classification.score_table(binary(spark, sf), BY)
    return classification.precision_recall_points(scores, BY).select(*_curve(("precision", "recall")))


@query("evc10_thinned_curve", f"""WITH c AS {ROC}, k AS (SELECT DISTINCT model, fold, (i * (points - 1)) // 99 AS position
  FROM (SELECT DISTINCT model, fold, points FROM c), (SELECT unnest(generate_series(0, 99)) AS i))
{_curve_sql('c', ('fpr', 'tpr'))} WHERE points <= 100 OR EXISTS (SELECT 1 FROM k
  WHERE k.model = c.model AND k.fold = c.fold AND k.position = c.position)""")
def evc10(spark, sf):
    curve = classification.roc_points(classification.score_table(binary(spark, sf), BY), BY)
    return classification.thin_curve(curve).select(*_curve(("fpr", "tpr")))


THRESHOLDS = f"""(SELECT model, fold, threshold, round({_div('tp', 'tp + fp')}, 4) AS precision, round({_div('tp', 'tp + fn')}, 4) AS recall,
  round({_div('2 * tp', '2 * tp + fp + fn')}, 4) AS f1, round({_div('tp + tn', 'tp + tn + fp + fn')}, 4) AS accuracy,
  tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives FROM (
SELECT model, fold, i / 20.0::DOUBLE AS threshold, count(*) FILTER (WHERE is_positive = 1 AND score >= i / 20.0::DOUBLE) AS tp,
  count(*) FILTER (WHERE is_positive = 0 AND score >= i / 20.0::DOUBLE) AS fp,
  count(*) FILTER (WHERE is_positive = 0 AND score < i / 20.0::DOUBLE) AS tn,
  count(*) FILTER (WHERE is_positive = 1 AND score < i / 20.0::DOUBLE) AS fn
FROM {BINARY}, (SELECT unnest(generate_series(1, 19)) AS i) GROUP BY 1, 2, 3))"""


@query("evc11_threshold_table", f"SELECT * FROM {THRESHOLDS}")
def evc11(spark, sf):
    return classification.threshold_table(binary(spark, sf), BY)


@query("evc11_nearest_threshold", f"SELECT * FROM {THRESHOLDS} WHERE threshold = 0.35::DOUBLE")
def evc11_nearest(spark, sf):
    return classification.nearest_threshold(classification.threshold_table(binary(spark, sf), BY), BY, 0.36)


@query("evc12_calibration", f"""SELECT model, fold, greatest(0, ceil(score * 10) - 1)::BIGINT AS bin, count(*) AS n,
  round(avg(score), 4) AS prob_pred, round(avg(is_positive::DOUBLE), 4) AS prob_true FROM {BINARY} GROUP BY 1, 2, 3""")
def evc12(spark, sf):
    return classification.calibration(binary(spark, sf), BY)


@query("evc13_brier_score", f"""SELECT model, fold, round(avg((score - is_positive) * (score - is_positive)), 4) AS brier_score
FROM {BINARY} GROUP BY 1, 2""")
def evc13(spark, sf):
    return classification.brier_score(binary(spark, sf), BY)


METRICS = f"""(SELECT *, 1 - mse / var_y AS r2_, 1 - var_e / var_y AS ev_ FROM (
SELECT model, fold, count(*) AS n, avg(abs(e)) AS mae_, avg(e * e) AS mse, var_pop(y) AS var_y, var_pop(e) AS var_e,
  quantile_cont(abs(e), 0.5) AS med, avg(abs(e / y)) AS mape_, count(*) FILTER (WHERE abs(y) <= 1e-5) AS zeros,
  avg(CASE WHEN abs(e / y) <= 0.1 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE abs(y) > 1e-5) AS a10,
  avg(CASE WHEN abs(e / y) <= 0.2 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE abs(y) > 1e-5) AS a20
FROM {REGRESSION} GROUP BY 1, 2))"""
_METRIC_COLUMNS = ["mae", "rmse", "r2", "median_absolute_error", "explained_variance"]


@query("evr1_regression_metrics", f"""SELECT model, fold, n, round(mae_, 4) AS mae, round(sqrt(mse), 4) AS rmse, round(r2_, 4) AS r2,
  round(med, 4) AS median_absolute_error, round(ev_, 4) AS explained_variance FROM {METRICS}""")
def evr1(spark, sf):
    return regression.regression_metrics(numbers(spark, sf), BY).select(*BY, "n", *_METRIC_COLUMNS)


@query("evr1_regression_metrics_large", f"""SELECT model, fold, n, round(mae_, 4) AS mae, round(sqrt(mse), 4) AS rmse, round(r2_, 4) AS r2,
  round(med, 4) AS median_absolute_error, round(ev_, 4) AS explained_variance FROM {METRICS}""")
def evr1_large(spark, sf):
    return regression.regression_metrics(numbers(spark, sf), BY, LARGE).select(*BY, "n", *_METRIC_COLUMNS)


@query("evr2_mape", f"SELECT model, fold, round(CASE WHEN zeros = 0 THEN mape_ END, 4) AS mape FROM {METRICS}")
def evr2(spark, sf):
    return regression.regression_metrics(numbers(spark, sf), BY).select(*BY, "mape")


@query("evr3_tolerance_shares", f"""SELECT model, fold, round(a10, 1) AS accuracy_within_10_pct,
  round(a20, 1) AS accuracy_within_20_pct FROM {METRICS}""")
def evr3(spark, sf):
    return regression.regression_metrics(numbers(spark, sf), BY).select(*BY, "accuracy_within_10_pct", "accuracy_within_20_pct")


@query("evr4_clamped_r2", f"""SELECT model, fold, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, round(r2_, 4))) * 100.0::DOUBLE, 1) AS r2_pct
FROM {METRICS}""")
def evr4(spark, sf):
    return regression.regression_metrics(numbers(spark, sf), BY).select(*BY, "r2_pct")


def _q(p, c="e"):
    return f"round(quantile_cont({c}, {p}), 4)"


@query("evr5_residual_statistics", f"""SELECT model, fold, round(avg(e), 4) AS mean, round(stddev_pop(e), 4) AS std, round(min(e), 4) AS min,
  round(max(e), 4) AS max, {_q(0.5)} AS median, {_q(0.1)} AS p10, {_q(0.25)} AS p25, {_q(0.75)} AS p75, {_q(0.9)} AS p90,
  round({_q(0.75)} - {_q(0.25)}, 4) AS iqr FROM {REGRESSION} GROUP BY 1, 2""")
def evr5(spark, sf):
    return regression.residual_statistics(numbers(spark, sf), BY)


@query("evr6_residual_histogram", f"""WITH h AS (SELECT model, fold, min(e) AS lo, max(e) AS hi FROM {REGRESSION} GROUP BY 1, 2),
c AS (SELECT r.model, r.fold, least(floor((e - lo) * 20 / (hi - lo))::BIGINT + 1, 20) AS bin, count(*) AS n
  FROM {REGRESSION} r JOIN h ON h.model = r.model AND h.fold = r.fold GROUP BY 1, 2, 3)
SELECT model, fold, bin, round(lo + (bin - 1) * ((hi - lo) / 20), 4) AS bin_start,
  round(lo + (bin - 1) * ((hi - lo) / 20) + (hi - lo) / 20, 4) AS bin_end,
  coalesce(n, 0) AS n
FROM h CROSS JOIN (SELECT unnest(generate_series(1, 20))::BIGINT AS bin) LEFT JOIN c USING (model, fold, bin)""")
def evr6(spark, sf):
    return regression.residual_histogram(numbers(spark, sf), BY).drop("bin_center")


_H = hash_sql(_KEYS, 42)
MODELS = ["by_retail", "flat", "half_known"]


def _points_sql(model: str) -> str:
    return f"""SELECT * FROM (WITH f AS (SELECT * FROM {REGRESSION} WHERE model = '{model}'),
edge AS (SELECT DISTINCT * FROM ((SELECT {_KEYS} FROM f ORDER BY e, {_KEYS} LIMIT 15) UNION ALL
  (SELECT {_KEYS} FROM f ORDER BY e DESC, {_KEYS} LIMIT 15))),
o AS (SELECT f.*, {_H} AS h, EXISTS (SELECT 1 FROM edge WHERE {' AND '.join(f'edge.{k} = f.{k}' for k in LINE_KEYS)}) AS is_edge FROM f)
SELECT model, {_KEYS}, round(y, 4) AS actual, round(p, 4) AS predicted, round(e, 4) AS residual, round(abs(e), 4) AS abs_error
FROM o ORDER BY is_edge DESC, h, {_KEYS} LIMIT 500)"""


@query("evr7_actual_vs_predicted", union_all([_points_sql(m) for m in MODELS]))
def evr7(spark, sf):
    pairs = numbers(spark, sf)
    parts = [regression.actual_vs_predicted(pairs.filter(F.col("model") == m), LINE_KEYS).select(F.lit(m).alias("model"), "*") for m in MODELS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("evr7_reference_line", f"""SELECT model, fold, round(least(min(y), min(p)), 4) AS min, round(greatest(max(y), max(p)), 4) AS max
FROM {REGRESSION} GROUP BY 1, 2""")
def evr7_line(spark, sf):
    return regression.reference_line(numbers(spark, sf), BY)


_DIAGNOSTICS = f"""WITH h AS (SELECT model, fold, round(avg(e), 4) AS mean_e, round(stddev_pop(e), 4) AS std_e, stddev_pop(y) AS std_y,
  quantile_cont(p, 0.5) AS mid FROM {REGRESSION} GROUP BY 1, 2),
f AS (SELECT r.model, r.fold, mean_e, std_e, std_y, var_pop(e) FILTER (WHERE p <= mid) AS vl, var_pop(e) FILTER (WHERE p > mid) AS vh,
  count(*) FILTER (WHERE p <= mid) AS nl, count(*) FILTER (WHERE p > mid) AS nh,
  count(*) FILTER (WHERE abs(e - mean_e) > 3 * std_e) AS large FROM {REGRESSION} r JOIN h ON h.model = r.model AND h.fold = r.fold
  GROUP BY ALL),
d AS (SELECT model, fold, 'residual_bias' AS type, 'moderate' AS severity, mean_e AS value FROM f WHERE abs(mean_e) > 0.1 * std_y
UNION ALL SELECT model, fold, 'heteroscedasticity', 'mild', round(vh / vl, 4) FROM f WHERE nl > 5 AND nh > 5 AND (vh / vl > 3 OR vh / vl < 0.33)
UNION ALL SELECT model, fold, 'outliers', 'info', large::DOUBLE FROM f WHERE large > 0)
SELECT * FROM d UNION ALL SELECT model, fold, 'normal', 'info', NULL FROM f
WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.model = f.model AND d.fold = f.fold)"""


def _diagnostics(kinds):
    return lambda spark, sf: regression.residual_diagnostics(numbers(spark, sf), BY).filter(F.col("type").isin(*kinds))


for _name, _kinds in (("evr8_residual_bias", ["residual_bias"]), ("evr9_heteroscedasticity", ["heteroscedasticity"]),
                      ("evr10_large_or_normal_residuals", ["outliers", "normal"])):
    _wanted = ", ".join(f"'{k}'" for k in _kinds)
    query(_name, f"SELECT * FROM ({_DIAGNOSTICS}) WHERE type IN ({_wanted})")(_diagnostics(_kinds))


@query("err1_misclassification", f"""SELECT *, round({_div('wrong', 'total')}, 4) AS error_rate FROM (
SELECT model, count(*) AS total, count(*) FILTER (WHERE y_true <> y_pred) AS wrong FROM {MULTI} GROUP BY 1)""")
def err1(spark, sf):
    return errors.misclassification(classification.outcome_counts(multi(spark, sf), ["model"]), ["model"])


@query("err2_confused_pairs", f"""SELECT model, rank, y_true AS actual, y_pred AS predicted, n FROM (
SELECT *, row_number() OVER (PARTITION BY model ORDER BY n DESC, y_true, y_pred) AS rank FROM (
  SELECT model, y_true, y_pred, count(*) AS n FROM {MULTI} WHERE y_true <> y_pred GROUP BY 1, 2, 3)) WHERE rank <= 10""")
def err2(spark, sf):
    return errors.confused_pairs(classification.outcome_counts(multi(spark, sf), ["model"]), ["model"])


@query("err3_worst_misclassifications", f"""SELECT model, {_KEYS}, y_true AS actual, y_pred AS predicted,
  round(CASE WHEN y_pred = 'high' THEN score ELSE 1 - score END, 4) AS confidence FROM {BINARY_CLASSES} WHERE y_true <> y_pred
ORDER BY confidence DESC, model, {_KEYS} LIMIT 20""")
def err3(spark, sf):
    confidence = F.when(F.col("y_pred") == "high", F.col("score")).otherwise(1 - F.col("score"))
    return errors.worst_misclassifications(binary(spark, sf), ["model", *LINE_KEYS], confidence)


@query("err4_worst_regression_errors", f"""SELECT model, {_KEYS}, round(y, 4) AS actual, round(p, 4) AS predicted, round(e, 4) AS residual,
  round(abs(e), 4) AS abs_error, CASE WHEN abs(y) > 1e-5 THEN round(abs(e) / abs(y) * 100.0::DOUBLE, 2) END AS relative_error_pct
FROM {REGRESSION} ORDER BY abs(e) DESC, model, {_KEYS} LIMIT 20""")
def err4(spark, sf):
    return errors.worst_regression_errors(numbers(spark, sf), ["model", *LINE_KEYS])


@query("err5_error_summary", f"""SELECT count(*) AS total, round(avg(abs(e)), 4) AS mae, round(quantile_cont(abs(e), 0.5), 4) AS median_absolute_error,
  round(max(abs(e)), 4) AS max_absolute_error, (SELECT round(avg(s), 4) FROM (SELECT abs(e) AS s FROM {REGRESSION} ORDER BY s DESC LIMIT 5))
  AS top5_mean FROM {REGRESSION}""")
def err5(spark, sf):
    return errors.error_summary(numbers(spark, sf), ["model", *LINE_KEYS])


# A leaderboard computed from the tables: three runs, one per metric; the folds are drawn by hash.
_FOLD = "CASE WHEN h < '4' THEN 'test' WHEN h < '8' THEN 'validation' ELSE 'train' END"
_MODELS = {"naive": "true", "by_quantity": "l_quantity >= 26", "by_price": "l_extendedprice >= 52500", "oracle": "l_quantity * (1 - l_discount) > 24",
           "always_low": "false"}
_GUESSES = {"naive": "25.4", "by_quantity": "l_quantity * 0.95", "by_price": "l_extendedprice / 2100", "exact": "l_quantity * (1 - l_discount)"}


def _board_part(run, metric, value, names, naive):
    """SQL that both engines read: scores per fold of one run."""
    return [f"""SELECT '{run}' AS run_id, '{name}' AS model_id, '{name}' AS model_name, 'formula' AS engine,
  CASE WHEN '{name}' = 'always_low' THEN 'failed' ELSE 'success' END AS status, '{name}' = '{naive}' AS is_naive_baseline,
  '{metric}' AS primary_metric, {value('validation', g)} AS validation_score, {value('train', g)} AS train_score,
  {value('test', g)} AS test_score FROM folded""" for name, g in names.items()]


def _accuracy(fold, g):
    return f"round(avg(CASE WHEN fold = '{fold}' THEN CASE WHEN ({g}) = (l_quantity * (1 - l_discount) > 24) THEN 1e0 ELSE 0e0 END END), 4)"


def _rmse(fold, g):
    d = f"(l_quantity * (1 - l_discount) - ({g}))"
    return f"round(sqrt(avg(CASE WHEN fold = '{fold}' THEN CAST({d} * {d} AS DOUBLE) END)), 4)"


def _mae(fold, g):
    return f"round(avg(CASE WHEN fold = '{fold}' THEN CAST(abs(l_quantity * (1 - l_discount) - ({g})) AS DOUBLE) END), 4)"


_FOLDED = f"""folded AS (SELECT *, {_FOLD} AS fold FROM (SELECT *, md5(concat_ws('|', {_KEYS})) AS h FROM lineitem))"""
_BOARD_PARTS = union_all(
    _board_part("run_accuracy", "accuracy", _accuracy, _MODELS, "naive") + _board_part("run_rmse", "rmse", _rmse, _GUESSES, "naive")
    + _board_part("run_mae", "mae", _mae, _GUESSES, "naive"))
BOARD = f"(WITH {_FOLDED} {_BOARD_PARTS})"


def board(spark, sf):
    lines = table(spark, sf, "lineitem")
    h = F.md5(F.concat_ws("|", *LINE_KEYS))
    fold = F.when(h < "4", "test").when(h < "8", "validation").otherwise("train")
    folded = lines.select("l_quantity", "l_discount", "l_extendedprice", fold.alias("fold"))
    truth = F.col("l_quantity") * (1 - F.col("l_discount"))
    folds = ("validation", "train", "test")
    aggs, rows = [], []
    runs = [("run_accuracy", "accuracy", _MODELS), ("run_rmse", "rmse", _GUESSES), ("run_mae", "mae", _GUESSES)]
    for run, metric, names in runs:
        for name, g in names.items():
            e = truth - F.expr(g) if metric != "accuracy" else None
            for f in folds:
                v = {"accuracy": lambda: (F.expr(g) == (truth > 24)).cast("double"), "rmse": lambda: e * e,
                     "mae": lambda: F.abs(e)}[metric]()
                avg = F.avg(F.when(F.col("fold") == f, v))
                aggs.append(F.round(F.sqrt(avg) if metric == "rmse" else avg, 4).alias(f"{run}_{name}_{f}"))
            rows.append({
                "run_id": f"'{run}'", "model_id": f"'{name}'", "model_name": f"'{name}'", "engine": "'formula'",
                "status": "'failed'" if name == "always_low" else "'success'",
                "is_naive_baseline": "true" if name == "naive" else "false", "primary_metric": f"'{metric}'",
                **{f"{f}_score": f"{run}_{name}_{f}" for f in folds}})
    return cells.inline_rows(folded.agg(*aggs), rows)


_UP = "primary_metric = 'accuracy'"


@query("trn2_metric_comparison", f"""SELECT a.run_id, a.model_id AS a, b.model_id AS b, CASE WHEN abs(a.validation_score - b.validation_score)
    <= 1e-6 + 1e-5 * abs(b.validation_score) THEN 0 WHEN (a.validation_score > b.validation_score) = (a.{_UP}) THEN 1 ELSE -1 END AS outcome
FROM {BOARD} a JOIN {BOARD} b ON a.run_id = b.run_id AND a.model_id < b.model_id""")
def trn2(spark, sf):
    b = board(spark, sf)
    left = b.select("run_id", "primary_metric", F.col("model_id").alias("a"), F.col("validation_score").alias("sa"))
    right = b.select("run_id", F.col("model_id").alias("b"), F.col("validation_score").alias("sb"))
    return left.join(right, "run_id").filter("a < b").select(
        "run_id", "a", "b", diagnosis.compare(F.col("primary_metric"), F.col("sa"), F.col("sb")).alias("outcome"))


RANKED = f"""(SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY (status = 'success') DESC,
    CASE WHEN {_UP} THEN -validation_score ELSE validation_score END, model_id) AS rank,
  status = 'success' AND row_number() OVER (PARTITION BY run_id ORDER BY (status = 'success') DESC, is_naive_baseline,
    CASE WHEN {_UP} THEN -validation_score ELSE validation_score END, model_id) = 1 AS is_winner FROM {BOARD})"""


@query("trn12_model_ranking", f"SELECT run_id, model_id, status, validation_score, rank, is_winner FROM {RANKED}")
def trn12(spark, sf):
    return diagnosis.rank_models(board(spark, sf)).select("run_id", "model_id", "status", "validation_score", "rank", "is_winner")


_GAP = f"round(CASE WHEN {_UP} THEN validation_score - test_score ELSE test_score - validation_score END, 4)"
DIAGNOSED = f"""(SELECT *, {_GAP} AS generalization_gap, CASE
  WHEN {_UP} AND validation_score >= 0.999 THEN 'Suspiciously High Performance'
  WHEN NOT ({_UP}) AND validation_score <= 1e-5 THEN 'Suspiciously High Performance'
  WHEN abs(validation_score - naive_score) <= 1e-6 + 1e-5 * abs(naive_score) THEN 'Underfitting'
  WHEN (validation_score < naive_score) = ({_UP}) THEN 'Worse than Baseline'
  WHEN {_UP} AND abs(validation_score - naive_score) < 0.02 AND abs(test_score - naive_score) < 0.02 THEN 'Underfitting'
  WHEN {_GAP} >= 0.20 THEN 'Severe Overfitting' WHEN {_GAP} >= 0.08 THEN 'Possible Overfitting'
  ELSE 'Normal / Well-fit' END AS diagnostic_label FROM (
  SELECT *, max(CASE WHEN is_naive_baseline THEN validation_score END) OVER (PARTITION BY run_id) AS naive_score FROM {RANKED}))"""


def diagnosed(spark, sf):
    return diagnosis.fit_diagnosis(diagnosis.with_naive_score(diagnosis.rank_models(board(spark, sf))))


@query("trn13_run_summary", f"""SELECT run_id, primary_metric, count(*) AS total_models, count(*) FILTER (WHERE status = 'success') AS successful_models,
  count(*) FILTER (WHERE status <> 'success') AS failed_models, max(CASE WHEN is_winner THEN model_name END) AS winning_model,
  max(CASE WHEN is_winner THEN engine END) AS winning_engine, max(CASE WHEN is_winner THEN validation_score END) AS validation_score,
  max(CASE WHEN is_winner THEN train_score END) AS train_score, max(CASE WHEN is_winner THEN test_score END) AS test_score,
  max(CASE WHEN is_winner THEN generalization_gap END) AS generalization_gap,
  max(CASE WHEN is_winner THEN diagnostic_label END) AS diagnostic_label FROM {DIAGNOSED} GROUP BY 1, 2""")
def trn13(spark, sf):
    return diagnosis.run_summary(diagnosed(spark, sf))


@query("trn14_generalization_gap", f"SELECT run_id, model_id, {_GAP} AS gap FROM {BOARD}")
def trn14(spark, sf):
    gap = diagnosis.generalization_gap(F.col("primary_metric"), F.col("validation_score"), F.col("test_score"))
    return board(spark, sf).select("run_id", "model_id", gap.alias("gap"))


@query("trn15_fit_diagnosis", f"SELECT run_id, model_id, generalization_gap, diagnostic_label FROM {DIAGNOSED}")
def trn15(spark, sf):
    return diagnosed(spark, sf).select("run_id", "model_id", "generalization_gap", "diagnostic_label")


@query("trn16_improvement_over_naive", f"""SELECT run_id, model_id, round(validation_score - naive_score, 4) AS improvement,
  round((validation_score - naive_score) / abs(naive_score) * 100.0::DOUBLE, 1) AS improvement_pct FROM {DIAGNOSED}""")
def trn16(spark, sf):
    return diagnosis.improvement_over_naive(diagnosis.with_naive_score(board(spark, sf))).select(
        "run_id", "model_id", "improvement", "improvement_pct")


@query("dia1_generalization_diagnosis", f"""SELECT run_id, model_id, CASE WHEN {_UP} THEN 'higher' ELSE 'lower' END AS metric_direction,
  generalization_gap, round(CASE WHEN {_UP} THEN train_score - validation_score ELSE validation_score - train_score END, 4)
    AS train_validation_gap, CASE
  WHEN diagnostic_label IN ('Suspiciously High Performance', 'Worse than Baseline') THEN diagnostic_label
  WHEN abs(validation_score - naive_score) <= 1e-6 + 1e-5 * abs(naive_score) THEN 'Potential underfitting indicator'
  WHEN generalization_gap >= 0.20 THEN 'Large generalization gap' WHEN generalization_gap >= 0.08 THEN 'Moderate generalization gap'
  ELSE 'Normal / Well-fit' END AS diagnostic_label FROM {DIAGNOSED}""")
def dia1(spark, sf):
    return diagnosis.generalization_diagnosis(diagnosis.with_naive_score(board(spark, sf))).select(
        "run_id", "model_id", "metric_direction", "generalization_gap", "train_validation_gap", "diagnostic_label")


@query("dia2_gap_bucket", f"""SELECT run_id, model_id, CASE WHEN pct <= 3 THEN 'Excellent' WHEN pct <= 7 THEN 'Healthy'
  WHEN pct <= 15 THEN 'Moderate' ELSE 'Large' END AS bucket FROM (SELECT run_id, model_id,
  abs(CASE WHEN abs({_GAP}) <= 1 THEN {_GAP} * 100 ELSE {_GAP} END) AS pct FROM {BOARD})""")
def dia2(spark, sf):
    gap = diagnosis.generalization_gap(F.col("primary_metric"), F.col("validation_score"), F.col("test_score"))
    return board(spark, sf).select("run_id", "model_id", diagnosis.gap_bucket(gap).alias("bucket"))


@query("cmp1_model_comparison", f"""SELECT run_id, rank, model_id, model_name, engine, status, is_winner, is_naive_baseline, validation_score,
  train_score, test_score, generalization_gap, diagnostic_label FROM {DIAGNOSED}""")
def cmp1(spark, sf):
    return diagnosis.comparison_table(diagnosed(spark, sf))


@query("cmp1_comparison_chart", union_all([f"""SELECT run_id, rank, model_name, '{s}' AS series, round({s}_score, 4) AS score
FROM {RANKED} WHERE status = 'success'""" for s in ("validation", "train", "test")]))
def cmp1_chart(spark, sf):
    return diagnosis.comparison_chart(diagnosis.rank_models(board(spark, sf)))

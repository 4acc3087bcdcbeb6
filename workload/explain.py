"""Importances and attributions."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from colonnade.operators import explain, split, tree_attribution
from colonnade.plans import explanation
from workload.registry import LINE_KEYS, hash_sql, query, table, union_all
from workload.train import segment_run, wealth_run

_KEYS = ", ".join(LINE_KEYS)
# Weights of the linear model whose attributions are checked, and the means they refer to.
WEIGHTS = {"l_quantity": 0.8127313, "l_extendedprice": -0.000483719, "l_discount": 121.3737, "l_tax": -41.17129}
MEANS = {"l_quantity": 25.0, "l_extendedprice": 53000.0, "l_discount": 0.05, "l_tax": 0.04}

PHI = "(" + union_all([
    f"SELECT {_KEYS}, '{c}' AS feature, {c} AS feature_value, {w!r}::DOUBLE * ({c} - {MEANS[c]!r}::DOUBLE) AS phi FROM lineitem"
    for c, w in WEIGHTS.items()]) + ")"


def phi(spark, sf):
    return explain.linear_attributions(table(spark, sf, "lineitem"), LINE_KEYS, WEIGHTS, MEANS)


def tree_of(run):
    return next(e["model_id"] for e in run.entries if e["model_name"].startswith("RandomForest"))


@query("xai1_native_importance")
def xai1(spark, sf):
    run = wealth_run(spark, sf)
    return explanation.importance(run, tree_of(run))


@query("xai2_importance_by_column", f"""SELECT CASE WHEN feature IN ('l_discount', 'l_tax') THEN 'rates' ELSE 'amounts' END AS original_feature,
  round(sum(importance), 4) AS importance, count(*) AS features
FROM (SELECT feature, avg(abs(phi)) AS importance FROM {PHI} GROUP BY 1) GROUP BY 1""")
def xai2(spark, sf):
    each = phi(spark, sf).groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"))
    origin = F.when(F.col("feature").isin("l_discount", "l_tax"), "rates").otherwise("amounts")
    return explain.by_original_feature(each.withColumn("original_feature", origin))


@query("xai3_permutation_importance")
def xai3(spark, sf):
    run = wealth_run(spark, sf)
    return explanation.permutation(run, tree_of(run), 3)


# One group of rows up to 10,000 customers; each takes the value of the next one in hash order, the last that of the first.
_DRAW = " UNION ALL ".join(f"""SELECT {r} AS draw, c_acctbal > 4000 AS label, coalesce(lead(c_acctbal) OVER w, first_value(c_acctbal) OVER w) > 4000 AS said
  FROM customer WINDOW w AS (ORDER BY {hash_sql("c_custkey", f"42-repeat-{r}")}, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
                           for r in range(5))


@query("xai3_fixed_scorer", f"""
WITH lost AS (SELECT draw, 1.0::DOUBLE - avg((label = said)::INT::DOUBLE) AS drop_ FROM ({_DRAW}) GROUP BY draw)
SELECT 'balance' AS feature, 'c_acctbal' AS original_feature, round(avg(drop_), 4) AS importance_mean, round(stddev_pop(drop_), 4) AS importance_std FROM lost
UNION ALL SELECT 'nation', 'c_nationkey', 0.0::DOUBLE, 0.0::DOUBLE""")
def xai3_fixed(spark, sf):
    """A scorer that looks at the balance alone and is right about it."""
    rows = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") > 4000).cast("double").alias("label"),
                                               array_to_vector(F.array(F.col("c_acctbal").cast("double"), F.col("c_nationkey").cast("double"))).alias("features"))
    said = (vector_to_array("features")[0] > 4000).cast("double")
    return explain.permutation_importance(rows, ["c_custkey"], lambda d: d.withColumn("prediction", said), [("balance", "c_acctbal"), ("nation", "c_nationkey")], True)


@query("xai4_linear_attribution", f"SELECT {_KEYS}, feature, feature_value, round(phi, 6) AS phi FROM {PHI}")
def xai4(spark, sf):
    return phi(spark, sf).withColumn("phi", F.round("phi", 6))


@query("xai5_exact_forest")
def xai5_forest(spark, sf):
    """The fitted forest's exact attributions, by feature."""
    run = wealth_run(spark, sf)
    return explain.global_attribution(explanation.attributions(run, tree_of(run)))


@query("xai5_sampled_shapley")
def xai5(spark, sf):
    run = wealth_run(spark, sf)
    return explain.global_attribution(explanation.attributions(run, tree_of(run), orders=4))


@query("xai5_linear_scorer", union_all([
    f"SELECT {_KEYS}, '{c}' AS feature, {c} AS feature_value, round({w!r}::DOUBLE * ({c} - {MEANS[c]!r}::DOUBLE), 4) AS phi FROM lineitem" for c, w in WEIGHTS.items()]))
def xai5_linear(spark, sf):
    """For a linear scorer and one background row every order gives weight times difference."""
    rows = table(spark, sf, "lineitem").select(*LINE_KEYS, array_to_vector(F.array(*[F.col(c) for c in WEIGHTS])).alias("features"))
    x = vector_to_array("features")
    value = sum((F.lit(w) * x[i] for i, w in enumerate(WEIGHTS.values())), F.lit(0.0))
    phi_ = explain.sampled_shapley(rows, [list(MEANS.values())], LINE_KEYS, lambda d: d.withColumn("prediction", value), F.col("prediction"), [(c, c) for c in WEIGHTS], 2)
    return phi_.select(*LINE_KEYS, "feature", "feature_value", F.round("phi", 4).alias("phi"))


# A small ensemble whose attributions are checked. Per node: tree, weight, id, feature (-1: leaf), threshold,
# categories, left, right, cover, value. Features are the quantity, the discount and the tax.
TREES = [
    (0, 1.0, 0, 0, 24.0, None, 1, 2, 600.0, [0.0]), (0, 1.0, 1, 1, 0.05, None, 3, 4, 280.0, [0.0]), (0, 1.0, 2, 0, 40.0, None, 5, 6, 320.0, [0.0]),
    (0, 1.0, 3, -1, None, None, -1, -1, 150.0, [1.25]), (0, 1.0, 4, -1, None, None, -1, -1, 130.0, [-0.5]),
    (0, 1.0, 5, -1, None, None, -1, -1, 200.0, [2.0]), (0, 1.0, 6, -1, None, None, -1, -1, 120.0, [3.5]),
    (1, 0.5, 0, 1, 0.03, None, 1, 2, 600.0, [0.0]), (1, 0.5, 1, -1, None, None, -1, -1, 240.0, [4.0]), (1, 0.5, 2, -1, None, None, -1, -1, 360.0, [-1.0]),
]


@query("xai5_tree_attributions", f"""WITH v AS (SELECT *,
  (150 * 1.25::DOUBLE - 130 * 0.5::DOUBLE + 200 * 2.0::DOUBLE + 120 * 3.5::DOUBLE) / 600 AS none,
  CASE WHEN l_quantity <= 24 THEN (150 * 1.25::DOUBLE - 130 * 0.5::DOUBLE) / 280 WHEN l_quantity <= 40 THEN 2.0::DOUBLE ELSE 3.5::DOUBLE END AS q,
  280 / 600::DOUBLE * CASE WHEN l_discount <= 0.05 THEN 1.25::DOUBLE ELSE -0.5::DOUBLE END + (200 * 2.0::DOUBLE + 120 * 3.5::DOUBLE) / 600 AS d,
  CASE WHEN l_quantity <= 24 THEN CASE WHEN l_discount <= 0.05 THEN 1.25::DOUBLE ELSE -0.5::DOUBLE END WHEN l_quantity <= 40 THEN 2.0::DOUBLE ELSE 3.5::DOUBLE END AS qd,
  0.5::DOUBLE * (CASE WHEN l_discount <= 0.03 THEN 4.0::DOUBLE ELSE -1.0::DOUBLE END - (240 * 4.0::DOUBLE - 360) / 600) AS second FROM lineitem)
SELECT {_KEYS}, 'l_quantity' AS feature, l_quantity AS feature_value, round(((q - none) + (qd - d)) / 2 + 1e-9::DOUBLE, 6) AS phi FROM v
UNION ALL SELECT {_KEYS}, 'l_discount', l_discount, round(((d - none) + (qd - q)) / 2 + second + 1e-9::DOUBLE, 6) FROM v
UNION ALL SELECT {_KEYS}, 'l_tax', l_tax, round(1e-9::DOUBLE, 6) FROM v""")
def xai5_trees(spark, sf):
    """Exact attributions of a given ensemble on every line."""
    columns = ["l_quantity", "l_discount", "l_tax"]
    rows = table(spark, sf, "lineitem").select(*LINE_KEYS, array_to_vector(F.array(*columns)).alias("features"))
    phi_ = tree_attribution.tree_attributions(rows, LINE_KEYS, spark.createDataFrame(TREES, tree_attribution.NODES), [(c, c) for c in columns])
    # shifted away from the half-way points of rounding
    return phi_.select(*LINE_KEYS, "feature", "feature_value", F.round(F.col("phi") + 1e-9, 6).alias("phi"))


@query("xai6_global_attribution", f"""SELECT feature, round(avg(abs(phi)), 4) AS mean_abs_phi, count(*) AS n FROM {PHI} GROUP BY 1""")
def xai6(spark, sf):
    return explain.global_attribution(phi(spark, sf))


POINTS = f"""(WITH best AS (SELECT feature FROM {PHI} GROUP BY 1 ORDER BY round(avg(abs(phi)), 4) DESC, feature LIMIT 3),
p AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY {hash_sql(_KEYS, 42)}, {_KEYS}) AS r
  FROM {PHI} WHERE feature IN (SELECT feature FROM best)),
k AS (SELECT *, min(feature_value) OVER (PARTITION BY feature) AS lo, max(feature_value) OVER (PARTITION BY feature) AS hi
  FROM p WHERE r <= 100)
SELECT {_KEYS}, feature, round(phi, 4) AS phi, round(feature_value, 4) AS feature_value,
  round((feature_value - lo) / CASE WHEN hi - lo > 1e-6 THEN hi - lo ELSE 1.0 END, 3) AS normalized_value FROM k)"""


@query("xai7_summary_points", f"SELECT * FROM {POINTS}")
def xai7(spark, sf):
    return explain.summary_points(phi(spark, sf), LINE_KEYS, 3)


@query("xai8_local_explanation")
def xai8(spark, sf):
    run = wealth_run(spark, sf)
    rows = explain.sample_rows(run.fold(split.TEST), run.prepared.keys, 5, "local")
    return explanation.local(run, tree_of(run), rows)["contributions"]


@query("xai8_strongest_contributions", f"""SELECT {_KEYS}, rank, feature, round(feature_value, 4) AS feature_value, round(phi, 4) AS phi,
  round(abs(phi), 4) AS abs_phi, CASE WHEN phi >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM (
SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY abs(phi) DESC, feature) AS rank FROM {PHI}) WHERE rank <= 2""")
def xai8_strongest(spark, sf):
    return explain.local_explanation(phi(spark, sf), LINE_KEYS, 2)


@query("xai9_dependence", f"SELECT {_KEYS}, feature, phi, feature_value FROM {POINTS} WHERE feature = 'l_quantity'")
def xai9(spark, sf):
    points = explain.summary_points(phi(spark, sf), LINE_KEYS, 3)
    return explain.dependence(points, "l_quantity").drop("normalized_value")


@query("xai9_dependence_by_column")
def xai9_column(spark, sf):
    run = segment_run(spark, sf)
    values = explanation.attributions(run, tree_of(run), orders=2)
    return explain.dependence(explain.summary_points(values, ["c_custkey"], 5), "c_acctbal")

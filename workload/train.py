"""Training on labels that the tables' columns determine.

Fits are kept per session and scale folder, so the queries about one run share it.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from colonnade.functions.storage import scratch_path
from colonnade.operators import classification, diagnosis, models, split
from colonnade.operators import target as targets
from colonnade.plans import evaluation, training
from colonnade.sources import sinks
from workload.prepare import balance_sql, folds_sql
from workload.registry import LABELLED, LINE_KEYS, labelled, query, table

_RUNS: dict[tuple, training.Run] = {}


def kept(spark, sf, name, make):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _RUNS:
        _RUNS[key] = make()
    return _RUNS[key]


def wealth(spark, sf):
    """Orders with their customer; the label says whether price and balance together are high."""
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    joined = table(spark, sf, "orders").join(customers, "o_custkey")
    return joined.withColumn("big", (F.col("o_totalprice") + F.col("c_acctbal") * 20 > 350000).cast("int"))


WEALTH_FEATURES = ["o_totalprice", "c_acctbal", "o_orderdate", "o_orderpriority"]


def wealth_run(spark, sf):
    return kept(spark, sf, "wealth", lambda: training.train(
        wealth(spark, sf), "big", ["o_orderkey"], targets.BINARY, run_id="run_wealth", selected=WEALTH_FEATURES))


def segment_run(spark, sf):
    """A label that no feature explains, so the tuning rounds run to their end."""
    def make():
        c = table(spark, sf, "customer").withColumn("heavy", F.col("c_mktsegment").isin("BUILDING", "MACHINERY").cast("int"))
        return training.train(c, "heavy", ["c_custkey"], targets.BINARY, mode="standard", run_id="run_segment",
                              selected=["c_acctbal", "c_nationkey"])
    return kept(spark, sf, "segment", make)


@query("trn1_default_metric", f"""SELECT 'binary_classification' AS problem_type, minority_percentage,
  CASE WHEN minority_percentage < 25 THEN 'f1' ELSE 'accuracy' END AS primary_metric
FROM (SELECT min(percentage) AS minority_percentage FROM ({balance_sql('quality', LABELLED)}))""")
def trn1(spark, sf):
    return diagnosis.default_metric_table(targets.class_balance(labelled(spark, sf), "quality"), targets.BINARY)


@query("trn3_naive_baseline", f"""WITH f AS {folds_sql(True)}, m AS (SELECT o_orderstatus AS best FROM f WHERE fold = 'train'
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT fold, best AS answer, count(*) AS n, round(avg(CASE WHEN o_orderstatus = best THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS accuracy
FROM f, m GROUP BY 1, 2""")
def trn3(spark, sf):
    tagged, _ = split.three_way_split(table(spark, sf, "orders"), "o_orderstatus", ["o_orderkey"], targets.MULTICLASS)
    indexer = models.label_indexer("o_orderstatus").fit(tagged)
    rows = indexer.transform(tagged)
    model = models.NaiveBaseline(classes=len(indexer.labels)).fit(rows.filter("fold = 'train'"))
    scored = models.score(model, rows, ["fold"], list(indexer.labels))
    hit = F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))
    return scored.groupBy("fold", F.col("y_pred").alias("answer")).agg(F.count("*").alias("n"), F.round(hit, 4).alias("accuracy"))


@query("trn3_naive_mean", "SELECT round(avg(o_totalprice), 4) AS answer, count(*) AS n FROM orders")
def trn3_mean(spark, sf):
    rows = table(spark, sf, "orders").withColumn("label", F.col("o_totalprice"))
    model = models.NaiveBaseline(classes=0).fit(rows)
    return model.transform(rows).groupBy(F.round("prediction", 4).alias("answer")).agg(F.count("*").alias("n"))


@query("trn4_least_squares", """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""")
def trn4(spark, sf):
    rows = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(
        table(spark, sf, "lineitem").withColumn("label", F.col("l_extendedprice")))
    model = LinearRegression(solver="normal").fit(rows)
    fitted = model.transform(rows).agg(
        F.regr_slope("prediction", "l_quantity").alias("slope"), F.regr_intercept("prediction", "l_quantity").alias("intercept"))
    return fitted.select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


def _metrics_of(run, model_name):
    entry = next(e for e in run.entries if e["model_name"].startswith(model_name))
    scored = run.predictions(entry["model_id"], split.VALIDATION, split.TRAIN)
    counts = classification.outcome_counts(scored, ["fold"])
    return classification.summary_metrics(counts, ["fold"], True).withColumn("model_name", F.lit(entry["model_name"]))


@query("trn4_logistic_regression")
def trn4_logistic(spark, sf):
    return _metrics_of(wealth_run(spark, sf), "LogisticRegression")


@query("trn5_random_forest")
def trn5(spark, sf):
    return _metrics_of(wealth_run(spark, sf), "RandomForest")


@query("trn6_boosted_trees")
def trn6(spark, sf):
    return _metrics_of(wealth_run(spark, sf), "GradientBoosted")


@query("trn6_boosted_trees_multiclass")
def trn6_multi(spark, sf):
    c = table(spark, sf, "customer").withColumn(
        "band", F.when(F.col("c_acctbal") < 2000, "low").when(F.col("c_acctbal") < 6000, "middle").otherwise("top"))
    run = training.start_run(c, "band", ["c_custkey"], targets.MULTICLASS, run_id="bands", selected=["c_acctbal", "c_mktsegment"])
    training.try_candidate(run, models.Candidate(
        "GradientBoostedTreesClassifier", "mllib", lambda: models.boosted_classifier(3, maxIter=10, maxDepth=4, seed=42)))
    return run.leaderboard().select("model_name", "status", "primary_metric", "validation_score", "train_score",
                                    F.explode("validation_metrics").alias("metric", "value"))


@query("trn7_label_encoding", """SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS label,
  o_orderpriority AS again FROM orders""")
def trn7(spark, sf):
    indexer = models.label_indexer("o_orderpriority").fit(table(spark, sf, "orders"))
    coded = indexer.transform(table(spark, sf, "orders"))
    return models.label_back(list(indexer.labels), "label", "again").transform(coded).select("o_orderkey", "label", "again")


@query("trn8_parameter_search")
def trn8(spark, sf):
    run = training.start_run(wealth(spark, sf), "big", ["o_orderkey"], targets.BINARY, run_id="search", selected=WEALTH_FEATURES)
    training.search(run, {
        "forest": (RandomForestClassifier, {"numTrees": [10], "maxDepth": [4, 8], "seed": [42]}),
        "boosted": (GBTClassifier, {"maxIter": [5], "maxDepth": [3], "seed": [42]})}, seconds=60)
    return run.leaderboard().select("rank", "model_name", "status", "validation_score", "train_score", "is_winner")


_BOARD = ["rank", "model_id", "model_name", "status", "is_naive_baseline", "is_winner", "validation_score", "train_score",
          "test_score", "generalization_gap", "diagnostic_label", "tuning_round"]


@query("trn9_candidate_run")
def trn9(spark, sf):
    return wealth_run(spark, sf).leaderboard().select(*_BOARD)


@query("trn10_tuning_rounds")
def trn10(spark, sf):
    return segment_run(spark, sf).tuning_history()


@query("trn11_blend")
def trn11(spark, sf):
    run = segment_run(spark, sf)
    return run.predictions("model_blend", split.VALIDATION).select("c_custkey", "fold", "y_true", "y_pred", F.round(F.col("probs")[1], 4).alias("p"))


@query("trn11_formula_blend", """
WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 50 AS a, l_extendedprice / 210000 AS b,
  CASE WHEN l_quantity > 24 THEN 1 ELSE 0 END AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN y = 1 THEN 'yes' ELSE 'no' END AS y_true,
  CASE WHEN a + b > 1 THEN 'yes' ELSE 'no' END AS y_pred, (a + b) / 2 AS p FROM m""")
def trn11_formula(spark, sf):
    """Two formula models over the lines, blended by the mean of their probabilities."""
    lines = table(spark, sf, "lineitem").withColumn("label", (F.col("l_quantity") > 24).cast("double"))
    members = []
    for p in (F.col("l_quantity") / 50, F.col("l_extendedprice") / 210000):
        yes = F.when(F.col("label") == 1, "yes").otherwise("no")
        members.append(lines.select(*LINE_KEYS, "label", (p > 0.5).cast("double").alias("prediction"), F.array(1 - p, p).alias("probs"),
                                    yes.alias("y_true"), F.when(p > 0.5, "yes").otherwise("no").alias("y_pred")))
    out = models.blend(members, LINE_KEYS, LINE_KEYS, ["no", "yes"])
    return out.select(*LINE_KEYS, "y_true", "y_pred", F.col("probs")[1].alias("p"))


@query("trn17_batch_scoring", "SELECT count(*) AS rows, count(*) AS scored FROM orders JOIN customer ON c_custkey = o_custkey")
def trn17(spark, sf):
    run = wealth_run(spark, sf)
    path = sinks.save_pipeline(run.pipeline(run.winner()["model_id"]), scratch_path(spark, "winner"))
    scored = sinks.load_pipeline(path).transform(wealth(spark, sf))
    return scored.agg(F.count("*").alias("rows"), F.count("prediction").alias("scored"))


@query("trn18_held_out_check")
def trn18(spark, sf):
    board = wealth_run(spark, sf).leaderboard()
    return board.filter("test_score IS NOT NULL").select("model_name", "is_winner", "is_naive_baseline", F.explode("test_metrics").alias("metric", "value"))


@query("trn19_run_history")
def trn19(spark, sf):
    base = scratch_path(spark, "runs")
    for run in (wealth_run(spark, sf), segment_run(spark, sf)):
        sinks.append_run(run.summary(), base, run.prepared.target)
    return sinks.list_runs(spark, base, "big").select("run_id", "dataset", "total_models", "winning_model", "validation_score", "test_score")


@query("evl1_full_evaluation")
def evl1(spark, sf):
    parts = evaluation.evaluate_run(wealth_run(spark, sf))
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("part"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("evl1_probability_tables")
def evl1_tables(spark, sf):
    return evaluation.evaluate_run(wealth_run(spark, sf))["thresholds"]



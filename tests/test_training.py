import random

import pytest
from conftest import by, one
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from colonnade.functions import cells, storage
from colonnade.operators import explain, models, split, target
from colonnade.plans import evaluation, explanation, training
from colonnade.settings import Settings
from colonnade.sources import sinks


@pytest.fixture(scope="module")
def churn(spark):
    rng = random.Random(11)
    rows = []
    for i in range(160):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, a, b, rng.choice("xy"), int(a + 0.3 * b + rng.gauss(0, 0.2) > 0)))
    return spark.createDataFrame(rows, "k int, f1 double, f2 double, tag string, label_col int")


@pytest.fixture(scope="module")
def run(churn):
    return training.train(churn, "label_col", ["k"], target.BINARY, run_id="run_1")


def test_leaderboard(run):
    rows = run.leaderboard().orderBy("rank").collect()
    assert len(rows) >= 4 and sum(r["is_winner"] for r in rows) == 1
    winner = next(r for r in rows if r["is_winner"])
    naive = next(r for r in rows if r["is_naive_baseline"])
    assert winner["validation_score"] > naive["validation_score"] and winner["test_score"] is not None
    assert naive["test_score"] is not None and winner["diagnostic_label"]
    others = [r for r in rows if not r["is_winner"] and not r["is_naive_baseline"]]
    assert all(r["test_score"] is None for r in others)
    assert {"accuracy", "f1", "roc_auc"} <= set(winner["validation_metrics"])
    s = one(run.summary())
    assert s["total_models"] == s["successful_models"] == len(rows) and s["failed_models"] == 0
    assert run.rows == {"train": 102, "validation": 26, "test": 32}


def test_failing_candidate_does_not_end_the_run(run):
    n = len(run.entries)
    broken = training.try_candidate(run, models.Candidate("Broken", "mllib", lambda: RandomForestClassifier(labelCol="nope")))
    assert broken["status"] == "failed" and broken["error"] and len(run.entries) == n + 1
    assert run.leaderboard().filter("status = 'failed'").first()["rank"] == n + 1
    run.entries.pop()


def test_winner_is_saved_and_scores_the_same(run, churn, spark):
    model_id = run.winner()["model_id"]
    path = sinks.save_pipeline(run.pipeline(model_id), storage.scratch_path(spark, "w"))
    again = sinks.load_pipeline(path).transform(churn).select("k", "prediction")
    mine = run.predictions(model_id, "train", "validation", "test").select("k", F.col("prediction").alias("p"))
    assert again.join(mine, "k").filter("prediction = p").count() == 160
    with pytest.raises(ValueError):
        models.check_lengths(mine.withColumn("y_pred", F.col("p")), 9600)


def test_evaluation_of_a_run(run):
    parts = evaluation.evaluate_run(run)
    assert parts["thresholds"].count() == 19 and one(parts["auc"])["roc_auc"] > 0.8
    assert parts["comparison"].count() == len(run.entries)
    assert {r["fold"] for r in parts["fold_metrics"].collect()} == {"train", "test"}


def test_explanations(run, spark):
    trees = next(e["model_id"] for e in run.entries if e["model_name"].startswith("RandomForest"))
    imp = explanation.importance(run, trees)
    assert sum(r["importance"] for r in imp.collect()) == pytest.approx(1.0, abs=1e-3)
    assert imp.orderBy(F.desc("importance")).first()["feature"] == "f1"
    linear = next(e["model_id"] for e in run.entries if e["model_name"].startswith("Logistic"))
    assert explanation.importance(run, linear).count() == 4
    naive = next(e["model_id"] for e in run.entries if e["is_naive_baseline"])
    assert explanation.importance(run, naive) is None
    perm = explanation.permutation(run, trees, 3).orderBy(F.desc("importance_mean")).collect()
    assert perm[0]["feature"] == "f1" and perm[0]["importance_mean"] > 0
    exact = explanation.attributions(run, trees)
    assert explain.global_attribution(exact).first()["feature"] == "f1" and exact.count() == 4 * run.rows["validation"]
    phi = explanation.attributions(run, trees, orders=3).persist()
    assert phi.select("k").distinct().count() == run.rows["validation"]
    assert explain.global_attribution(phi).first()["feature"] == "f1"
    points = explain.summary_points(phi, ["k"], 2)
    assert points.count() == 2 * run.rows["validation"]
    assert points.agg(F.min("normalized_value"), F.max("normalized_value")).first() == (0.0, 1.0)
    assert explain.dependence(points, "f1").count() == run.rows["validation"]
    local = explanation.local(run, trees, run.fold("test").orderBy("k").limit(2))
    sums = {r["k"]: r["s"] for r in explanation.attributions(run, trees, run.fold("test").orderBy("k").limit(2)).groupBy("k").agg(F.sum("phi").alias("s")).collect()}
    for r in local["prediction"].collect():  # a row's contributions lead from the base value to the probability of the last class
        last = r["probability"] if r["y_pred"] == run.labels[-1] else 1 - r["probability"]
        assert sums[r["k"]] + r["base_value"] == pytest.approx(last, abs=2e-4)
    assert local["prediction"].count() == 2 and local["contributions"].groupBy("k").count().first()["count"] == 4


def test_tuning_rounds_and_blend(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, rng.random(), rng.random(), rng.randint(0, 1)) for i in range(110)], "k int, a double, b double, y int")
    run = training.start_run(df, "y", ["k"], target.BINARY, run_id="r")
    for make in (lambda: models.NaiveBaseline(classes=2), lambda: models.linear_classifier(70, 2),
                 lambda: RandomForestClassifier(numTrees=5, maxDepth=3, seed=1)):
        training.try_candidate(run, models.Candidate("NaiveBaseline" if not run.entries else "m", "mllib", make, naive=not run.entries))
    history = training.Run.tuning_history
    training._note(run, 1, "first")
    assert not run.achieved()
    blend = training.add_blend(run)
    assert blend["status"] == "success" and len(run.members["model_blend"]) == 2
    soft = run.predictions("model_blend", "validation")
    parts = [run.predictions(m, "validation").select("k", F.col("probs")[1].alias(f"p{i}")) for i, m in enumerate(run.members["model_blend"])]
    joined = soft.join(parts[0], "k").join(parts[1], "k")
    assert joined.filter(F.abs(F.col("probs")[1] - (F.col("p0") + F.col("p1")) / 2) > 1e-9).count() == 0
    assert history(run).first()["round"] == 1
    hard = [p.withColumn("probs", F.lit(None).cast("array<double>")) for p in [run.predictions(m, "validation") for m in run.members["model_blend"]]]
    voted = models.blend(hard, ["k"], ["k", "fold"], run.labels)
    assert voted.filter("probs IS NOT NULL").count() == 0 and voted.count() == soft.count()


def test_rounds_run_to_the_blend_when_nothing_reaches_the_target(spark, monkeypatch):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, rng.random(), rng.random(), rng.randint(0, 1)) for i in range(110)], "k int, a double, b double, y int")
    run = training.start_run(df, "y", ["k"], target.BINARY, run_id="r")
    training.try_candidate(run, models.Candidate("lr", "mllib", lambda: models.linear_classifier(70, 2)))
    quick = [models.Candidate("t", "mllib_tuned", lambda: RandomForestClassifier(numTrees=3, seed=2), round=2, stage="tuned")]
    monkeypatch.setattr(models, "second_round", lambda *a: quick)
    h = training.tune(run).collect()
    assert [r["round"] for r in h] == [1, 2, 3] and h[-1]["total_models"] == 3


def test_search_stops_on_the_clock(run):
    n = len(run.entries)
    assert training.search(run, {"f": (RandomForestClassifier, {"numTrees": [2, 3]})}, seconds=-1) == []
    tried = training.search(run, {"f": (RandomForestClassifier, {"numTrees": [2], "seed": [1]})}, seconds=60)
    assert len(tried) == 1 and tried[0]["status"] == "success"
    del run.entries[n:]


def test_search_halves_and_lists_everything(spark):
    rng = random.Random(8)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(400)]
    df = spark.createDataFrame([(k, a, b, int(a * b > 0)) for k, a, b in rows], "k int, a double, b double, y int")
    run = training.start_run(df, "y", ["k"], target.BINARY, run_id="r", settings=Settings(search_rows=50))
    grid = {"numTrees": [3, 9], "maxDepth": [1, 4], "seed": [1]}
    tried = training.search(run, {"f": (RandomForestClassifier, grid), "bad": (RandomForestClassifier, {"maxDepth": [-1]})}, seconds=600)
    status = [e["status"] for e in run.entries]
    assert len(run.entries) == 5 and status.count("eliminated") == 3 and status.count("success") == 2 and len(tried) == 2
    assert any("maxDepth=4" in e["model_name"] for e in tried) and run.entries[4]["status"] == "eliminated"
    assert [r["status"] for r in run.leaderboard().orderBy("rank").collect()][:2] == ["success"] * 2


def test_a_run_without_time_fits_the_first_round(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, rng.random(), rng.randint(0, 1)) for i in range(120)], "k int, a double, y int")
    clock = training.TIME_LIMITS["quick"]
    training.TIME_LIMITS["quick"] = -1
    try:
        run = training.train(df, "y", ["k"], target.BINARY, run_id="r")
    finally:
        training.TIME_LIMITS["quick"] = clock
    assert [e["status"] for e in run.entries][:4] == ["success"] * 4
    assert {e["status"] for e in run.entries[4:] if e["model_id"] != "model_blend"} == {"not_tried"}
    assert run.winner()["test_score"] is not None


def test_regression_run(spark):
    rng = random.Random(7)
    rows = [(i, rng.uniform(500, 3000), rng.randint(1, 5), rng.choice("NSEW")) for i in range(120)]
    rows = [(*r, 150 * r[1] + 20000 * r[2] + rng.gauss(0, 500)) for r in rows]
    df = spark.createDataFrame(rows, "k int, sqft double, bedrooms int, area string, price double")
    run = training.start_run(df, "price", ["k"], target.REGRESSION, run_id="r")
    assert run.primary_metric == "rmse" and run.prepared.strategy == split.RANDOM
    for c in (models.Candidate("NaiveBaseline", "naive", lambda: models.NaiveBaseline(classes=0), naive=True),
              models.Candidate("LinearRegression", "mllib", lambda: LinearRegression(solver="normal"))):
        training.try_candidate(run, c)
    training.check_on_test(run)
    w = run.winner()
    assert w["model_name"] == "LinearRegression" and w["test_metrics"]["r2"] > 0.99 and run.achieved()
    parts = evaluation.evaluate_run(run)
    assert parts["histogram"].count() == 20 and one(parts["metrics"])["r2"] > 0.99
    phi = explanation.attributions(run, w["model_id"], orders=2)
    assert explain.global_attribution(phi).first()["feature"] in ("sqft", "bedrooms")


def test_multiclass_boosting_and_auc(spark):
    rows = [(i, float(i % 30), ["lo", "mid", "top"][(i % 30) // 10]) for i in range(150)]
    df = spark.createDataFrame(rows, "k int, x double, tier string")
    run = training.start_run(df, "tier", ["k"], target.MULTICLASS, run_id="r")
    assert run.primary_metric == "f1_macro" and run.labels == ["lo", "mid", "top"]
    e = training.try_candidate(run, models.Candidate("gbt", "mllib", lambda: models.boosted_classifier(3, maxIter=3, maxDepth=2, seed=1)))
    assert e["status"] == "success" and e["validation_metrics"]["f1_macro"] > 0.9 and e["validation_metrics"]["roc_auc"] > 0.9
    probs = run.predictions("model_01", "validation").select(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert probs.filter("abs(s - 1) > 1e-9").count() == 0
    rows = run.fold("test").orderBy("k").limit(3)
    phi = explanation.attributions(run, "model_01", rows, orders=2)
    assert phi.count() == 3 and phi.filter("phi < 0").count() == 0
    local = explanation.local(run, "model_01", rows)
    assert local["contributions"].count() == 3 and local["prediction"].count() == 3


def test_exact_shapley_of_a_linear_model(spark):
    """With an additive model every feature order gives the same credit."""
    from pyspark.ml.feature import VectorAssembler

    data = spark.createDataFrame([(i, float(i), float(i * i % 7), 3.0 * i - 2.0 * (i * i % 7)) for i in range(40)], "k int, a double, b double, label double")
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(data)
    model = LinearRegression(solver="normal").fit(rows)
    phi = explain.sampled_shapley(rows.limit(5), [[10.0, 2.0]], ["k"], model.transform, F.col("prediction"), [("a", "a"), ("b", "b")], 3)
    got = by(phi, "k", "feature")
    assert got[(3, "a")]["phi"] == pytest.approx(3.0 * (3 - 10)) and got[(3, "b")]["phi"] == pytest.approx(-2.0 * (9 % 7 - 2))


def test_donors_are_one_cycle_in_hash_order(spark):
    from dataclasses import replace

    df = spark.range(500).selectExpr("id AS k", "array(cast(id AS double)) AS x").repartition(3)
    order = [r["k"] for r in df.select("k", cells.hash_order(["k"], "s").alias("h")).orderBy("h").collect()]
    want = {k: float(order[(i + 1) % 500]) for i, k in enumerate(order)}
    for size in (250_000, 40, 1):
        out = explain.with_donor(df, ["k"], "x", "s", 500, replace(Settings(), range_rows=size)).select("k", F.col("donor")[0].alias("d"))
        assert {r["k"]: r["d"] for r in out.collect()} == want
    assert explain.with_donor(df.limit(0), ["k"], "x", "s", 0).collect() == []


@pytest.mark.parametrize("classification", [True, False])
def test_permutation_importance_by_hand(spark, classification):
    """Every score recomputed from the donors; one-hot features together by column, unused ones lose nothing."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = random.Random(3)
    rows = [(i, [rng.random(), float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2), 5.0]) for i in range(200)]
    f = lambda x: float(x[0] + x[1] - 2 * x[3] > 0) if classification else x[0] + x[1] - 2 * x[3]
    rows = [(k, x, f(x) if k % 10 else 1.0) for k, x in rows]
    df = spark.createDataFrame(rows, "k int, x array<double>, label double").withColumn("features", array_to_vector("x")).drop("x")
    v = vector_to_array("features")
    raw = v[0] + v[1] - 2 * v[3]
    score = lambda d: d.withColumn("prediction", (raw > 0).cast("double") if classification else raw)
    lineage = [("a", "a"), ("c_0", "c"), ("c_1", "c"), ("c_2", "c"), ("d", "d")]
    y, x = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])

    def quality(z):
        p = np.array([f(row) for row in z])
        return (p == y).mean() if classification else 1 - ((p - y) ** 2).mean() / y.var()

    donors = []
    for r in range(3):
        base = df.select("k", v.alias("x"))
        got = {q["k"]: q["donor"] for q in explain.with_donor(base, ["k"], "x", f"42-repeat-{r}", 200).collect()}
        donors.append(np.array([got[k] for k, *_ in rows]))
    for by_column, parts in ((False, {"a": [0], "c_0": [1], "c_1": [2], "c_2": [3], "d": [4]}), (True, {"a": [0], "c": [1, 2, 3], "d": [4]})):
        out = by(explain.permutation_importance(df, ["k"], score, lineage, classification, 3, by_column=by_column), "feature")
        assert set(out) == set(parts)
        for name, at in parts.items():
            lost = []
            for donor in donors:
                z = x.copy()
                z[:, at] = donor[:, at]
                lost.append(quality(x) - quality(z))
            assert out[name]["importance_mean"] == pytest.approx(np.mean(lost), abs=6e-5) and out[name]["importance_std"] == pytest.approx(np.std(lost), abs=6e-5)


def test_unsuitable_table_is_refused(spark):
    df = spark.createDataFrame([(i, 1.0, 1) for i in range(5)], "k int, a double, y int")
    with pytest.raises(training.TrainingError):
        training.start_run(df, "y", ["k"], target.BINARY)
    assert Settings.from_env().seed == 42


def test_numbered_classes_and_repeated_keys(spark):
    rows = [(i, float(i % 20), 9 if i % 20 < 10 else 10) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, x double, grade int")
    assert training.start_run(df, "grade", ["k"], target.BINARY, run_id="r").labels == ["9", "10"]
    with pytest.raises(training.TrainingError, match="60 rows repeat"):
        training.start_run(df.unionByName(df), "grade", ["k"], target.BINARY, run_id="r")


def test_unusable_targets_and_untried_combinations(spark):
    rows = [(i, float(i), float("inf") if i % 10 == 0 else 2.0 * i) for i in range(50)]
    run = training.start_run(spark.createDataFrame(rows, "k int, x double, y double"), "y", ["k"], target.REGRESSION, run_id="r")
    assert sum(run.rows.values()) == 45 and run.table.filter("label = 0").count() == 0
    training.search(run, models.search_grids(target.REGRESSION), 0.0)
    assert [e["status"] for e in run.entries] == ["not_tried"] * 4

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from colonnade.operators import forest, target, tree_attribution
from colonnade.operators.forest import RandomForest, RandomForestModel
from colonnade.plans import evaluation, explanation, training
from colonnade.settings import Settings


def rows_of(n, classes, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 12, n), rng.integers(0, 2, n), rng.normal(size=n).round(2)], axis=1).astype(float)
    return x, ((x[:, 0] // 3 + 2 * x[:, 1] + (x[:, 2] > 0.5)) % classes).astype(int)


def frame(spark, x, label, parts=3):
    rows = [(i, v.tolist(), float(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    df = spark.createDataFrame(rows, "k int, x array<double>, label double").repartition(parts)
    return df.select("k", array_to_vector("x").alias("features"), "label")


def test_few_rows_take_mllib(spark):
    df = frame(spark, *rows_of(50, 2))
    own = RandomForest(numTrees=3, maxDepth=3, seed=5, limit=50).fit(df)
    assert isinstance(own, RandomForestClassificationModel)
    assert own.toDebugString.split("\n", 1)[1] == RandomForestClassifier(numTrees=3, maxDepth=3, seed=5).fit(df).toDebugString.split("\n", 1)[1]
    assert isinstance(RandomForest(numTrees=3, maxDepth=3, seed=5, limit=49).fit(df), RandomForestModel)


@pytest.mark.parametrize("classes", [2, 3])
def test_forest_learns_and_counts_whole(spark, classes, tmp_path):
    x, label = rows_of(1500, classes)
    df = frame(spark, x, label)
    model = RandomForest(classes=classes, numTrees=8, maxDepth=7, seed=1, featureSubsetStrategy="all").fit(df)
    for t in model.value("trees"):
        counts, left = np.array(t["counts"]), np.array(t["left"])
        cut = np.flatnonzero(left >= 0)
        assert 1300 < counts[0].sum() < 1700  # draws of all rows
        assert (counts[cut] == counts[left[cut]] + counts[left[cut] + 1]).all()
    out = model.transform(df).select("k", "label", "prediction", vector_to_array("probability").alias("p")).collect()
    assert np.mean([r["label"] == r["prediction"] for r in out]) > 0.95
    assert all(sum(r["p"]) == pytest.approx(1.0) and r["prediction"] == float(np.argmax(r["p"])) for r in out)
    assert sum(model.featureImportances) == pytest.approx(1.0)
    # walked one by one, the trees as saved say the same
    model.write().save(str(tmp_path / "m"))
    trees = RandomForestModel.load(str(tmp_path / "m")).value("trees")
    for r in out[:40]:
        votes = np.zeros(classes)
        for t in trees:
            at = 0
            while t["feature"][at] >= 0:
                at = t["left"][at] + int(x[r["k"]][t["feature"][at]] > t["threshold"][at])
            votes += np.array(t["counts"][at]) / sum(t["counts"][at])
        assert r["p"] == pytest.approx(list(votes / len(trees)))
    # and exact attributions add to them
    nodes = tree_attribution.node_table(spark, model)
    base = tree_attribution.base_values(tree_attribution.trees_of(nodes))
    some = df.filter("k < 20")
    phi = tree_attribution.tree_attributions(some, ["k"], nodes, [(c, c) for c in "abc"])
    sums = {(r["k"], r["output"]): r["s"] for r in phi.groupBy("k", "output").agg(F.sum("phi").alias("s")).collect()}
    for r in out:
        if r["k"] < 20:
            assert [sums[r["k"], i] + base[i] for i in range(classes)] == pytest.approx(r["p"])


def test_trees_do_not_depend_on_partitions_or_passes(spark, monkeypatch):
    x, label = rows_of(700, 2)
    fit = lambda parts: RandomForest(numTrees=5, maxDepth=5, seed=9, minInstancesPerNode=2, subsamplingRate=0.7).fit(frame(spark, x, label, parts)).value("trees")
    whole = fit(1)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 64)
    monkeypatch.setattr(forest, "CELLS", 600)
    monkeypatch.setattr(forest, "BLOB", 300)
    assert fit(4) == whole
    assert len({str(t) for t in whole}) == 5


def test_best_cut_is_the_one_of_most_gain():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 6, (20, 2, 5, 3))
    counts[:, 1] = 0
    counts[:, 1, 0] = counts[:, 0].sum(axis=1)  # a feature of one value cannot be cut
    gini = lambda c: 1 - ((c / max(c.sum(), 1)) ** 2).sum()
    for node, best in zip(counts[:, 0], forest.best_cuts(counts, 3)):
        gains = []
        for b in range(4):
            left, right = node[:b + 1].sum(axis=0), node[b + 1:].sum(axis=0)
            if left.sum() >= 3 and right.sum() >= 3:
                gains.append((gini(node.sum(axis=0)) - (left.sum() * gini(left) + right.sum() * gini(right)) / node.sum(), -b))
        gain, b = max(gains)
        assert best[0] == 0 and best[1] == -b and best[2] == pytest.approx(gain)
        assert best[3:6].tolist() == node.sum(axis=0).tolist() and best[6:].tolist() == node[:1 - b].sum(axis=0).tolist()


def test_a_run_takes_the_large_form(spark):
    rng = np.random.default_rng(11)
    a, b = rng.normal(size=(2, 240))
    df = spark.createDataFrame([(i, float(p), float(q), int(p + 0.3 * q > 0)) for i, (p, q) in enumerate(zip(a, b))], "k int, f1 double, f2 double, y int")
    run = training.train(df, "y", ["k"], target.BINARY, grids={}, settings=Settings(forest_rows=10))
    entry = next(e for e in run.entries if e["model_name"] == "RandomForestClassifier")
    assert entry["status"] == "success" and isinstance(run.models[entry["model_id"]], RandomForestModel)
    assert entry["validation_score"] > 0.8
    assert explanation.importance(run, entry["model_id"]).orderBy(F.desc("importance")).first()["feature"] == "f1"
    assert explanation.attributions(run, entry["model_id"]).count() == run.rows["validation"] * 2
    assert explanation.permutation(run, entry["model_id"], 2).count() == 2
    assert evaluation.evaluate_run(run)["thresholds"].count() == 19


def test_scores_are_looked_up_by_bins_in_arrow_batches(spark):
    x, label = rows_of(400, 2)
    model = RandomForest(numTrees=6, maxDepth=6, seed=2, featureSubsetStrategy="all").fit(frame(spark, x, label))
    edges = model._edges()
    odd = [[float("nan"), 1.0, 0.0], [float("inf"), float("-inf"), -0.0], *[[float(v) for v in (e, edges[1][0], edges[2][0])] for e in edges[0]]]
    bins = forest._bins(np.array(odd), edges).reshape(3, -1)
    for i, e in enumerate(edges):
        for at, threshold in enumerate(e):  # above a threshold is above its place
            assert (bins[i] > at).tolist() == [v[i] > threshold for v in odd]
    out = model.transform(spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "k int, x array<double>").select("k", array_to_vector("x").alias("features")))
    for r in out.select("k", vector_to_array("rawPrediction").alias("raw")).collect():
        said = np.zeros(2)
        for t in model.value("trees"):
            at = 0
            while t["feature"][at] >= 0:
                at = t["left"][at] + int(odd[r["k"]][t["feature"][at]] > t["threshold"][at])
            said += np.array(t["counts"][at]) / sum(t["counts"][at])
        assert r["raw"] == said.tolist()

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from colonnade.operators import boosting, tree_attribution
from colonnade.operators.boosting import SoftmaxBoostedTrees, SoftmaxBoostedTreesModel


def rows_of(n, classes, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 12, n), rng.integers(0, 2, n), rng.normal(size=n).round(1)], axis=1).astype(float)
    label = ((x[:, 0] // 3 + 2 * x[:, 1] + (x[:, 2] > 0.5)) % classes).astype(int)
    return x, label


def frame(spark, x, label, parts=3):
    rows = [(i, v.tolist(), float(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    df = spark.createDataFrame(rows, "k int, x array<double>, label double").repartition(parts)
    return df.select("k", array_to_vector("x").alias("features"), "label")


def brute(x, label, classes, rounds, depth, step, bins, least, penalty=1.0):
    """Margins of the training rows by a plain recursion over whole arrays; sums in the same unit."""
    n, unit = len(x), boosting.UNIT
    cuts = [sorted({np.sort(x[:, f])[max(0, int(np.ceil(i / bins * n)) - 1)] for i in range(bins)}) for f in range(x.shape[1])]
    margins = np.tile(np.log(np.bincount(label, minlength=classes) / n), (n, 1))

    def grow(rows, g, h, level, out):
        G, H = g[rows].sum() / unit, h[rows].sum() / unit
        best = None
        if level < depth:
            for f, places in enumerate(cuts):
                for c in places:
                    left = rows[x[rows, f] <= c]
                    if least <= len(left) <= len(rows) - least:
                        gl, hl = g[left].sum() / unit, h[left].sum() / unit
                        gain = gl * gl / (hl + penalty) + (G - gl) ** 2 / (H - hl + penalty) - G * G / (H + penalty)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                            best = (gain, f, c)
        if best is None:
            out[rows] = -step * G / (H + penalty)
            return
        right = x[rows, best[1]] > best[2]
        grow(rows[~right], g, h, level + 1, out)
        grow(rows[right], g, h, level + 1, out)

    for _ in range(rounds):
        p, add = boosting.softmax(margins), np.zeros_like(margins)
        for k in range(classes):
            g, h = np.rint((p[:, k] - (label == k)) * unit), np.rint(p[:, k] * (1 - p[:, k]) * unit)
            grow(np.arange(n), g, h, 0, add[:, k])
        margins += add
    return margins


@pytest.mark.parametrize("classes, least", [(3, 1), (4, 7)])
def test_margins_match_a_plain_recursion(spark, classes, least, monkeypatch):
    monkeypatch.setattr(boosting, "STORE_EVERY", 2)
    x, label = rows_of(240, classes)
    model = SoftmaxBoostedTrees(classes=classes, maxIter=4, maxDepth=3, stepSize=0.3, maxBins=16, minInstancesPerNode=least).fit(frame(spark, x, label))
    got = model.transform(frame(spark, x, label)).orderBy("k").select(vector_to_array("rawPrediction").alias("m"), vector_to_array("probability").alias("p"), "prediction").collect()
    want = brute(x, label, classes, 4, 3, 0.3, 16, least)
    assert np.allclose([r["m"] for r in got], want, atol=1e-6)
    assert np.allclose([r["p"] for r in got], boosting.softmax(want), atol=1e-6)
    assert [r["prediction"] for r in got] == want.argmax(axis=1).tolist()


def test_same_trees_for_any_partitioning_and_class_blocks(spark, monkeypatch):
    x, label = rows_of(150, 3)
    fit = lambda parts: SoftmaxBoostedTrees(classes=3, maxIter=2, maxDepth=3).fit(frame(spark, x, label, parts)).value("trees")
    one = fit(1)
    assert one == fit(7)
    monkeypatch.setattr(boosting, "CELLS", 1)
    monkeypatch.setattr(boosting, "ROW_CELLS", 16)
    assert one == fit(2)


def test_a_level_takes_one_pass_whatever_the_number_of_classes(spark, monkeypatch):
    calls, real = [], boosting.best_cuts
    monkeypatch.setattr(boosting, "best_cuts", lambda *a: calls.append(1) or real(*a))
    for classes in (3, 9):
        calls.clear()
        x, label = rows_of(200, classes)
        SoftmaxBoostedTrees(classes=classes, maxIter=2, maxDepth=2).fit(frame(spark, x, label))
        assert len(calls) == 4


def test_reload_importances_and_exact_attributions(spark, tmp_path):
    x, label = rows_of(120, 3)
    df = frame(spark, x, label)
    model = SoftmaxBoostedTrees(classes=3, maxIter=3, maxDepth=3, stepSize=0.3).fit(df)
    model.save(str(tmp_path / "m"))
    again = SoftmaxBoostedTreesModel.load(str(tmp_path / "m"))
    table = lambda m: [tuple(r) for r in m.transform(df).orderBy("k").select("k", "rawPrediction", "probability", "prediction").collect()]
    assert table(model) == table(again)
    assert abs(sum(model.featureImportances.toArray()) - 1) < 1e-9

    nodes = tree_attribution.node_table(spark, model)
    base = tree_attribution.base_values(tree_attribution.trees_of(nodes))
    lineage = [(f"f{i}", f"f{i}") for i in range(3)]
    phi = tree_attribution.tree_attributions(df, ["k"], nodes, lineage).groupBy("k", "output").agg(F.sum("phi").alias("s")).collect()
    margins = {r["k"]: r["m"] for r in model.transform(df).select("k", vector_to_array("rawPrediction").alias("m")).collect()}
    assert len(phi) == 360 and all(abs(r["s"] + base[r["output"]] - margins[r["k"]][r["output"]]) < 1e-9 for r in phi)


def test_edges(spark):
    x, label = rows_of(40, 3)
    flat = SoftmaxBoostedTrees(classes=4, maxIter=3).fit(frame(spark, np.zeros_like(x), label))  # no cut anywhere, a class without rows
    assert flat.transform(frame(spark, x, label)).filter("prediction = 3").count() == 0
    one = SoftmaxBoostedTrees(classes=3, maxIter=2).fit(frame(spark, x, np.ones(40, int)))
    assert [r[0] for r in one.transform(frame(spark, x, label)).select("prediction").distinct().collect()] == [1.0]
    assert one.transform(frame(spark, x, label).limit(0)).count() == 0
    with pytest.raises(ValueError, match="below 2"):
        SoftmaxBoostedTrees(classes=2).fit(frame(spark, x, label))
    with pytest.raises(ValueError, match="no rows"):
        SoftmaxBoostedTrees(classes=2).fit(frame(spark, x, label).limit(0))

"""Tree attributions against enumeration of all coalitions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from colonnade.operators import tree_attribution as ta


def expectation(nodes, x, known, at):
    """The tree's output where unknown features follow both branches by cover."""
    n = nodes[at]
    if n["feature"] < 0:
        return n["weight"] * np.array(n["value"])
    f = n["feature"]
    if f in known:
        left = x[f] in n["categories"] if n["categories"] is not None else x[f] <= n["threshold"]
        return expectation(nodes, x, known, n["left"] if left else n["right"])
    return sum(nodes[c]["cover"] / n["cover"] * expectation(nodes, x, known, c) for c in (n["left"], n["right"]))


def enumerated(nodes, x, width):
    out = []
    for i in range(width):
        others = [j for j in range(width) if j != i]
        total = 0.0
        for size in range(width):
            share = math.factorial(size) * math.factorial(width - size - 1) / math.factorial(width)
            for s in itertools.combinations(others, size):
                total = total + share * (expectation(nodes, x, {*s, i}, 0) - expectation(nodes, x, set(s), 0))
        out.append(total)
    return np.array(out)


def grown(rng, width, depth):
    """A random tree with repeated features on its paths and both kinds of splits."""
    nodes = {}

    def grow(level, cover):
        at = len(nodes)
        nodes[at] = n = {"tree": 0, "weight": 0.7, "id": at, "feature": -1, "threshold": None, "categories": None, "left": -1, "right": -1, "cover": cover, "value": [rng.uniform(-1, 1), rng.random()]}
        if level < depth and cover > 2 and rng.random() < 0.9:
            n["feature"] = rng.randrange(width)
            if rng.random() < 0.3:
                n["categories"] = rng.sample([0.0, 1.0, 2.0], 2)
            else:
                n["threshold"] = rng.choice([0.0, 1.0, 0.5])
            part = rng.randint(1, int(cover) - 1)
            n["left"], n["right"] = grow(level + 1, float(part)), grow(level + 1, cover - part)
        return at

    grow(0, 500.0)
    return nodes


@pytest.mark.parametrize("seed", range(12))
def test_equals_enumeration(seed):
    rng = random.Random(seed)
    width = 5
    nodes = grown(rng, width, 7)
    tree = ta.tree_of(list(nodes.values()))
    x = np.array([[float(rng.randrange(3)) for _ in range(width)] for _ in range(6)])
    out = np.zeros((6, width, 2))
    ta.tree_values(tree, x, out)
    for row, phi in zip(x, out, strict=True):
        assert np.allclose(phi, enumerated(nodes, row, width))
        assert np.allclose(phi.sum(0) + tree.base, expectation(nodes, row, set(range(width)), 0))


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [(i, rng.random(), float(rng.randrange(4)), rng.random(), float(rng.randrange(3))) for i in range(300)]
    data = [(*r, float((r[1] > 0.5) + (r[2] in (1.0, 3.0)) + (r[4] == 2.0 and r[3] > 0.3) > 1)) for r in data]
    df = spark.createDataFrame(data, "k int, a double, b double, c double, d double, label double")
    raw = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="raw").transform(df)
    return VectorIndexer(inputCol="raw", outputCol="features", maxCategories=4).fit(raw).transform(raw).select("k", "features", "label")


LINEAGE = [("a", "a"), ("b=1", "b"), ("c", "c"), ("d", "d")]


@pytest.mark.parametrize("estimator, output", [
    (lambda: RandomForestClassifier(numTrees=7, maxDepth=4, seed=1), lambda: vector_to_array("probability")),
    (lambda: GBTClassifier(maxIter=4, maxDepth=3, seed=1), lambda: F.array(vector_to_array("rawPrediction")[1])),
    (lambda: RandomForestRegressor(numTrees=4, maxDepth=5, seed=1), lambda: F.array("prediction")),
    (lambda: DecisionTreeRegressor(maxDepth=4), lambda: F.array("prediction")),
])
def test_values_sum_to_the_output(spark, rows, estimator, output):
    model = estimator().fit(rows)
    nodes = ta.node_table(spark, model).persist()
    base = ta.base_values(ta.trees_of(nodes))
    phi = ta.tree_attributions(rows, ["k"], nodes, LINEAGE)
    assert phi.count() == 300 * 4 * len(base) and nodes.filter("categories IS NOT NULL").count() > 0
    sums = {(r["k"], r["output"]): r["s"] for r in phi.groupBy("k", "output").agg(F.sum("phi").alias("s")).collect()}
    for r in model.transform(rows).select("k", output().alias("v")).collect():
        for i, v in enumerate(r["v"]):
            assert sums[(r["k"], i)] + base[i] == pytest.approx(v, abs=1e-9)


def test_one_output_and_stumps(spark, rows):
    model = RandomForestClassifier(numTrees=2, maxDepth=0, seed=1).fit(rows)
    phi = ta.tree_attributions(rows.limit(3), ["k"], ta.node_table(spark, model), LINEAGE, [1])
    assert {(r["output"], r["phi"]) for r in phi.collect()} == {(1, 0.0)}
    assert ta.tree_attributions(rows.limit(0), ["k"], ta.node_table(spark, model), LINEAGE).collect() == []

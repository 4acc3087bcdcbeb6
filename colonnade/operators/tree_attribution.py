"""Exact attributions of tree ensembles, weighted by the training rows that reached each node.

A leaf is reached if all splits on its path hold. A row's features that are left out of a coalition follow both branches
in the shares of the training rows, so a leaf's weight is a product over the path's distinct features: 1 or 0 for a
feature that is in (do the row's values pass all of its splits on the path?), the product of the shares for one that is
out. The Shapley value of feature i is the integral over t from 0 to 1 of

    leaf value * (passes_i - share_i) * product over the others j of (passes_j * t + share_j * (1 - t)),

a polynomial in t of the path's number of features less one, so Gauss-Legendre quadrature with half as many points is
exact. Values sum to the output less the base value, the output's mean under the shares.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    GBTClassificationModel,
    RandomForestClassificationModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colonnade.functions.storage import scratch_path
from colonnade.operators.boosting import SoftmaxBoostedTreesModel
from colonnade.operators.forest import RandomForestModel

FORESTS = (RandomForestClassificationModel, RandomForestRegressionModel)
BOOSTED = (GBTClassificationModel, GBTRegressionModel)
SINGLE = (DecisionTreeClassificationModel, DecisionTreeRegressionModel)
CLASSIFIERS = (RandomForestClassificationModel, DecisionTreeClassificationModel)
OWN = (SoftmaxBoostedTreesModel, RandomForestModel)  # they give their nodes themselves
PER_CLASS = (*CLASSIFIERS, *OWN)  # a value for each class: its share, or its margin
ROWS = 64  # rows scored at once

NODES = ("tree int, weight double, id int, feature int, threshold double, categories array<double>, left int, right int, "
         "cover double, value array<double>")


def is_tree_model(model) -> bool:
    return isinstance(model, FORESTS + BOOSTED + SINGLE + PER_CLASS)


def node_table(spark, model) -> DataFrame:
    """A fitted model's nodes, one row each: feature -1 for leaves; threshold, or the categories that go left.

    Values are a class's share or margin for each class, or one number. MLlib's are read from the model as it is saved.
    """
    if isinstance(model, OWN):
        return spark.createDataFrame(model.node_rows(), NODES)
    path = scratch_path(spark, "model")
    model.save(path)
    saved = spark.read.parquet(f"{path}/data")
    node = F.col("nodeData") if "nodeData" in saved.columns else F.struct("*")
    weights = [float(w) for w in model.treeWeights] if hasattr(model, "treeWeights") else [1.0]
    if isinstance(model, FORESTS):
        weights = [1.0 / len(weights)] * len(weights)
    flat = saved.select((F.col("treeID") if "treeID" in saved.columns else F.lit(0)).cast("int").alias("tree"), node.alias("n"))
    stats, leaf = F.col("n.impurityStats"), F.col("n.leftChild") < 0
    total = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    shares = F.transform(stats, lambda x: x / total) if isinstance(model, CLASSIFIERS) else F.array("n.prediction")
    continuous = F.col("n.split.numCategories") < 0
    return flat.select(
        "tree", F.element_at(F.array(*map(F.lit, weights)), F.col("tree") + 1).alias("weight"), F.col("n.id").alias("id"),
        F.when(leaf, -1).otherwise(F.col("n.split.featureIndex")).cast("int").alias("feature"),
        F.when(~leaf & continuous, F.get("n.split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(~leaf & ~continuous, F.col("n.split.leftCategoriesOrThreshold")).alias("categories"),
        F.col("n.leftChild").cast("int").alias("left"), F.col("n.rightChild").cast("int").alias("right"),
        (total if isinstance(model, CLASSIFIERS) else stats[0]).alias("cover"), shares.alias("value"))


class Tree(NamedTuple):
    """Arrays of a tree: its splits, and its paths' (leaf, feature) pairs, each with the steps that belong to it."""

    feature: np.ndarray
    threshold: np.ndarray
    categories: list
    step_split: np.ndarray
    step_left: np.ndarray
    pair_step: np.ndarray  # first step of each pair
    pair_feature: np.ndarray
    pair_share: np.ndarray
    pair_leaf: np.ndarray
    leaf_pair: np.ndarray  # first pair of each leaf
    value: np.ndarray  # of each leaf, a row
    base: np.ndarray


def tree_of(nodes: list) -> Tree:
    """The arrays of one tree from its rows (NODES); a split's children are found by id, the root is nobody's child."""
    own = {n["id"]: n for n in nodes}
    children = {c for n in nodes if n["feature"] >= 0 for c in (n["left"], n["right"])}
    splits = {n["id"]: i for i, n in enumerate(n for n in nodes if n["feature"] >= 0)}
    inner = [own[i] for i in splits]
    weight = nodes[0]["weight"]
    steps, pairs, leaves, base = [], [], [], 0.0
    stack = [(next(i for i in own if i not in children), ())]
    while stack:
        at, path = stack.pop()
        n = own[at]
        if n["feature"] >= 0:
            for child, left in ((n["left"], True), (n["right"], False)):
                stack.append((child, (*path, (n["feature"], splits[at], left, own[child]["cover"] / n["cover"]))))
            continue
        value = weight * np.array(n["value"], float)
        base = base + value * np.prod([share for *_, share in path])
        if path:
            leaves.append((len(pairs), value))
            for f in sorted({f for f, *_ in path}):
                mine = [p for p in path if p[0] == f]
                pairs.append((len(steps), f, np.prod([p[3] for p in mine]), len(leaves) - 1))
                steps += [(p[1], p[2]) for p in mine]
    column = lambda rows, i, kind: np.array([r[i] for r in rows], kind)
    return Tree(np.array([n["feature"] for n in inner], np.int64), np.array([np.nan if n["threshold"] is None else n["threshold"] for n in inner]),
                [None if n["categories"] is None else np.array(n["categories"]) for n in inner], column(steps, 0, np.int64), column(steps, 1, bool),
                column(pairs, 0, np.int64), column(pairs, 1, np.int64), column(pairs, 2, float), column(pairs, 3, np.int64), column(leaves, 0, np.int64),
                np.array([v for _, v in leaves]), np.atleast_1d(base))


def trees_of(nodes: DataFrame) -> list[Tree]:
    """All trees of a node table; a fitted ensemble is bounded by its number of trees and their depth."""
    by_tree: dict[int, list] = {}
    for n in nodes.collect():
        by_tree.setdefault(n["tree"], []).append(n.asDict())
    return [tree_of(by_tree[t]) for t in sorted(by_tree)]


def base_values(trees: list[Tree]) -> np.ndarray:
    return np.sum([t.base for t in trees], axis=0)


def tree_values(tree: Tree, x: np.ndarray, out: np.ndarray) -> None:
    """Adds the tree's attributions of the rows x to out: rows, features, outputs."""
    if not len(tree.pair_leaf):
        return
    left = x[:, tree.feature] <= tree.threshold
    for i, kinds in enumerate(tree.categories):
        if kinds is not None:
            left[:, i] = np.isin(x[:, tree.feature[i]], kinds)
    passes = np.logical_and.reduceat(left[:, tree.step_split] == tree.step_left, tree.pair_step, axis=1).astype(float)
    widest = int(np.diff(np.append(tree.leaf_pair, len(tree.pair_leaf))).max())
    points, weights = np.polynomial.legendre.leggauss((widest + 1) // 2)
    others = np.zeros_like(passes)
    for t, w in zip((points + 1) / 2, weights / 2, strict=True):
        term = passes * t + tree.pair_share * (1 - t)
        others += w * np.multiply.reduceat(term, tree.leaf_pair, axis=1)[:, tree.pair_leaf] / term
    credit = (passes - tree.pair_share) * others
    order = np.argsort(tree.pair_feature, kind="stable")
    features, first = np.unique(tree.pair_feature[order], return_index=True)
    for k in range(out.shape[2]):
        out[:, features, k] += np.add.reduceat((credit * tree.value[tree.pair_leaf, k])[:, order], first, axis=1)


def tree_attributions(rows: DataFrame, keys: list[str], nodes: DataFrame, lineage: list[tuple[str, str]], outputs: list[int] | None = None) -> DataFrame:
    """Long table (keys, output, feature, original_feature, feature_value, phi): exact attributions per row and output.

    `rows` has the keys and `features`; `outputs` are the places of the values to explain, all by default. The trees
    travel to the tasks; rows are neither shuffled nor collected.
    """
    trees = trees_of(nodes)
    width, count = len(lineage), len(base_values(trees))
    wanted = list(range(count)) if outputs is None else outputs
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    base = rows.select(*keys, vector_to_array("features").alias("x"))
    schema = StructType([*base.schema.fields, *StructType.fromDDL("phi array<double>").fields])
    at = len(keys)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, min(ROWS, batch.num_rows - i))
                x = part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)
                out = np.zeros((part.num_rows, width, count))
                for tree in shared.value:
                    tree_values(tree, x, out)
                flat = out[:, :, wanted].transpose(0, 2, 1).reshape(part.num_rows, -1)  # by output, then feature
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "phi"])

    valued = base.mapInArrow(run, schema).select(*keys, "x", F.posexplode("phi").alias("place", "phi"))
    feature = F.pmod("place", F.lit(width))
    names, origins, which = (F.array(*map(F.lit, v)) for v in ([f for f, _ in lineage], [o for _, o in lineage], wanted))
    return valued.select(*keys, F.element_at(which, F.floor(F.col("place") / width).cast("int") + 1).alias("output"), F.element_at(names, feature + 1).alias("feature"),
                         F.element_at(origins, feature + 1).alias("original_feature"), F.element_at("x", feature + 1).alias("feature_value"), "phi")

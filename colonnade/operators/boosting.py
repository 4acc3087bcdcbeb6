"""Boosted trees for any number of classes: one model, softmax loss, shared bins.

Every round grows one tree per class, all of them level by level: a task adds its rows' gradients up into a histogram
per class, node, feature and bin, the histograms are added by one shuffle, and the best cut of every node is found
there. The driver sees one row per class and node. A level takes one pass over the data whatever the number of classes,
as long as a level's histogram has at most `CELLS` cells; larger ones take a pass per block of classes.

Gradients are added as whole numbers (units of 2^-24), so sums do not depend on how rows are spread over tasks: with the
same cut points a fit gives the same trees for every partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.functions.storage import stored
from colonnade.operators.features import _param, _Stage

CELLS = 1 << 22    # histogram cells of a pass, 24 bytes each
UNIT = 1 << 24
STORE_EVERY = 10   # rounds after which the rows' margins are written, so that older trees need no second walk
ROW_CELLS = 1 << 20  # rows times features that a task handles at once
ACCURACY = 10_000  # of the cut points' ranks: within one part in this many
PER_AGGREGATE = 16


def cut_points(df: DataFrame, width: int, bins: int) -> list[list[float]]:
    """Ascending thresholds per feature: the smallest value and quantiles, each once. `df` has `x`, an array."""
    probs = [i / bins for i in range(bins)]
    out: list[list[float]] = []
    for first in range(0, width, PER_AGGREGATE):
        some = range(first, min(width, first + PER_AGGREGATE))
        row = df.agg(*[F.percentile_approx(F.col("x")[i], probs, ACCURACY).alias(f"q{i}") for i in some]).first()
        out += [sorted({float(v) for v in row[f"q{i}"] or []}) for i in some]
    return out


def softmax(margins: np.ndarray) -> np.ndarray:
    grown = np.exp(margins - margins.max(axis=1, keepdims=True))
    return grown / grown.sum(axis=1, keepdims=True)


class Tree:
    """A tree in heap order: node i has the children 2i + 1 and 2i + 2; feature -1 marks leaves."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.feature = np.full(size, -1, np.int64)
        self.cut = np.zeros(size, np.int64)
        self.threshold = np.zeros(size)
        self.value = np.zeros(size)
        self.cover = np.zeros(size)
        self.gain = np.zeros(size)

    def walk(self, x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The leaf that each row of x falls into; a row goes right where its value is above the cut."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(len(self.feature).bit_length() - 1):
            f = self.feature[at]
            at = np.where(f >= 0, 2 * at + 1 + ~(x[rows, f] <= cuts[at]), at)
        return at


def _rows(batch: pa.RecordBatch, width: int, classes: int):
    """(bins, labels, margins) of a batch, a bounded number of rows at a time."""
    step = max(1, ROW_CELLS // max(width, classes, 1))
    for i in range(0, batch.num_rows, step):
        part = batch.slice(i, step)
        x = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(part.num_rows, width)
        margins = np.frombuffer(b"".join(part.column(2).to_pylist()), np.float64).reshape(part.num_rows, classes)
        yield x, part.column(1).to_numpy(), margins


def _added(x: np.ndarray, margins: np.ndarray, trees: list[list[Tree]]) -> np.ndarray:
    """Margins with the values of further rounds of trees."""
    margins = margins.copy()
    for grown in trees:
        for k, tree in enumerate(grown):
            margins[:, k] += tree.value[tree.walk(x, tree.cut)]
    return margins


def _histogram(binned: DataFrame, done: list[list[Tree]], grown: list[Tree], level: int, block: range, width: int, bins: int) -> DataFrame:
    """(class, node, feature, bin, g, h, n) of one level for a block of classes: sums over all rows."""
    classes, nodes = len(grown), 2 ** level

    def run(batches):
        sums = np.zeros((3, len(block) * nodes * width * bins), np.int64)
        offsets = np.arange(width) * bins
        for batch in batches:
            for x, label, margins in _rows(batch, width, classes):
                p = softmax(_added(x, margins, done))
                cells, weights = [], []
                for b, k in enumerate(block):
                    at = grown[k].walk(x, grown[k].cut) - (nodes - 1)
                    here = np.flatnonzero(at >= 0)
                    cells.append((((b * nodes + at[here]) * width * bins)[:, None] + offsets + x[here]).ravel())
                    own = p[here, k]
                    g, h = np.rint((own - (label[here] == k)) * UNIT), np.rint(own * (1 - own) * UNIT)
                    weights.append(np.repeat(np.stack([g, h]), width, axis=1))
                    if sum(map(len, cells)) >= ROW_CELLS or b == len(block) - 1:
                        flat, both = np.concatenate(cells), np.concatenate(weights, axis=1)
                        hit, back = np.unique(flat, return_inverse=True)
                        sums[0, hit] += np.bincount(back, both[0], len(hit)).astype(np.int64)
                        sums[1, hit] += np.bincount(back, both[1], len(hit)).astype(np.int64)
                        sums[2, hit] += np.bincount(back, minlength=len(hit))
                        cells, weights = [], []
        full = np.flatnonzero(sums[2])
        cls, node, feature, place = np.unravel_index(full, (len(block), nodes, width, bins))
        for i in range(0, len(full), 100_000):
            s = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int32()) for v in (cls[s] + block.start, node[s], feature[s], place[s])]
                + [pa.array(sums[j, full[s]]) for j in range(3)], ["class", "node", "feature", "bin", "g", "h", "n"])

    parts = binned.mapInArrow(run, "class int, node int, feature int, bin int, g long, h long, n long")
    return parts.groupBy("class", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])


def best_cuts(histogram: DataFrame, penalty: float, least: int) -> DataFrame:
    """Per class and node: totals, and the cut that gains most (the smaller feature and bin on a tie), null without one."""
    keys = ["class", "node", "feature"]
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    real = lambda c: F.col(c) / F.lit(float(UNIT))
    sums = histogram.select(*keys, "bin", *[F.sum(c).over(upto).alias(f"l{c}") for c in ("g", "h", "n")],
                            *[F.sum(c).over(whole).alias(f"t{c}") for c in ("g", "h", "n")])
    sums = sums.withColumns({f"r{c}": F.col(f"t{c}") - F.col(f"l{c}") for c in ("g", "h", "n")})

    def strength(side: str) -> Column:
        return real(f"{side}g") * real(f"{side}g") / (real(f"{side}h") + F.lit(penalty))

    gain = strength("l") + strength("r") - strength("t")
    fits = (F.col("ln") >= least) & (F.col("rn") >= least) & (gain > 1e-9)
    cut = F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), *[f"{s}{c}" for s in "lr" for c in "ghn"])
    return sums.groupBy("class", "node").agg(
        *[F.first(c).alias(c) for c in ("tg", "th", "tn")], F.max(F.when(fits, cut)).alias("cut"))


class SoftmaxBoostedTrees(Estimator, _Stage):
    """Newton boosting of the softmax loss. The label is a class index from 0; values are finite numbers.

    Classes without rows are never predicted. `seed` is accepted and not used: nothing is drawn.
    """

    classes = _param("classes", "number of classes")
    maxIter = _param("maxIter", "rounds; each grows a tree per class")
    maxDepth = _param("maxDepth", "levels of a tree")
    stepSize = _param("stepSize", "share of a tree's value that is added")
    maxBins = _param("maxBins", "cut points per feature, at most 255")
    minInstancesPerNode = _param("minInstancesPerNode", "rows that each side of a cut must have")
    penalty = _param("penalty", "added to the second derivatives' sum")
    seed = _param("seed", "not used")

    @keyword_only
    def __init__(self, *, classes=2, maxIter=20, maxDepth=5, stepSize=0.1, maxBins=32, minInstancesPerNode=1, penalty=1.0, seed=0):
        super().__init__()
        if not 2 <= maxBins <= 255:
            raise ValueError("maxBins must lie between 2 and 255")
        self._take(classes=classes, maxIter=maxIter, maxDepth=maxDepth, stepSize=stepSize, maxBins=maxBins,
                   minInstancesPerNode=minInstancesPerNode, penalty=penalty, seed=seed)

    def _fit(self, df):
        classes, depth, bins = self.value("classes"), self.value("maxDepth"), self.value("maxBins")
        flat = df.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label"))
        counts = {r["label"]: (r["n"], r["width"]) for r in flat.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).collect()}
        if not counts:
            raise ValueError("no rows to learn from")
        if not all(k is not None and 0 <= k < classes for k in counts):
            raise ValueError(f"labels must be class indexes below {classes}")
        width, rows = max(w for _, w in counts.values()), sum(n for n, _ in counts.values())
        prior = np.log([max(counts.get(k, (0, 0))[0], 1e-9) / rows for k in range(classes)])
        cuts = cut_points(flat, width, bins)
        binned = stored(self._binned(flat, cuts, prior), "binned")
        rounds: list[list[Tree]] = []
        done = 0
        for i in range(self.value("maxIter")):
            if i - done >= STORE_EVERY:
                binned, done = stored(self._moved(binned, rounds[done:], width), "margins"), i
            grown = self._grow(binned, rounds[done:], [Tree(depth) for _ in range(classes)], width, cuts)
            rounds.append(grown)
            if all(t.feature[0] < 0 for t in grown):
                break
        trees = [{"class": k, "feature": t.feature.tolist(), "threshold": t.threshold.tolist(), "value": t.value.tolist(),
                  "cover": t.cover.tolist(), "gain": t.gain.tolist()} for grown in rounds for k, t in enumerate(grown) if t.value.any()]
        return SoftmaxBoostedTreesModel(classes=classes, width=width, prior=prior.tolist(), trees=trees)

    @staticmethod
    def _binned(flat: DataFrame, cuts: list[list[float]], prior: np.ndarray) -> DataFrame:
        edges, width, start = [np.array(c) for c in cuts], len(cuts), prior.astype(np.float64).tobytes()

        def run(batches):
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                # the last bin holds what is above all cuts
                at = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1) if width else x
                packed = [r.tobytes() for r in at.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1), pa.array([start] * batch.num_rows, pa.binary())],
                                                 ["x", "label", "margins"])

        return flat.mapInArrow(run, "x binary, label int, margins binary")

    @staticmethod
    def _moved(binned: DataFrame, trees: list[list[Tree]], width: int) -> DataFrame:
        classes = len(trees[0])

        def run(batches):
            for batch in batches:
                moved = [r.tobytes() for x, _, margins in _rows(batch, width, classes) for r in _added(x, margins, trees)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(moved, pa.binary())], ["x", "label", "margins"])

        return binned.mapInArrow(run, "x binary, label int, margins binary")

    def _grow(self, binned: DataFrame, done: list[list[Tree]], grown: list[Tree], width: int, cuts: list[list[float]]) -> list[Tree]:
        """One tree per class, a level of all trees at a time."""
        penalty, step = self.value("penalty"), self.value("stepSize")
        bins = max(len(c) for c in cuts) + 1 if cuts else 1

        def leaf(tree: Tree, at: int, g: int, h: int, n: int) -> None:
            tree.value[at], tree.cover[at] = -step * (g / UNIT) / (h / UNIT + penalty), n

        growing = set(range(len(grown)))
        for level in range(self.value("maxDepth")):
            at_once = max(1, CELLS // max(1, 2 ** level * width * bins))
            first, found = 2 ** level - 1, []
            for k in range(0, len(grown), at_once):
                block = range(k, min(len(grown), k + at_once))
                if growing & set(block):
                    found += best_cuts(_histogram(binned, done, grown, level, block, width, bins), penalty, self.value("minInstancesPerNode")).collect()
            growing = set()
            for r in found:
                tree, at, cut = grown[r["class"]], first + r["node"], r["cut"]
                leaf(tree, at, r["tg"], r["th"], r["tn"])
                if cut is not None:
                    tree.feature[at], tree.cut[at], tree.gain[at] = -cut["f"], -cut["b"], cut["gain"]
                    tree.threshold[at] = cuts[-cut["f"]][-cut["b"]]
                    leaf(tree, 2 * at + 1, cut["lg"], cut["lh"], cut["ln"])
                    leaf(tree, 2 * at + 2, cut["rg"], cut["rh"], cut["rn"])
                    growing.add(r["class"])
            if not growing:
                break
        return grown


class SoftmaxBoostedTreesModel(Model, _Stage):
    classes = _param("classes", "number of classes")
    width = _param("width", "number of features")
    prior = _param("prior", "margin of each class before any tree")
    trees = _param("trees", "class, feature, threshold, value, cover and gain of each tree's nodes in heap order")

    @keyword_only
    def __init__(self, *, classes=None, width=None, prior=None, trees=None):
        super().__init__()
        self._take(classes=classes, width=width, prior=prior, trees=trees)

    def _transform(self, df):
        prior, width, trees = np.array(self.value("prior"), float), self.value("width"), []
        for t in self.value("trees"):
            tree = Tree(0)
            tree.feature, tree.threshold, tree.value = (np.array(t[c]) for c in ("feature", "threshold", "value"))
            trees.append((t["class"], tree))

        @F.pandas_udf("array<double>")
        def margins(rows):
            import pandas as pd

            x = np.stack(rows.to_list()) if len(rows) else np.zeros((0, width))
            out = np.tile(prior, (len(x), 1))
            for k, tree in trees:
                out[:, k] += tree.value[tree.walk(x, tree.threshold)]
            return pd.Series(list(out))

        raw = df.withColumn("rawPrediction", margins(vector_to_array("features")))
        top = F.array_max("rawPrediction")
        grown = F.transform("rawPrediction", lambda m: F.exp(m - F.array_max("rawPrediction")))
        total = F.aggregate(grown, F.lit(0.0), lambda a, v: a + v)
        return raw.withColumns({
            "prediction": (F.array_position("rawPrediction", top) - 1).cast("double"),
            "probability": array_to_vector(F.transform(grown, lambda v: v / total)),
        }).withColumn("rawPrediction", array_to_vector("rawPrediction"))

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - the name that MLlib's tree models use
        """Gain of each feature over all cuts, scaled to sum 1."""
        total = np.zeros(self.value("width"))
        for t in self.value("trees"):
            feature = np.array(t["feature"])
            np.add.at(total, feature[feature >= 0], np.array(t["gain"])[feature >= 0])
        return DenseVector(total / total.sum() if total.sum() else total)

    def node_rows(self) -> list[tuple]:
        """The nodes for exact attributions (`tree_attribution.NODES`); the prior is a tree of one leaf. Values are margins."""
        classes, leafs = self.value("classes"), self.value("prior")
        rows = [(0, 1.0, 0, -1, None, None, -1, -1, 1.0, [float(v) for v in leafs])]
        for i, t in enumerate(self.value("trees"), 1):
            reached = [0]
            while reached:
                at = reached.pop()
                split = t["feature"][at] >= 0
                value = [t["value"][at] if k == t["class"] else 0.0 for k in range(classes)]
                left, right = (2 * at + 1, 2 * at + 2) if split else (-1, -1)
                rows.append((i, 1.0, at, t["feature"][at], t["threshold"][at] if split else None, None, left, right, t["cover"][at], value))
                reached += [left, right] if split else []
        return rows

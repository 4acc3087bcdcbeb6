"""Random forests for many rows: a level of many trees in one pass, histograms over shared bins.

Up to `limit` rows the forest is MLlib's. Beyond, tasks add their rows' draws up into a histogram per tree, node, drawn
feature, bin and class; one shuffle adds the histograms, and the best cut of every node is found there. The driver sees
a few numbers per node. Trees are handled one after the other over blocks of rows, so a tree's nodes and histogram stay
in the processor's cache. A pass has at most `CELLS` histogram cells; larger levels take several passes.

The trees are those of MLlib's method: bootstrap draws (Poisson) per row and tree, a random set of features per node,
Gini gain, leaves of one answer merged. Draws follow from the hash of the row's columns and counts are whole numbers, so
with the same cut points a fit gives the same trees for every partitioning; rows equal in all columns are drawn alike.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.functions.storage import stored
from colonnade.operators.boosting import cut_points
from colonnade.operators.features import _param, _Stage

CELLS = 1 << 24     # histogram cells of a pass, 4 bytes each in a task
BLOB = 1 << 16      # cells that are shuffled and searched together
BLOCK_ROWS = 1 << 15  # rows that a task handles at once
DEEPEST = 16        # levels; deeper forests are MLlib's


def _mixed(h: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number (the finalizer of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _poisson(rate: float) -> np.ndarray:
    """Draws of the Poisson distribution for 16 uniform bits."""
    upto, p, n = [], math.exp(-rate), 0
    total = p
    while total < 1 - 1e-9:
        upto.append(total)
        n += 1
        p *= rate / n
        total += p
    return np.searchsorted(upto, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


class _Draws:
    """How often each row is drawn for a tree; four trees share a row's 64 bits."""

    def __init__(self, hashes: np.ndarray, table: np.ndarray, seed: int):
        self.hashes, self.table, self.seed, self.four = hashes, table, seed, -1

    def of(self, tree: int) -> np.ndarray:
        if tree // 4 != self.four:
            self.four = tree // 4
            step = (self.seed * 1_000_003 + self.four + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
            self.bits = _mixed(self.hashes + np.uint64(step)).view(np.uint16)
        return self.table.take(self.bits[tree % 4::4])


class _Growing:
    """A tree while it grows: cuts in heap order, and the nodes of the present level that may be cut."""

    def __init__(self):
        self.feature, self.cut = np.zeros(0, np.int16), np.zeros(0, np.uint8)
        self.nodes = np.zeros(1, np.int64)  # heap places of the nodes to cut
        self.subset = np.zeros((1, 0), np.int16)
        self.found: dict[int, list] = {}    # heap place -> [feature, cut, gain, counts per class]


def _blocks(batches, width: int):
    """(bins by feature, labels, hashes) of about `BLOCK_ROWS` rows at a time."""
    held, n = [], 0

    def joined():
        x, label, h = (np.concatenate(v) for v in zip(*held))
        return np.ascontiguousarray(x.T).ravel(), label, h.view(np.uint64)

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.frombuffer(batch.column(0).buffers()[1], np.int32)[batch.column(0).offset:][:batch.num_rows + 1]
        x = np.frombuffer(batch.column(0).buffers()[2], np.uint8)[ends[0]:ends[-1]].reshape(batch.num_rows, width)
        held.append((x, batch.column(1).to_numpy().astype(np.intp), batch.column(2).to_numpy()))
        n += batch.num_rows
        if n >= BLOCK_ROWS:
            yield joined()
            held, n = [], 0
    if held:
        yield joined()


def _level(binned: DataFrame, trees: list[_Growing], pieces: list[tuple], level: int, width: int, bins: int, classes: int,
           table: np.ndarray, seed: int) -> DataFrame:
    """(tree, first node, counts) of the pieces (tree, first, end of its nodes to cut) from every task."""
    plan = [(t, lo, hi, trees[t].feature, trees[t].cut, trees[t].nodes[lo:hi], trees[t].subset[lo:hi]) for t, lo, hi in pieces]
    kept = trees[pieces[0][0]].subset.shape[1]
    each = kept * bins * classes  # cells of a node

    def run(batches):
        ready, sums = [], []
        for t, lo, _, feature, cut, nodes, subset in plan:
            slot = np.full(2 ** level, -1, np.intp)
            slot[nodes - (2 ** level - 1)] = np.arange(len(nodes))
            ready.append((t, feature.astype(np.intp), cut, slot, subset.astype(np.intp)))
            sums.append(np.zeros(len(nodes) * each, np.int32))
        for x, label, hashes in _blocks(batches, width):
            n, draws = len(label), _Draws(hashes, table, seed)
            # a row's place among the bins and classes of a feature, found once for all trees
            inner = (x.reshape(width, n).astype(np.intp) * classes + label).ravel()
            for (t, feature, cut, slot, subset), total in zip(ready, sums):
                weight = draws.of(t)
                rows = np.flatnonzero(weight)
                at, start = np.zeros(len(rows), np.intp), feature * n
                for _ in range(level):
                    place = start.take(at)
                    place += rows
                    right = x.take(place) > cut.take(at)
                    at *= 2
                    at += 1
                    at += right
                at -= 2 ** level - 1
                at = slot.take(at)
                here = np.flatnonzero(at >= 0)
                if len(here) < len(at):
                    at, rows = at.take(here), rows.take(here)
                drawn, first = weight.take(rows).astype(np.int32), at * each
                for j in range(kept):
                    cell = (subset[:, j] * n).take(at)
                    cell += rows
                    cell = inner.take(cell)
                    cell += first
                    np.add.at(total[j * bins * classes:], cell, drawn)
        step = max(1, BLOB // each)
        for (t, lo, *_), total in zip(plan, sums):
            for i in range(0, len(total) // each, step):
                part = total[i * each:(i + step) * each]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([lo + i], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                                                     ["tree", "first", "counts"])

    return binned.mapInArrow(run, "tree int, first int, counts binary")


def best_cuts(counts: np.ndarray, least: int) -> np.ndarray:
    """Per node of (node, feature, bin, class): place of the feature or -1, bin, gain, counts per class: all, left of the cut.

    The cut of the largest Gini gain; the earlier feature and smaller bin on a tie.
    """
    def impurity(c, n):
        return 1.0 - (c.astype(float) ** 2).sum(axis=-1) / np.maximum(n, 1).astype(float) ** 2

    left = counts.cumsum(axis=2)
    every = left[:, 0, -1]
    left = left[:, :, :-1]
    right = every[:, None, None] - left
    n, nl, nr = every.sum(axis=-1), left.sum(axis=-1), right.sum(axis=-1)
    gain = impurity(every, n)[:, None, None] - (nl * impurity(left, nl) + nr * impurity(right, nr)) / np.maximum(n, 1)[:, None, None]
    gain = np.where((nl >= least) & (nr >= least), gain, -1.0).reshape(len(counts), -1)
    best, node = gain.argmax(axis=1), np.arange(len(counts))
    top = gain[node, best]
    place, at = np.divmod(best, left.shape[2])
    return np.column_stack([np.where(top > 0, place, -1), at, top, every, left[node, place, at]]).astype(float)


class RandomForest(Estimator, _Stage):
    """A forest for classification. The label is a class index from 0; values are finite numbers."""

    classes = _param("classes", "number of classes; none: as the label column says, or has")
    numTrees = _param("numTrees", "trees")
    maxDepth = _param("maxDepth", "levels of a tree")
    maxBins = _param("maxBins", "cut points per feature, at most 255")
    minInstancesPerNode = _param("minInstancesPerNode", "draws that each side of a cut must have")
    featureSubsetStrategy = _param("featureSubsetStrategy", "features drawn per node: auto or sqrt, or all")
    subsamplingRate = _param("subsamplingRate", "mean number of draws of a row per tree")
    seed = _param("seed", "of the draws")
    limit = _param("limit", "rows up to which the forest is MLlib's")

    @keyword_only
    def __init__(self, *, classes=None, numTrees=20, maxDepth=5, maxBins=32, minInstancesPerNode=1, featureSubsetStrategy="auto",
                 subsamplingRate=1.0, seed=0, limit=0):
        super().__init__()
        if not 2 <= maxBins <= 255:
            raise ValueError("maxBins must lie between 2 and 255")
        self._take(classes=classes, numTrees=numTrees, maxDepth=maxDepth, maxBins=maxBins, minInstancesPerNode=minInstancesPerNode,
                   featureSubsetStrategy=featureSubsetStrategy, subsamplingRate=subsamplingRate, seed=seed, limit=limit)

    def _fit(self, df):
        names = ("numTrees", "maxDepth", "maxBins", "minInstancesPerNode", "featureSubsetStrategy", "subsamplingRate", "seed")
        params = {n: self.value(n) for n in names}
        known = params["featureSubsetStrategy"] in ("auto", "sqrt", "all") and params["numTrees"] > 1 and 0 <= params["maxDepth"] <= DEEPEST
        if not known or df.limit(self.value("limit") + 1).count() <= self.value("limit"):
            return RandomForestClassifier(**params).fit(df)
        return self._grown(df)

    def _grown(self, df: DataFrame) -> "RandomForestModel":
        depth, bins, seed = self.value("maxDepth"), self.value("maxBins"), self.value("seed")
        others = [F.col(f"`{c}`") for c in df.columns if c not in ("features", "label")]
        x, label = vector_to_array("features"), F.col("label").cast("int")
        flat = df.select(x.alias("x"), label.alias("label"), F.xxhash64(*others, "label", x).alias("h"))
        row = flat.agg(F.max("label").alias("top"), F.min("label").alias("low"), F.count_if(F.col("label").isNull()).alias("none"),
                       F.max(F.size("x")).alias("width")).first()
        if row["top"] is None:
            raise ValueError("no rows to learn from")
        told = df.schema["label"].metadata.get("ml_attr", {}).get("vals")
        classes = self.value("classes") if self.isDefined(self.classes) else max(2, row["top"] + 1, len(told or []))
        if row["none"] or row["low"] < 0 or row["top"] >= classes:
            raise ValueError(f"labels must be class indexes below {classes}")
        width = row["width"]
        cuts = cut_points(flat, width, bins)
        binned = stored(self._binned(flat, cuts), "binned")
        places = max(len(c) for c in cuts) + 1
        kept = width if self.value("featureSubsetStrategy") == "all" else math.ceil(math.sqrt(width))
        table = _poisson(self.value("subsamplingRate"))
        trees = [_Growing() for _ in range(self.value("numTrees"))]
        least = self.value("minInstancesPerNode")
        each = kept * places * classes
        for level in range(max(depth, 1)):
            for t, tree in enumerate(trees):
                drawn = np.random.default_rng([seed % (1 << 32), t, level]).random((len(tree.nodes), width))
                tree.subset = np.sort(drawn.argsort(axis=1)[:, :kept], axis=1).astype(np.int16)
            some = max(1, CELLS // each)
            pieces = [(t, lo, min(lo + some, len(tree.nodes))) for t, tree in enumerate(trees) for lo in range(0, len(tree.nodes), some)]
            passes, full = [[]], 0
            for piece in pieces:
                if passes[-1] and full + piece[2] - piece[1] > some:
                    passes.append([])
                    full = 0
                passes[-1].append(piece)
                full += piece[2] - piece[1]
            answers = []
            for these in filter(None, passes):
                parts = _level(binned, trees, these, level, width, places, classes, table, seed)
                answers += parts.groupBy("tree", "first").applyInArrow(_searched(kept, places, classes, least), "tree int, first int, best binary").collect()
            for tree in trees:
                tree.next, tree.feature, tree.cut = [], np.concatenate([tree.feature, np.zeros(2 ** level, np.int16)]), np.concatenate([tree.cut, np.full(2 ** level, 255, np.uint8)])
            for r in answers:
                self._cut(trees[r["tree"]], r["first"], np.frombuffer(r["best"]).reshape(-1, 3 + 2 * classes), classes, level + 1 < depth, depth > 0)
            for tree in trees:
                tree.nodes = np.array(sorted(tree.next), np.int64)
            if not any(len(tree.nodes) for tree in trees):
                break
        return RandomForestModel(classes=classes, width=width, trees=[_tree(tree.found, cuts, classes) for tree in trees])

    @staticmethod
    def _cut(tree: _Growing, first: int, best: np.ndarray, classes: int, deeper: bool, cutting: bool) -> None:
        """Enter the best cuts of some nodes; their children are to be cut if they hold several classes."""
        for i, b in enumerate(best):
            at, every, left = int(tree.nodes[first + i]), b[3:3 + classes], b[3 + classes:]
            if b[0] < 0 or not cutting:
                tree.found.setdefault(at, [-1, 0, 0.0, every])
                continue
            feature = int(tree.subset[first + i, int(b[0])])
            tree.feature[at], tree.cut[at] = feature, int(b[1])
            tree.found[at] = [feature, int(b[1]), b[2], every]
            for child, counts in ((2 * at + 1, left), (2 * at + 2, every - left)):
                tree.found[child] = [-1, 0, 0.0, counts]
                if deeper and np.count_nonzero(counts) > 1:
                    tree.next.append(child)

    @staticmethod
    def _binned(flat: DataFrame, cuts: list[list[float]]) -> DataFrame:
        edges, width = [np.array(c) for c in cuts], len(cuts)

        def run(batches):
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
                # the last bin holds what is above all cuts
                at = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)
                ends = pa.py_buffer(np.arange(0, (len(at) + 1) * width, width, dtype=np.int32))
                packed = pa.Array.from_buffers(pa.binary(), len(at), [None, ends, pa.py_buffer(at.tobytes())])
                yield pa.RecordBatch.from_arrays([packed, batch.column(1), batch.column(2)], ["x", "label", "h"])

        return flat.mapInArrow(run, "x binary, label int, h long")


def _searched(kept: int, places: int, classes: int, least: int):
    """Adds the tasks' histograms of some nodes up and finds their best cuts."""
    def run(table: pa.Table) -> pa.Table:
        total = np.int64(0)
        for blob in table.column("counts"):
            total = total + np.frombuffer(blob.as_buffer(), np.int32).astype(np.int64)
        best = best_cuts(total.reshape(-1, kept, places, classes), least)
        return pa.table({"tree": pa.array([table["tree"][0].as_py()], pa.int32()), "first": pa.array([table["first"][0].as_py()], pa.int32()),
                         "best": pa.array([best.tobytes()], pa.binary())})

    return run


def _tree(found: dict[int, list], cuts: list[list[float]], classes: int) -> dict:
    """A grown tree's nodes, parents first, the two children of a cut beside each other; leaves of one answer are merged."""
    if not found:
        found = {0: [-1, 0, 0.0, np.zeros(classes)]}
    says = {}  # the answer of leaves
    for at in sorted(found, reverse=True):
        node = found[at]
        if node[0] >= 0 and says.get(2 * at + 1, -1) == says.get(2 * at + 2, -2):
            node[0] = -1
        if node[0] < 0:
            says[at] = int(np.argmax(node[3]))
    out = {"feature": [], "threshold": [], "left": [], "counts": [], "gain": []}
    level, size = [0], 1
    while level:
        below = []
        for at in level:
            feature, cut, gain, counts = found[at]
            out["feature"].append(feature)
            out["threshold"].append(cuts[feature][cut] if feature >= 0 else 0.0)
            out["left"].append(size + len(below) if feature >= 0 else -1)
            out["counts"].append([float(c) for c in counts])
            out["gain"].append(float(gain) if feature >= 0 else 0.0)
            below += [2 * at + 1, 2 * at + 2] if feature >= 0 else []
        level, size = below, size + len(below)
    return out


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins by feature: how many of the feature's thresholds a value is above; none if it is no number."""
    out = np.empty((len(edges), len(x)), np.uint8)
    for i, e in enumerate(edges):
        out[i] = np.where(np.isnan(x[:, i]), 0, np.searchsorted(e, x[:, i], side="left"))
    return out.ravel()


class RandomForestModel(Model, _Stage):
    classes = _param("classes", "number of classes")
    width = _param("width", "number of features")
    trees = _param("trees", "feature (-1: leaf), threshold, left child (the right one follows it), counts and gain of each tree's nodes")

    @keyword_only
    def __init__(self, *, classes=None, width=None, trees=None):
        super().__init__()
        self._take(classes=classes, width=width, trees=trees)

    def _transform(self, df):
        classes, width, trees = self.value("classes"), self.value("width"), []
        edges = self._edges()
        for t in self.value("trees"):
            feature, left, counts = (np.array(t[c]) for c in ("feature", "left", "counts"))
            leaf = feature < 0
            shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1.0)
            depth = np.zeros(len(feature), int)
            for i in np.flatnonzero(~leaf):
                depth[[left[i], left[i] + 1]] = depth[i] + 1
            # a leaf leads to itself: no bin is above its cut
            cut = np.array([255 if f < 0 else np.searchsorted(edges[f], v) for f, v in zip(feature, t["threshold"])], np.uint8)
            trees.append((int(depth.max()), np.where(leaf, 0, feature), cut, np.where(leaf, np.arange(len(leaf)), left), np.ascontiguousarray(shares.T)))

        @F.arrow_udf("array<double>")
        def votes(rows: pa.Array) -> pa.Array:
            n = len(rows)
            x, out, each = _bins(rows.flatten().to_numpy(zero_copy_only=False).reshape(n, width), edges), np.zeros((classes, n)), np.arange(n)
            for depth, feature, cut, left, shares in trees:
                at, start = np.zeros(n, np.intp), feature * n
                for _ in range(depth):
                    place = start.take(at)
                    place += each
                    right = x.take(place) > cut.take(at)
                    at = left.take(at)
                    at += right
                for k in range(classes):
                    out[k] += shares[k].take(at)
            return pa.ListArray.from_arrays(np.arange(0, (n + 1) * classes, classes, dtype=np.int32), np.ascontiguousarray(out.T).ravel())

        raw = df.withColumn("rawPrediction", votes(vector_to_array("features")))
        total = F.aggregate("rawPrediction", F.lit(0.0), lambda a, v: a + v)
        return raw.withColumns({
            "prediction": (F.array_position("rawPrediction", F.array_max("rawPrediction")) - 1).cast("double"),
            "probability": array_to_vector(F.transform("rawPrediction", lambda v: v / total)),
        }).withColumn("rawPrediction", array_to_vector("rawPrediction"))

    def _edges(self) -> list[np.ndarray]:
        """The thresholds of each feature, ascending, each once."""
        found: list[set] = [set() for _ in range(self.value("width"))]
        for t in self.value("trees"):
            for feature, threshold in zip(t["feature"], t["threshold"]):
                if feature >= 0:
                    found[feature].add(threshold)
        return [np.array(sorted(f), float) for f in found]

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - the name that MLlib's tree models use
        """Gain of each feature weighted by the draws, scaled to sum 1 per tree and then over all."""
        total = np.zeros(self.value("width"))
        for t in self.value("trees"):
            feature, own = np.array(t["feature"]), np.zeros(self.value("width"))
            cut = feature >= 0
            np.add.at(own, feature[cut], (np.array(t["gain"]) * np.array(t["counts"]).sum(axis=1))[cut])
            total += own / own.sum() if own.sum() else own
        return DenseVector(total / total.sum() if total.sum() else total)

    def node_rows(self) -> list[tuple]:
        """The nodes for exact attributions (`tree_attribution.NODES`). Values are the classes' shares."""
        trees, rows = self.value("trees"), []
        for i, t in enumerate(trees):
            for at, (feature, threshold, left, counts) in enumerate(zip(t["feature"], t["threshold"], t["left"], t["counts"])):
                cut, n = feature >= 0, sum(counts)
                rows.append((i, 1.0 / len(trees), at, feature, threshold if cut else None, None, left, left + 1 if cut else -1, n,
                             [c / max(n, 1.0) for c in counts]))
        return rows

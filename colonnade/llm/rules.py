"""Quality rules: fixed counts of words and lines, and a hashed n-gram classifier with calibrated probabilities.

The classifier is a logistic regression over hashed word and character n-grams of the whole text. A text is the mean of
its words' unit buckets (runs of 1 and 2 words) beside the mean of its characters' unit buckets (runs of 3 and 5 bytes),
so long and short texts compare. Its logits are calibrated on labelled rows that the fit has not seen.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm import textops as T
from colonnade.llm.runtime import beside, free, quoted, ship
from colonnade.llm.samples import clean_labels, labelled_texts

BUCKETS = 1 << 16  # of words, and as many of characters
WORD_RUNS, CHAR_RUNS = (1, 2), (3, 5)
GAIN = 64.0  # the means are small numbers; this brings them to the scale of the weights
KEEP_FROM = 0.5
PART, TASKS = 3000, 256  # labelled documents that are fitted together, and tasks that fit
UNIT = float(1 << 36)  # weights are added up in whole parts of this
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Classifier(NamedTuple):
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -30, 30)))


def grams(block: T.Block, texts: np.ndarray, words: np.ndarray):
    """Arrays (bucket, text) of each kind of n-gram; word kinds use the lower half of the buckets."""
    for k in WORD_RUNS:
        h, t = T.windows(words, texts, k)
        yield 0, (h >> T.U(48)).astype(np.int64), t
    data = block.data
    owner = np.repeat(np.arange(block.n), np.diff(block.borders))
    for k in CHAR_RUNS:
        if len(data) < k:
            continue
        h = np.zeros(len(data) - k + 1, dtype=np.uint64)
        for i in range(k):
            h = h * T.U(257) + data[i:len(data) - k + 1 + i]
        same = owner[:len(data) - k + 1] == owner[k - 1:]
        h = (h[same] * T.U(0x9E3779B97F4A7C15)) >> T.U(48)
        yield 1, h.astype(np.int64) + BUCKETS, owner[:len(data) - k + 1][same]


def logits(block: T.Block, texts: np.ndarray, words: np.ndarray, model: Classifier) -> np.ndarray:
    sums, total = np.zeros((2, block.n)), np.zeros((2, block.n))
    for kind, bucket, owner in grams(block, texts, words):
        sums[kind] += T.per_text(owner, block.n, model.weights[bucket])
        total[kind] += T.per_text(owner, block.n)
    return model.bias + GAIN * (sums / np.maximum(total, 1)).sum(0)


def rows_of(block: T.Block):
    """Per text the sorted buckets and their values, for the fit."""
    starts, ends, texts = T.spans(block)
    words = T.hashes(block.data, starts, ends)
    found = list(grams(block, texts, words))
    total = np.zeros((2, block.n))
    for kind, _, owner in found:
        total[kind] += T.per_text(owner, block.n)
    keys = np.concatenate([owner * (2 * BUCKETS) + bucket for _, bucket, owner in found] or [np.zeros(0, np.int64)])
    key, n = np.unique(keys, return_counts=True)
    owner, bucket = key // (2 * BUCKETS), key % (2 * BUCKETS)
    value = GAIN * n / total[(bucket >= BUCKETS).astype(int), owner]
    cut = np.searchsorted(owner, np.arange(block.n + 1))
    return cut, bucket, value


def _fit_of(batches, steps: int):
    """Texts sorted by part and doc_id to one row: the parts fitted and the whole-number sums of their classifiers."""
    fitted, weights, bias = 0, np.zeros(2 * BUCKETS, np.int64), 0
    held: list[tuple] = []
    part = None

    def close():
        nonlocal fitted, weights, bias
        n, sizes, bucket, value = ([h[i] for h in held] for i in range(4))
        cut = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        m = fit_arrays(cut, np.concatenate(bucket), np.concatenate(value), np.concatenate(n).astype(float), steps)
        # the calibrated logit of the part's model, linear in the n-grams
        weights = weights + np.rint(m.slope * m.weights * UNIT).astype(np.int64)
        bias += round((m.slope * m.bias + m.shift) * UNIT)
        fitted += 1
        held.clear()

    for batch in batches:
        owner = batch.column("part").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)]
        for i, j in zip(edges, edges[1:], strict=False):
            if i == j:
                continue
            if held and part != owner[i]:
                close()
            part, own = owner[i], batch.slice(i, j - i)
            good = own.column("quality").to_numpy()
            for b in T.blocks(own.column("text")):
                cut, bucket, value = rows_of(b)
                held.append((good[b.first:b.first + b.n], np.diff(cut), bucket.astype(np.int32), value.astype(np.float32)))
    if held:
        close()
    if fitted:
        yield _packed(fitted, weights, bias)


def _packed(fitted: int, weights: np.ndarray, bias: int):
    return pa.RecordBatch.from_pylist([{"fitted": fitted, "weights": weights.tobytes(), "bias": bias}])


def _added(batches):
    rows = [0, np.zeros(2 * BUCKETS, np.int64), 0]
    for row in (r for batch in batches for r in batch.to_pylist()):
        rows = [rows[0] + row["fitted"], rows[1] + np.frombuffer(row["weights"], np.int64), rows[2] + row["bias"]]
    yield _packed(*rows)


def fit(docs: DataFrame, labels: DataFrame, part: int = PART, steps: int = 80) -> Classifier:
    """Fits on all labelled documents outside the held-out fold; every fourth of them calibrates instead.

    The documents are dealt by the hash of their id into parts of about `part`; a task fits a part at a time (a document
    has at most 2 * `BUCKETS` values, 8 bytes each). The classifier is the mean of the parts' calibrated logits, which is
    linear again. At most `TASKS` rows of weights are added up by one task, and only their sum comes to the driver.
    Without documents of both labels every text gets probability 1.
    """
    ship(docs.sparkSession)
    counts = {r["quality"]: r["count"] for r in _known(docs, labels).groupBy("quality").count().collect()}
    if len(counts) < 2:
        return Classifier(np.zeros(2 * BUCKETS), 0.0, 0.0, 30.0)
    parts = max(1, math.ceil(sum(counts.values()) / part))
    own = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(parts)).cast("int")
    rows = labelled_texts(docs, labels).withColumn("part", own)
    tasks = rows.repartition(min(parts, TASKS), "part").sortWithinPartitions("part", "doc_id").select("part", "quality", "text")
    kind = "fitted long, weights binary, bias long"
    row = tasks.mapInArrow(lambda batches: _fit_of(batches, steps), kind).repartition(1).mapInArrow(_added, kind).first()
    total = row["fitted"] * UNIT
    return Classifier(np.frombuffer(row["weights"], np.int64) / total, row["bias"] / total, 1.0, 0.0)


def _known(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels of ids that docs holds."""
    return clean_labels(labels).join(docs.select(F.col("doc_id").alias("_id")).distinct(), "_id", "left_semi")


def fit_arrays(cut: np.ndarray, bucket: np.ndarray, value: np.ndarray, good: np.ndarray, steps: int = 80, rate: float = 0.05, penalty: float = 1e-4) -> Classifier:
    """Adagrad on the mean logistic loss, both labels weighing alike; then a line through the logits of the rest."""
    n = len(good)
    train = np.arange(n) % 4 != 3
    if n < 8 or good[train].min() == good[train].max():
        return Classifier(np.zeros(2 * BUCKETS), 0.0, 0.0, 30.0 if not n or good.mean() >= 0.5 else -30.0)
    # texts of about a million n-grams at a time, so that only their products are held besides the rows themselves
    parts, i = [], 0
    while i < n:
        k = max(i + 1, int(np.searchsorted(cut, cut[i] + (1 << 20), side="right")) - 1)
        parts.append((i, k))
        i = k

    def dot(w):
        z = np.zeros(n)
        for i, k in parts:
            own = np.repeat(np.arange(k - i), np.diff(cut[i:k + 1]))
            z[i:k] = np.bincount(own, weights=w[bucket[cut[i]:cut[k]]] * value[cut[i]:cut[k]], minlength=k - i)
        return z

    def back(e):
        out = np.zeros(2 * BUCKETS)
        for i, k in parts:
            out += np.bincount(bucket[cut[i]:cut[k]], weights=np.repeat(e[i:k], np.diff(cut[i:k + 1])) * value[cut[i]:cut[k]], minlength=2 * BUCKETS)
        return out

    share = np.where(train, np.where(good == 1, 0.5 / max(good[train].sum(), 1), 0.5 / max((1 - good[train]).sum(), 1)), 0.0)
    w, b, gw, gb = np.zeros(2 * BUCKETS), 0.0, np.full(2 * BUCKETS, 1e-6), 1e-6
    for _ in range(steps):
        e = share * (1 / (1 + np.exp(-np.clip(b + dot(w), -30, 30))) - good)
        slope = back(e) + penalty * w
        gw += slope ** 2
        gb += e.sum() ** 2
        w -= rate * slope / np.sqrt(gw)
        b -= rate * e.sum() / np.sqrt(gb)
    z = b + dot(w)
    rest = ~train if (~train).sum() >= 4 and good[~train].min() != good[~train].max() else np.ones(n, bool)
    return Classifier(w, b, *_line(z[rest], good[rest]))


def _line(z: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (z, good); smoothed targets keep it finite when z separates them."""
    up, down = good.sum(), (1 - good).sum()
    target = np.where(good == 1, (up + 1) / (up + 2), 1 / (down + 2))
    share = np.where(good == 1, 0.5 / up, 0.5 / down)
    x, a = np.stack([z, np.ones(len(z))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        slope = x.T @ (share * (p - target)) + 1e-6 * a
        curve = (x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        a = a - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(a[0]), float(a[1])) if a[0] > 0 else (0.0, 30.0)


def judge(docs: DataFrame, model: Classifier, prefix: str = "") -> DataFrame:
    """The given rows with the base counts, base_failed, probability and kept, each name after `prefix`; columns of these names are replaced.

    Null text counts as the empty one: all counts 0, base_failed true, kept false. No row is dropped or combined.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def start():
        classifier = Classifier(*shared.value)

        def work(column):
            parts = []
            for block in T.blocks(column):
                starts, ends, texts = T.spans(block)
                words = T.hashes(block.data, starts, ends)
                c = T.counts(block, starts, ends, texts, words)
                failed = (c.n_words < MIN_WORDS) | (100 * c.n_repeat_words > MAX_REPEAT_PERCENT * c.n_words)
                p = classifier.probability(logits(block, texts, words, classifier))
                parts.append([*[getattr(c, name) for name in BASE_COLUMNS], failed, p, ~failed & (p >= KEEP_FROM)])
            kinds = [pa.int64()] * len(BASE_COLUMNS) + [pa.bool_(), pa.float64(), pa.bool_()]
            return [pa.array(np.concatenate(x) if x else [], kind) for x, kind in zip(list(zip(*parts)) or [[]] * len(kinds), kinds, strict=True)]

        return work

    added = [(name, "long") for name in BASE_COLUMNS] + [(f"{prefix}base_failed", "boolean"), (f"{prefix}probability", "double"), (f"{prefix}kept", "boolean")]
    return beside(docs, [(prefix + n.removeprefix(prefix), kind) for n, kind in added], start)


def rules_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, probability, kept. Rows that share an id are judged each by its text.

    A null text has no words, so it fails the base rules. Extra columns are not read; an empty table gives no rows.
    """
    return judge(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", *BASE_COLUMNS, "base_failed", "probability", "kept")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass the rules and the classifier, with their columns."""
    own = free(docs, "__")
    return judge(docs, fit(docs, labels), own).filter(F.col(f"{own}kept")).select(*[F.col(quoted(c)) for c in docs.columns])

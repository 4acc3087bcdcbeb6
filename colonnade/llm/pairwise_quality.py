"""Quality scores by Bradley-Terry ranking.

A document's strength is a weighted sum of features of its whole text. The weights are learned from preference pairs,
a document of label 1 over one of label 0, by logistic loss on the difference of their features. All pairs of all
labelled documents count: a pair's loss depends on two strengths only, so each Newton step adds documents up in fine bins
of their strength and pairs the bins. The cut-off is the quantile of the training strengths at the share of label 0
among the labels, exact over all of them. Sums are whole numbers, so partitioning does not change the scores.
"""

from __future__ import annotations

import math
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colonnade.functions.quantiles import order_statistics
from colonnade.llm import textops as T
from colonnade.llm.runtime import beside, free, quoted, ship, stored, text_of
from colonnade.llm.samples import clean_labels, held_out

CUT = 0.7
FEATURES = ("log_words", "word_length", "symbols", "upper", "digits", "marks", "stops", "bars", "lower", "distinct",
            "adjacent", "repeated", "duplicate_lines", "line_length", "wide", "bare")
BARS = T.table_of("|")
BINS, COARSE = 4096, 64  # bins of the strength, for sums and for products of features
UNIT = float(1 << 20)  # features are added up in whole parts of this
ROUNDS = 40  # most Newton steps
TASKS = 64  # tasks of a pass over the labelled features, each sending about 1 MB of sums


class Ranker(NamedTuple):
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def scaled(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.center) / self.scale, -8, 8)

    def strength(self, features: np.ndarray) -> np.ndarray:
        strength = np.zeros(len(features))
        for column, weight in zip(self.scaled(features).T, self.weights, strict=True):  # one order of addition, whatever the block
            strength = strength + column * weight
        return strength

    def score(self, features: np.ndarray) -> np.ndarray:
        """In (0, 1), rising with the strength, `CUT` at the cut-off."""
        if not len(features):
            return np.zeros(0)
        strength = self.strength(features)
        z = self.slope * (strength - self.cut) + np.log(CUT / (1 - CUT))
        score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return np.where(strength >= self.cut, np.maximum(score, CUT), np.minimum(score, np.nextafter(CUT, 0)))


def features(block: T.Block) -> np.ndarray:
    """A row per text, columns `FEATURES`; all zero for a text without words."""
    starts, ends, texts = T.spans(block)
    words = T.hashes(block.data, starts, ends)
    c = T.counts(block, starts, ends, texts, words)
    n, chars = np.maximum(c.n_words, 1), np.maximum(c.word_chars, 1)
    share = lambda table: T.byte_sums(block, table) / chars
    one = np.zeros(len(words), dtype=bool)
    if len(words):
        one = T.IS_SPACE[block.data[starts]] | ((ends - starts == 1) & (T.SYMBOLS[block.data[starts]] > 0))
    out = np.stack([
        np.log1p(c.n_words), c.word_chars / n, np.sqrt(c.n_symbols / chars), np.sqrt(share(T.UPPER)), np.sqrt(share(T.DIGITS)),
        np.sqrt(share(T.MARKS)), np.sqrt(share(T.STOPS)), np.sqrt(share(BARS)), share(T.LOWER), c.n_distinct / n, np.sqrt(c.n_adjacent / n),
        np.sqrt(c.n_repeat_words / n), np.sqrt(c.n_dup_lines / np.maximum(c.n_lines, 1)), np.log1p(c.n_words / np.maximum(c.n_lines, 1)),
        1 - T.byte_sums(block, T.LEADS) / np.maximum(np.diff(block.borders), 1), np.sqrt(T.per_text(texts[one], block.n) / n),
    ], axis=1)
    out[c.n_words == 0] = 0
    return out


def _features_of(batches):
    """Arrow batches (doc_id, text, ...) to (doc_id, ..., x)."""
    for batch in batches:
        rows = [features(b) for b in T.blocks(batch.column("text"))]
        x = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
        kept = [i for i, name in enumerate(batch.schema.names) if name != "text"]
        flat = pa.array(x.ravel(), pa.float64())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [lists], [batch.schema.names[i] for i in kept] + ["x"])


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(quality, x) of all labelled documents outside the held-out fold, stored. Only features are shuffled, no texts.

    A doc_id that several rows share brings the smallest of its features.
    """
    ship(docs.sparkSession)
    known = docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", text_of().alias("text"))
    rows = known.mapInArrow(_features_of, StructType([known.schema["doc_id"], *StructType.fromDDL("x array<double>")]))
    found = rows.groupBy("doc_id").agg(F.min("x").alias("x")).join(clean_labels(labels), F.col("doc_id") == F.col("_id"))
    return stored(found.select("quality", "x"), "features")


def fit(docs: DataFrame, labels: DataFrame, penalty: float = 1e-3) -> Ranker:
    """Learns from all pairs of labelled documents outside the held-out fold.

    Without a document of either label all weights are 0 and every document scores `CUT`.
    """
    rows = labelled_features(docs, labels)
    d, n = len(FEATURES), {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    if len(n) < 2:
        return Ranker(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0)
    center, scale = _moments(rows)
    w = np.zeros(d)
    for _ in range(ROUNDS):  # Newton steps on the mean logistic loss of all pairs
        slope, curve = _pair_slopes(*_binned(rows, center, scale, w))
        step = np.linalg.solve(curve + penalty * np.eye(d), slope + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-3:  # the next step would be of the size of the bins
            break
    model = Ranker(center, scale, w, 0.0, 1.0)

    def strengths(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.strength(_matrix(batch)), pa.float64())], ["v"])

    # half-way between the neighbours of the cut in the order of all strengths
    place = (n[0] - 0.5) / (n[0] + n[1] - 1)
    cut = order_statistics(rows.mapInArrow(strengths, "v double").select(F.lit("all").alias("grp"), "v"), [place])["all"][0]
    return model._replace(cut=float(cut))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each feature, from exact decimal sums."""
    exact = lambda x: F.sum(x.cast("decimal(38,10)"))
    sums = (rows.select(F.posexplode("x").alias("i", "v")).groupBy("i")
            .agg(F.count("*").alias("n"), exact(F.col("v")).alias("one"), exact(F.col("v") * F.col("v")).alias("two")).orderBy("i").collect())
    means = [Fraction(r["one"]) / r["n"] for r in sums]
    spread = [math.sqrt(max(0, Fraction(r["two"]) / r["n"] - m * m)) for r, m in zip(sums, means, strict=True)]
    return np.array([float(m) for m in means]), np.maximum(spread, 1e-6)


def _bin_sums(batches, model: Ranker):
    """Per label and bin of the strength: documents and sums of their scaled features; per label and coarse bin: sums of products."""
    d, half = len(FEATURES), 8 * np.abs(model.weights).sum() + 1e-9
    lines, squares = np.zeros((2 * BINS, 1 + d), np.int64), np.zeros((2 * COARSE, d * d), np.int64)
    for batch in batches:
        z, good = model.scaled(_matrix(batch)), batch.column("quality").to_numpy()
        place = np.clip(np.floor((model.strength(_matrix(batch)) + half) / (2 * half) * BINS), 0, BINS - 1).astype(np.int64)
        np.add.at(lines, good * BINS + place, np.concatenate([np.full((len(z), 1), int(UNIT)), np.rint(z * UNIT)], 1).astype(np.int64))
        products = np.rint(z[:, :, None] * z[:, None, :] * UNIT).astype(np.int64).reshape(len(z), d * d)
        np.add.at(squares, good * COARSE + place * COARSE // BINS, products)
    yield lines, squares


def _binned(rows: DataFrame, center: np.ndarray, scale: np.ndarray, w: np.ndarray):
    """The bins' sums over all rows and the weights that they belong to. Tasks send sums of a fixed size, one task adds them."""
    model = Ranker(center, scale, w, 0.0, 1.0)
    packed = lambda lines, squares: pa.RecordBatch.from_pylist([{"lines": lines.tobytes(), "squares": squares.tobytes()}])

    def each(batches):
        for sums in _bin_sums(batches, model):
            yield packed(*sums)

    def total(batches):
        out = None
        for row in (r for batch in batches for r in batch.to_pylist()):
            sums = [np.frombuffer(row[k], np.int64) for k in ("lines", "squares")]
            out = sums if out is None else [a + b for a, b in zip(out, sums, strict=True)]
        if out is not None:
            yield packed(*out)

    kind = "lines binary, squares binary"
    row = rows.coalesce(TASKS).mapInArrow(each, kind).repartition(1).mapInArrow(total, kind).first()
    d = len(FEATURES)
    lines = np.frombuffer(row["lines"], np.int64).reshape(2, BINS, 1 + d) / UNIT
    return lines, np.frombuffer(row["squares"], np.int64).reshape(2, COARSE, d, d) / UNIT, w


def _pair_slopes(lines: np.ndarray, squares: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of the mean loss over all pairs; a bin's documents stand at their mean strength."""
    d, (at0, at1) = len(w), [np.flatnonzero(part[:, 0]) for part in lines]
    worse, better = lines[0][at0], lines[1][at1]
    s0, s1 = worse[:, 1:] @ w / worse[:, 0], better[:, 1:] @ w / better[:, 0]
    slope, curve, weights = np.zeros(d), np.zeros((d, d)), [np.zeros(BINS), np.zeros(BINS)]
    for i in range(0, len(at1), 256):
        part = better[i:i + 256]
        p = 1 / (1 + np.exp(np.clip(s1[i:i + 256, None] - s0, -30, 30)))  # how much the model doubts the pair
        c = p * (1 - p)
        slope -= (p @ worse[:, 0]) @ part[:, 1:] - (part[:, 0] @ p) @ worse[:, 1:]
        cross = part[:, 1:].T @ c @ worse[:, 1:]
        curve -= cross + cross.T
        weights[1][at1[i:i + 256]] = c @ worse[:, 0]
        weights[0][at0] += part[:, 0] @ c
    for label in (0, 1):  # mean weight of a document of a coarse bin
        n = lines[label][:, 0].reshape(COARSE, -1)
        mean = (weights[label].reshape(COARSE, -1) * n).sum(1) / np.maximum(n.sum(1), 1)
        curve += np.tensordot(mean, squares[label], 1)
    pairs = worse[:, 0].sum() * better[:, 0].sum()
    return slope / pairs, curve / pairs


def score(docs: DataFrame, model: Ranker, column: str = "score") -> DataFrame:
    """The given rows with one more column, `column` (replaced if it is there): the score of the whole text.

    A null text counts as the empty one, whose score is that of an all-zero feature row. Rows are neither dropped nor
    combined; other columns, whatever their names, pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def start():
        ranker = Ranker(*shared.value)

        def work(texts):
            parts = [ranker.score(features(b)) for b in T.blocks(texts)]
            return [pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())]

        return work

    return beside(docs, [(column, "double")], start)


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 from a score of `CUT`).

    Null texts score as empty ones; rows that share an id stay rows of their own, each scored by its text. Extra columns
    are not read; an empty table gives no rows.
    """
    model = fit(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches the cut-off, with their columns."""
    own = free(docs, "__score")
    return score(docs, fit(docs, labels), own).filter(F.col(own) >= CUT).select(*[F.col(quoted(c)) for c in docs.columns])

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colonnade.llm import pairwise_quality, rules, textops

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_ranking_on_held_out_labels(spark, tables):
    docs, labels = tables
    rows = pairwise_quality.quality_table(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert sum(g > b for g in good for b in bad) >= 0.97 * len(good) * len(bad)


def test_held_out_labels_are_never_read(spark, tables):
    docs, labels = tables
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    a = {r.doc_id: r.score for r in pairwise_quality.quality_table(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in pairwise_quality.quality_table(docs, flipped).collect()}


def test_rules_on_labels(spark, tables):
    docs, labels = tables
    rows = rules.rules_table(docs, labels).join(labels, "doc_id").collect()
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.probability >= rules.KEEP_FROM)
    judged = [r for r in rows if not r.base_failed]
    assert sum(r.kept == r.quality for r in judged) >= 0.97 * len(judged)


def test_without_both_labels(spark, tables):
    docs, labels = tables
    good = labels.filter("quality = 1")
    assert {r.predicted for r in pairwise_quality.quality_table(docs, good).collect()} == {1}
    assert {r.kept == (not r.base_failed) for r in rules.rules_table(docs, good).collect()} == {True}


def made(spark):
    """600 documents of noisy words, the worse ones with more symbols, repeats and short lines; labels for half of them."""
    draw, rows = np.random.default_rng(5), []
    for i in range(600):
        bad = i % 3 == 0
        words = [f"w{draw.integers(30 if bad else 90)}{'#' if draw.random() < (0.2 if bad else 0.12) else ''}" for _ in range(draw.integers(20, 120))]
        rows.append((i, "".join(w + ("\n" if draw.random() < (0.2 if bad else 0.15) else " ") for w in words), int(bad == (draw.random() < 0.1))))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, q) for i, _, q in rows if i % 2], "doc_id long, quality int")


def learned_rows(docs, labels):
    """Labelled texts outside the held-out fold, by id."""
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality").collect()
    return sorted((r.doc_id, r.text or "", r.quality) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2)


def block_of(texts):
    return next(textops.blocks(pa.array(texts), 1 << 40))


def test_ranking_learns_from_all_pairs(spark):
    docs, labels = made(spark)
    rows = learned_rows(docs, labels)
    x, good = pairwise_quality.features(block_of([t for _, t, _ in rows])), np.array([q for _, _, q in rows])
    model = pairwise_quality.fit(docs, labels)
    assert np.allclose(model.center, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-6), atol=1e-5)
    z, w = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-6), -8, 8), np.zeros(x.shape[1])
    gaps = (z[good == 1][:, None] - z[good == 0]).reshape(-1, x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(gaps @ w, -30, 30)))
        slope, curve = gaps.T @ (p - 1) / len(gaps) + 1e-3 * w, (gaps * (p * (1 - p))[:, None]).T @ gaps / len(gaps) + 1e-3 * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    assert np.abs(model.weights - w).max() < 2e-3 * np.abs(w).max()
    order, k = np.sort(model.strength(x)), int((good == 0).sum())
    assert abs(model.cut - (order[k - 1] + order[k]) / 2) < 1e-9


def test_rules_learn_from_all_parts(spark):
    docs, labels = made(spark)
    rows = learned_rows(docs, labels)
    parts = {r.doc_id: r.part for r in docs.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(3)).alias("part")).collect()}
    weights, bias = np.zeros(2 * rules.BUCKETS), 0.0
    for part in range(3):
        own = [(t, q) for i, t, q in rows if parts[i] == part]
        m = rules.fit_arrays(*rules.rows_of(block_of([t for t, _ in own])), np.array([q for _, q in own], float))
        weights, bias = weights + m.slope * m.weights / 3, bias + (m.slope * m.bias + m.shift) / 3
    model = rules.fit(docs, labels, part=-(-len(rows) // 3))
    assert np.allclose(model.weights, weights, rtol=1e-3, atol=1e-4) and abs(model.bias - bias) < 1e-3 and (model.slope, model.shift) == (1.0, 0.0)

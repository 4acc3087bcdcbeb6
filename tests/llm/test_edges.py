"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colonnade.llm import fingerprints, html_text, licenses, mixing, near_copies, packing, pairwise_quality, rules, token_counts, url_filter
from colonnade.llm.tokens import public_path

LONG = "lorem ipsum dolor sit amet " * 9000
ROWS = [(1, "a b c d e f", "s"), (2, None, None), (3, "", "s"), (None, "x y", "t"), (None, None, "t"), (1, "a b c d e f", "s"), (4, LONG, "u"), (5, "a b c d e f", "s"),
        (6, "one two \t\n three <|endoftext|> é", "s"), (1, "other text under the same id", "v")]
EXTRA = "score double, kept boolean, text_id long, `a.b` string, Size long, probability double, label int, x array<int>, vertex string, _kept int, _text_id int, __score int, __n_words int, id int, digest int, least int"


def table(spark, rows):
    full = [(i, t, "en", s, len(t or ""), 0.5, True, 7, "z", 3, 0.1, 2, [1], "v", 11, 12, 13, 14, 15, 16, 17) for i, t, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA)


def labels(spark):
    return spark.createDataFrame([(1, 1), (3, 0), (4, 0), (5, 1), (None, 1), (6, None), (1, 1)], "doc_id long, quality int")


OPERATORS = {
    "fingerprints": lambda spark, d: fingerprints.fingerprint_table(d),
    "near_copies": lambda spark, d: near_copies.near_copies(d),
    "packing": lambda spark, d: packing.packed(d, public_path("word_bpe_49k.json")).groupBy("doc_id").agg(F.sum("length").alias("length")),
    "token_counts": lambda spark, d: token_counts.token_counts(d, public_path("byte_bpe_50k.json")),
    "mixture": lambda spark, d: mixing.mixture(d),
    "licenses": lambda spark, d: licenses.scan(d),
    "quality": lambda spark, d: pairwise_quality.quality_table(d, labels(spark)),
    "rules": lambda spark, d: rules.rules_table(d, labels(spark)),
    "urls": lambda spark, d: url_filter.judged(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), "label", "probability"), url_filter.fit(url_filter.seeded(d.withColumnRenamed("text", "url")))),
    "html": lambda spark, d: html_text.main_texts(d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), "x")),
}
PER_ROW = [n for n in OPERATORS if n not in ("packing",)]


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = OPERATORS[name](spark, table(spark, ROWS)).collect()
    assert len(got) == (len(ROWS) if name in PER_ROW else 7)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, table(spark, ROWS).limit(0)).collect() == []


@pytest.mark.parametrize("name", ["fingerprints", "mixture", "token_counts", "quality", "rules", "near_copies", "licenses", "urls", "html"])
def test_equal_rows_and_runs_agree(spark, name):
    key = lambda r: tuple(map(str, r))
    d = table(spark, ROWS)
    assert sorted(map(key, OPERATORS[name](spark, d).collect())) == sorted(map(key, OPERATORS[name](spark, d.repartition(5)).collect()))


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns(spark, tmp_path, stage):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (ROWS, []):
        docs = table(spark, ROWS).limit(len(rows))
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        out.collect()


def test_null_ids_are_kept_once_per_text(spark):
    kept = near_copies.one_of_each(table(spark, ROWS)).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:12]) for r in kept if r.doc_id != 1) == [(0, "x y"), (2, ""), (4, LONG[:12]), (6, ROWS[8][1][:12])]
    assert sorted(r.text for r in kept if r.doc_id == 1) == ["a b c d e f", "other text under the same id"]
    assert {(r._kept, r._text_id, r["__score"], r["__n_words"], r.id, r.least) for r in kept} == {(11, 12, 13, 14, 15, 17)}

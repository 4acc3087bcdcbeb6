"""Lexical search against a direct computation."""

import math
import re
from collections import Counter

from colonnade.llm import lexical_search as S

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, best=10):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    held = [h for h in held if h[2]]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    wanted = {}
    for item, text in dict.fromkeys(items):
        wanted.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, query in wanted.items():
        rows = []
        for d, c, n in held:
            m = 25 + (75 * n * n_docs) // length
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in query.items() if c[t])
            if score > 0:
                rows.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -score) for i, (score, none, d) in enumerate(sorted(rows)[:best])]
    return out


def test_terms():
    text = "Ab1-é_ÄB\x7fzİK\x00x @[`{ 9"
    assert S.term_counts(text.encode()) == (6, Counter(t.encode() for t in terms(text)))
    assert S.term_counts(b"") == S.term_counts(b" .-") == (0, Counter())


def test_long_texts_are_split_at_blanks(monkeypatch):
    text = "Alpha beta-gamma " * 500 + "x" * 400 + " end"
    whole = S.term_counts(text.encode())
    monkeypatch.setattr(S, "PIECE", 7)
    assert S.term_counts(text.encode()) == whole == (1502, Counter({b"alpha": 500, b"beta": 500, b"gamma": 500, b"x" * 400: 1, b"end": 1}))


DOCS = [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 3 + i % 9))) for i in range(1, 120)]
DOCS += [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (3, "w1 W1 w1-w1"), (3, "w1 W1 w1-w1"), (400, None), (401, ""), (402, "..."), (500, "w5 " * 30000 + "w6"), (7, "other text under the same id w9")]
ITEMS = [(1, "W1 w2 w2, w3?"), (2, "w5 w6 unknown"), (3, None), (4, ""), (5, "nothing of this occurs"), (1, "w9"), (1, "w9"), (None, "w4 w8"), (6, "w1")]


def run(spark, docs, items, parts=3):
    d = spark.createDataFrame([(i, t, 1.0, "r", 2) for i, t in docs], "doc_id long, text string, score double, rank string, terms int").repartition(parts)
    q = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, n int")
    return sorted((tuple(r) for r in S.ranked(d, q).collect()), key=str)


def test_equals_brute_force(spark):
    want = sorted(brute(DOCS, ITEMS), key=str)
    assert run(spark, DOCS, ITEMS) == run(spark, DOCS, ITEMS, 9) == want
    assert {i for i, *_ in want} == {1, 2, 6, None}


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "ITEM_BYTES", 16)
    monkeypatch.setattr(S, "WORK", 50)
    assert run(spark, DOCS, ITEMS) == sorted(brute(DOCS, ITEMS), key=str)


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == run(spark, DOCS, []) == run(spark, DOCS, [(1, None)]) == run(spark, [(1, "")], ITEMS) == []
    empty = S.ranked(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"))
    assert [t for _, t in empty.dtypes] == ["bigint", "int", "bigint", "bigint"]

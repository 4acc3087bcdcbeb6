import random

import numpy as np
import pyarrow as pa
import pytest

from colonnade.llm import near_copies as nc
from colonnade.llm import textops as T
from colonnade.llm.components import components

WORDS = [f"w{i}" for i in range(3000)]


def edited(draw, text, n):
    words = text.split()
    for i in draw.sample(range(len(words)), n):
        words[i] = draw.choice(WORDS)
    return " ".join(words)


def runs(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def like(a, b):
    x, y = runs(a), runs(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def classes(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(texts)):
        for k in range(i):
            if like(texts[i], texts[k]) >= 0.8:
                a, b = find(i), find(k)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def corpus(seed, groups, per, words, edits):
    draw = random.Random(seed)
    texts = [" ".join(draw.choices(WORDS, k=words)) for _ in range(groups)]
    texts += [edited(draw, t, draw.choice(edits)) for t in texts for _ in range(per)]
    texts += texts[:5] + ["", "short one", "short one", "a b c d e"]
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("few", [32, 3])
def test_classes_match_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(nc, "FEW", few)
    monkeypatch.setattr(nc, "SIDE", 5)
    monkeypatch.setattr(nc, "HOT", 4)
    texts = corpus(3, 12, 9, 150, (0, 1, 2, 3, 4, 5, 7))
    got = nc.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.class_id for r in sorted(got, key=lambda r: r.doc_id)] == classes(texts)
    kept = nc.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(classes(texts)))


@pytest.mark.parametrize("few", [32, 3])
def test_repeated_lines_match_brute_force(spark, monkeypatch, few):
    # equal but for a line repeated often: plain Jaccard about 0.94 and J_P about 0.29, so the weighted bands rarely meet
    monkeypatch.setattr(nc, "FEW", few)
    monkeypatch.setattr(nc, "SIDE", 5)
    draw = random.Random(7)
    base = [" ".join(draw.choices(WORDS, k=300)) for _ in range(8)]
    lines = [" ".join(draw.choices(WORDS, k=12)) for _ in base]
    texts = base + [f"{t}\n" + "\n".join([line] * n) for t, line in zip(base, lines, strict=True) for n in (60, 25)] + ["\n".join([line] * 40) for line in lines[:3]]
    draw.shuffle(texts)
    got = nc.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.class_id for r in sorted(got, key=lambda r: r.doc_id)] == classes(texts)


def exact_jp(a, b):
    keys = set(a) | set(b)
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in keys) for i in set(a) & set(b))


def test_sketch_estimates_probability_jaccard():
    draw = np.random.default_rng(1)
    for overlap in (0.2, 0.6, 0.9):
        keys = draw.integers(1, 1 << 62, size=400).astype(np.uint64)
        a = {int(k): int(w) for k, w in zip(keys[:300], draw.integers(1, 6, 300))}
        cut = int(300 * (1 - overlap))
        b = {k: a.get(k, int(w)) for k, w in zip(map(int, keys[cut:cut + 300]), draw.integers(1, 6, 300))}
        h = np.array([*sorted(a), *sorted(b)], np.uint64)
        t = np.repeat([0, 1], [len(a), len(b)])
        w = np.array([*[a[k] for k in sorted(a)], *[b[k] for k in sorted(b)]])
        s = nc.sketches(h, t, w, 2, 4000)
        assert abs((s[0] == s[1]).mean() - exact_jp(a, b)) < 0.04
        pair = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        jp, j = nc.similarities(*pair)
        assert jp == pytest.approx(exact_jp(a, b)) and j == pytest.approx(len(set(a) & set(b)) / len(set(a) | set(b)))


def test_weight_scale_does_not_matter():
    h, t = np.arange(1, 41, dtype=np.uint64), np.zeros(40, np.int64)
    w = np.arange(1, 41)
    assert (nc.sketches(h, t, w, 1, 64) == nc.sketches(h, t, w * 1, 1, 64)).all()
    assert nc.similarities((h, w), (h, 2 * w))[0] == pytest.approx(1.0)


def test_overlaps():
    draw = random.Random(2)
    sets = [np.array(sorted(draw.sample(range(1, 60), draw.randint(0, 30))), np.uint64) for _ in range(9)]
    got = nc.overlaps(sets[:4], sets[4:], width=7)
    assert got.tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in sets[4:]] for x in sets[:4]]


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 430)]
    root = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {v: root[v] for a, b in edges if a != b for v in (a, b)}


def test_runs_of_short_texts():
    block = next(T.blocks(pa.array(["a b", "a  b", "a b c d e", ""])))
    h, t, w = nc.weighted_runs(block)
    assert t.tolist() == [0, 1, 2] and h[0] == h[1] != h[2] and w.tolist() == [1, 1, 1]

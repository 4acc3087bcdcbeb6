from colonnade.llm import mixing


def spread(sizes, weights):
    """Targets by repeated resharing."""
    total, closed = sum(sizes), {}
    while True:
        rest = total - sum(closed.values())
        open_ = [i for i in range(len(sizes)) if i not in closed]
        share = {i: rest * weights[i] / sum(weights[k] for k in open_) for i in open_}
        over = [i for i in open_ if share[i] > 3 * sizes[i]]
        if not over:
            return [closed.get(i, share.get(i)) for i in range(len(sizes))]
        closed.update({i: 3.0 * sizes[i] for i in over})


def test_targets_and_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_CELL", 5)
    sizes = {"a": [100] * 30, "b": [1, 2], "c": [7, 0, 9], "é": [400, 600], None: [3]}
    docs = [(i, "w " * n, s) for i, (s, n) in enumerate((s, n) for s, v in sizes.items() for n in v)] + [(999, None, "a")]
    rows = mixing.mixture(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    want = dict(zip(sizes, spread([sum(v) for v in sizes.values()], [1, 2, 3, 1, 2]), strict=True))
    for source, target in want.items():
        own = [r for r in rows if r.source == source]
        assert all(abs(r.target - target) < 1e-6 and r.source_size == sum(sizes[source]) for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 0.5
    assert all(0 <= r.taken <= 3 * r.size and 0 <= r.position <= 1 for r in rows)


def test_training_order(spark):
    docs = [(i, f"a{i}  b\tc\nd " * (i % 5 + 1), f"s{i % 3}", "en") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    taken = {r.doc_id: r.taken for r in mixing.mixture(df).collect()}
    copies = mixing.training_order(df).collect()
    words = {}
    for r in copies:
        assert dict((d[0], d[1]) for d in docs)[r.doc_id].startswith(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {k: v for k, v in taken.items() if v}
    # light sources are read early, heavy ones late
    place = lambda s: [i for i, r in enumerate(copies) if r.source == s]
    mean = {s: sum(place(s)) / len(place(s)) for s in ("s0", "s2")}
    assert mean["s0"] < mean["s2"]


def test_mixture_is_read_off_the_sorted_copies(spark, monkeypatch):
    docs = [(i % 40, f"a{i}  b\tc\nd " * (i % 5), f"s{i % 3}") for i in range(60)] + [(1, "a1 b", "s1"), (1, "a1 b", "s1"), (None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    sort, seen = mixing.time_sorted, []
    monkeypatch.setattr(mixing, "time_sorted", lambda d: seen.append(sort(d)) or seen[-1])
    rows = mixing.mixture(df).collect()
    order = [(r._time, r._got) for r in seen[0].collect()]
    assert [t for t, _ in order] == sorted(t for t, _ in order)
    assert len(rows) == len(docs) and sum(r.taken for r in rows) == sum(n for _, n in order)
    first = sorted(r.position for r in rows if r.taken)
    assert set(first) <= {t for t, _ in order} and first[0] == order[0][0]

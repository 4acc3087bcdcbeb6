"""SimHash fingerprints, links and components against brute force."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from colonnade.llm import simhash as S
from colonnade.llm.components import _large_star, _small_star


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Smallest id per row of (id, print), by comparing all prints."""
    kinds = sorted(set(p for _, p in prints))
    root = {p: p for p in kinds}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(kinds):
        for q in kinds[:i]:
            if (p ^ q).bit_count() <= 3:
                root[find(p)] = find(q)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return [least.get(find(p)) for _, p in prints]


TEXTS = ["", " \t\n", "One", "one two", "One two\x0bthree", "one TWO three four", "é à Ä É ẞ", "a b c " * 400, "x" * 5000 + " y z", "no break space here now", "a a a a a"]


def test_prints(monkeypatch):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    assert [S.fingerprint(t.encode()) for t in texts] == [slow_print(t) for t in texts]
    monkeypatch.setattr(S, "PIECE", 5)
    assert [S.fingerprint(t.encode()) for t in texts] == [slow_print(t) for t in texts]


def prints_table(spark, values):
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    return spark.createDataFrame(signed, "print long")


@pytest.mark.parametrize("crowded", [1, 4, 1000])
def test_links_are_all_pairs_within_three_bits(spark, crowded):
    """Balls around centres, prints that share a half, extremes; with crowded keys and without."""
    rng = random.Random(crowded)
    values = {0, (1 << 64) - 1, 1, 7, 15, 1 << 63}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(14):
            value = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                value ^= 1 << b
            values.add(value)
        high = centre >> 32 << 32
        values |= {high | rng.getrandbits(32) for _ in range(8)} | {high | rng.getrandbits(3) for _ in range(6)}
    values = sorted(values)
    want = {frozenset((p, q)) for i, p in enumerate(values) for q in values[:i] if (p ^ q).bit_count() <= 3}
    got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in S.links(prints_table(spark, values), crowded).collect()]
    assert len(got) == len(want) and {frozenset(p) for p in got} == want


def test_components_of_odd_rows(spark):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 999)}" for _ in range(900)]
    near = [" ".join(base[:k] + ["changed"] + base[k:]) for k in range(0, 900, 60)]
    rows = [(i, t) for i, t in enumerate(TEXTS + near)] + [(None, None), (None, "only here and without an id"), (3, near[0]), (3, near[0]), (90, None), (91, "One Two")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in rows], "doc_id long, text string, print string, least int, root double").repartition(5)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    prints = [(i, slow_print(t)) for i, t in rows]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, components(prints), strict=True)]
    assert got == sorted(want, key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(docs, crowded=1).collect()), key=str) == got
    assert S.near_duplicates(docs.limit(0)).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in S.near_duplicates(docs).collect()}
    rows = [(r.doc_id, slow_print(r.text)) for r in docs.collect()]
    assert {i: (p, c) for (i, p), c in zip(rows, components(rows), strict=True)} == got
    assert docs.filter(F.col("text").isNull()).count() + len(got) >= 200


def test_no_table_of_fingerprints_goes_through_the_driver(spark, tmp_path):
    """Small files of fingerprints and vertices are joined without a broadcast, whatever Spark's threshold."""
    spark.createDataFrame([(i * 7919,) for i in range(200)], "print long").write.parquet(f"{tmp_path}/prints")
    spark.createDataFrame([(i + 1, i) for i in range(200)], "a long, b long").write.parquet(f"{tmp_path}/edges")
    prints, edges = spark.read.parquet(f"{tmp_path}/prints"), spark.read.parquet(f"{tmp_path}/edges")
    docs = spark.createDataFrame([(i, "a b c " + str(i)) for i in range(20)], "doc_id long, text string")
    for table in (S.links(prints), _large_star(edges), _small_star(edges), S.near_duplicates(docs)):
        assert "Broadcast" not in table._jdf.queryExecution().executedPlan().toString()

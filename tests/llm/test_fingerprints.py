import hashlib
import re

from colonnade.llm import fingerprints as fp

WORD = re.compile("[^\x20\x09-\x0d]+")


def sketch(text):
    w = WORD.findall(text)
    runs = [" ".join(w[i:i + 5]) for i in range(len(w) - 4)] or ([" ".join(w)] if w else [])
    h = [hashlib.md5(r.encode()).hexdigest() for r in runs]
    return "1:" + ",".join(sorted({x[:16] for x in h})) if len(set(h)) <= fp.WHOLE else "8:" + ",".join(sorted({x[:16] for x in h if x < "2"}))


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fp, "DOCS_PER_BUCKET", 7)
    texts = [f"doc {i} " + " ".join(f"w{(i * k) % 97}é" for k in range(i * 5)) for i in range(60)] + ["", None, "x", "ab", "é" * 9]
    rows = [(i * i - 50, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fp.fingerprint_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    rows.sort()
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (sketch(text), sketch(edited))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.near_next == 1 or sketch(text) != sketch(after))
    assert len(got) == len(rows)


def test_unrelated_loops_differ(spark):
    """Texts that each repeat one word or line have few distinct runs, all of which they keep."""
    texts = [" ".join([f"word{i}"] * 200) for i in range(40)] + [" ".join(f"w{i}{k % 6}" for k in range(300)) for i in range(40)]
    rows = fp.fingerprint_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.near_next == 0 and r.fingerprint == sketch(texts[r.doc_id]) and len(r.fingerprint) > 2 for r in rows)


def test_merged_is_the_sketch_of_both(spark):
    words = [f"v{i * 7919 % 100003}" for i in range(400)]
    texts = ["", "a b", " ".join(words[:60]), " ".join(words[40:150]), " ".join(words[:120]), " ".join(words)]
    pairs = [(a, b) for a in texts for b in texts]
    table = spark.createDataFrame(pairs, "a string, b string")
    got = table.select("a", "b", fp.merged(fp.fingerprint(table.a), fp.fingerprint(table.b)).alias("m")).collect()
    for r in got:
        hashes = {hashlib.md5(" ".join(w[i:i + 5]).encode()).hexdigest()[:16] for w in (r.a.split(), r.b.split()) for i in range(max(len(w) - 4, bool(w)))}
        assert r.m == ("1:" + ",".join(sorted(hashes)) if len(hashes) <= fp.WHOLE else "8:" + ",".join(sorted(h for h in hashes if h < "2")))


def test_containment_of_unequal_texts(spark):
    words = [f"v{i * 7919 % 100003}" for i in range(6000)]
    long, part, other = " ".join(words), " ".join(words[1000:2500]), " ".join(reversed(words))
    r = {x.doc_id: x for x in fp.fingerprint_table(spark.createDataFrame([(1, part), (2, long), (3, other)], "doc_id long, text string")).collect()}
    assert r[1].near_next > 0.97 and abs(r[1].resemblance_next - 0.25) < 0.05 and r[2].near_next == 0

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colonnade.llm import textops as T

TEXTS = st.lists(st.one_of(st.none(), st.text("ab c\t\n\r\x0b\x0c\x1c\x85\xa0é€|#A1.", max_size=60)), max_size=12)
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    lines = [x for x in text.split("\n") if WORD.search(x)]
    for line in lines:
        dup += line in seen
        seen.add(line)
    runs = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(lines), len(set(words)),
            sum(a == b for a, b in zip(words, words[1:])))


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([1, 7, 1 << 20]))
def test_counts_match_brute_force(texts, size):
    got = []
    for block in T.blocks(pa.array(texts, pa.string()), size):
        starts, ends, owner = T.spans(block)
        c = T.counts(block, starts, ends, owner, T.hashes(block.data, starts, ends))
        got += list(zip(*[x.tolist() for x in c], strict=True))
    assert got == [brute(t or "") for t in texts]


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_words_and_hashes(texts):
    for block in T.blocks(pa.array(texts, pa.string())):
        starts, ends, owner = T.spans(block)
        words = [block.data[s:e].tobytes().decode() for s, e in zip(starts, ends)]
        assert [(int(o), w) for o, w in zip(owner, words)] == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
        h = T.hashes(block.data, starts, ends)
        assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))


def test_long_spans_and_slices():
    long = "x" * (T.BLOCK + 5) + " y " + "x" * (T.BLOCK + 5)
    column = pa.array(["skip", long, None, "y"]).slice(1)
    h = [T.hashes(b.data, *T.spans(b)[:2]).tolist() for b in T.blocks(column)]
    flat = [x for part in h for x in part]
    assert len(flat) == 4 and flat[0] == flat[2] and flat[1] == flat[3] and flat[0] != flat[1]


@pytest.mark.parametrize("k", [1, 2, 5])
def test_windows_stay_in_their_text(k):
    words = np.array([1, 2, 3, 1, 2, 3, 4, 9], np.uint64)
    texts = np.array([0, 0, 0, 1, 1, 1, 1, 3])
    h, t = T.windows(words, texts, k, whole=True)
    expect = []
    for i in (0, 1, 3):
        own = words[texts == i].tolist()
        runs = [tuple(own[j:j + k]) for j in range(len(own) - k + 1)] or [tuple(own)]
        expect += [(i, r) for r in runs]
    assert t.tolist() == [i for i, _ in expect]
    by_run = {}
    for value, (_, run) in zip(h.tolist(), expect, strict=True):
        assert by_run.setdefault(run, value) == value
    assert len(set(by_run.values())) == len(by_run)


@pytest.mark.parametrize("size", [64, 1024, 2048, 4096])
def test_long_words_have_hashes_of_their_own(size):
    """A Thue-Morse word and its complement, which a polynomial modulo 2^64 does not tell apart."""
    one = "".join("ab"[i.bit_count() & 1] for i in range(size))
    other = one.translate(str.maketrans("ab", "ba"))
    block = next(T.blocks(pa.array([f"{one} {other} {one}"])))
    starts, ends, _ = T.spans(block)
    h = T.hashes(block.data, starts, ends)
    assert h[0] == h[2] != h[1]

import struct
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from colonnade.llm import packing, token_counts, tokens

BYTES, WORDS = tokens.public_path("byte_bpe_50k.json"), tokens.public_path("word_bpe_49k.json")
TEXTS = st.lists(st.sampled_from(list("aB é1'st \t\n\r.!?# 　́ \x1c\x85日") + ["<|endoftext|>", "'ll", "  "]), max_size=60).map("".join)


def ids(path, text):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


BYTE_TOK, WORD_TOK = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_pieces_give_the_tokenizers_counts(texts):
    size, n = token_counts.counts_of(pa.array(texts, pa.string()), BYTES)
    assert n.tolist() == [len(BYTE_TOK.encode(t, add_special_tokens=False).ids) for t in texts]
    assert size.tolist() == [len(t.encode()) for t in texts]


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(2, 12), st.integers(1, 5))
def test_splicing_gives_the_tokenizers_counts(text, overlap, more):
    assert token_counts.count_spliced(text, token_counts.begins_by(BYTES), overlap + more, overlap) == len(BYTE_TOK.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["x" * 90_000, "ab cd, " * 20_000, "日本語" * 20_000, " " * 50_000 + "a", "é<|endoftext|> " * 6000])
def test_huge_texts(text):
    assert token_counts.counts_of(pa.array([text]), BYTES)[1].tolist() == [len(BYTE_TOK.encode(text, add_special_tokens=False).ids)]


@pytest.mark.parametrize("text", ["日本語 " * 75_000, "日本語" * 100_000, "ab1-" * 75_000, "x" * 300_000, "word " * 60_000, ("y" * 30_000 + " ") * 10])
def test_huge_texts_are_encoded_a_few_times_at_most(text):
    encode, sizes = token_counts.begins_by(BYTES), []

    def counted(texts):
        sizes.extend(map(len, texts))
        return encode(texts)

    assert token_counts.count_spliced(text, counted) == len(BYTE_TOK.encode(text, add_special_tokens=False).ids)
    assert sum(sizes) <= 4 * len(text)


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_that_a_polynomial_hash_confuses(size):
    one = "".join("ab"[i.bit_count() & 1] for i in range(size))
    texts = [one, one.translate(str.maketrans("ab", "ba"))]
    assert token_counts.counts_of(pa.array(texts), BYTES)[1].tolist() == [len(BYTE_TOK.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_piece_ids(texts):
    known, rests = tokens.table(WORDS), packing.tails()
    for made in packing._pieces(pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), known, rests):
        got = defaultdict(list)
        for d, start, length, crc, total in zip(*[made[f].to_pylist() for f in made], strict=True):
            whole = [*WORD_TOK.encode(texts[d], add_special_tokens=False).ids, packing.END_ID]
            assert total == len(whole) and start == sum(got[d]) and crc == zlib.crc32(struct.pack(f"<{length}I", *whole[start:start + length]))
            got[d].append(length)


def test_tails_lie_near_their_class():
    for r, parts in enumerate(packing.tails()):
        assert sum(parts) == r and all(packing.piece_class(p) * p >= (1 - packing.SLACK) * packing.LENGTH for p in parts)


def check_packed(rows, texts, most):
    cover, bins = Counter(), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        whole = [*WORD_TOK.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert r.start == cover[r.doc_id] and r.doc_tokens == len(whole)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *whole[r.start:r.start + r.length]))
        cover[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(cover[d] == len(WORD_TOK.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in enumerate(texts))
    padding = 0
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
        padding += 0 if at & (at - 1) == 0 else packing.LENGTH - at
    assert padding <= most * sum(cover.values()) + packing.LENGTH


@pytest.mark.parametrize("parts", [1, 13])
def test_packing(spark, parts):
    texts = [None, "", "x"] + [("word " * (i * 37 % 3000)) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    check_packed(packing.packed(docs, WORDS).collect(), texts, 0.02)

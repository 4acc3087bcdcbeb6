"""Token counts of whole texts by overlap resynchronisation.

A huge text is encoded in overlapping chunks with offsets. Two neighbouring chunks are spliced at a place where both
begin a token and that is proven stable: white space after a visible character, where no token spans and what follows
does not depend on what came before. If their overlap holds no such place, it is widened and encoded again.
Other texts are encoded whole, piece by piece (see `tokens`).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm import textops as T
from colonnade.llm import tokens
from colonnade.llm.runtime import beside

CHUNK, OVERLAP, HUGE = 16_384, 512, 32_768  # code points, code points, bytes
LIMIT = 1024
STABLE = re.compile(r"(?<=[!-~À-ÿ])(?=[ \t\n\r\x0b\x0c])")


def count_spliced(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of tokens of the text. encode: texts to arrays of their tokens' first code points.

    Each chunk begins inside the one before it, and the two are spliced at a stable place of their overlap. Without one
    the earlier chunk doubles and the overlap grows to at most half of it, so a text is encoded a few times at most,
    whatever its length; a text without any such place ends as one chunk.
    """
    n = len(text)
    left, left_end, frm, total, wide = 0, min(len(text), chunk), 0, 0, overlap
    [begins] = encode([text[:left_end]])
    while left_end < n:
        start, end = max(left, left_end - wide), min(n, left_end + chunk - overlap)
        right = encode([text[start:end]])[0] + start
        at = _common(text, start, left_end, begins, right, frm)
        if at is None:
            wide = max(overlap, min(4 * wide, left_end - left))
            left_end = min(n, 2 * left_end - left)
            begins = encode([text[left:left_end]])[0] + left
            continue
        total += int(np.searchsorted(begins, at) - np.searchsorted(begins, frm))
        left, left_end, begins, frm, wide = start, end, right, at, overlap
    return total + len(begins) - int(np.searchsorted(begins, frm))


def _common(text: str, start: int, end: int, left: np.ndarray, right: np.ndarray, frm: int) -> int | None:
    """The first stable place after `frm` inside the overlap where both chunks begin a token."""
    for m in STABLE.finditer(text, max(start + 1, frm + 1), end):
        at = m.start()
        i, j = np.searchsorted(left, at), np.searchsorted(right, at)
        if i < len(left) and j < len(right) and left[i] == at and right[j] == at:
            return at
    return None


def begins_by(path: str):
    """Texts to arrays of where their tokens begin, by the tokenizer's own offsets."""
    tok = tokens.tokenizer(path)

    def encode(texts):
        return [np.array([o[0] for o in e.offsets], dtype=np.int64) for e in tok.encode_batch(texts, add_special_tokens=False)]

    return encode


def counts_of(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of each text."""
    known, encode, sizes, out = tokens.table(path), begins_by(path), [], []
    for block in T.blocks(column):
        size = np.diff(block.borders)
        starts, ends, texts = tokens.spaced_words(block)
        huge = size > HUGE
        if huge.any():
            mine = ~huge[texts]
            starts, ends, texts = starts[mine], ends[mine], texts[mine]
        n = T.per_text(texts, block.n, known.length[rows] if len(rows := known.places(block, starts, ends)) else None).astype(np.int64)
        for i in np.flatnonzero(huge):
            n[i] = count_spliced(block.data[block.borders[i]:block.borders[i + 1]].tobytes().decode("utf-8"), encode)
        sizes.append(size)
        out.append(n)
    return np.concatenate([np.zeros(0, np.int64), *sizes]), np.concatenate([np.zeros(0, np.int64), *out])


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens). Null texts are empty: 0 bytes, 0 tokens.

    Rows are neither dropped nor combined and need no shuffle; other columns are not read. Special strings in a text are
    what the tokenizer takes them for by default.
    """
    def start():
        return lambda texts: [pa.array(x, pa.int64()) for x in counts_of(texts, path)]

    counted = beside(docs.select("doc_id", "text"), [("n_bytes", "long"), ("n_tokens", "long")], start)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

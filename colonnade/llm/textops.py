"""Words, word hashes and counts of many texts at once, over their UTF-8 bytes.

A word is a run of bytes other than space and 9 to 13; since those are ASCII, words of bytes are words of code points.
Everything works on blocks of about `BLOCK` bytes, so memory does not grow with the batch. Only a single longer text
makes a longer block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
U = np.uint64
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C55 | 1
LONG = 64  # bytes; a polynomial modulo 2^64 maps some different words of 1,024 letters and more to one value


class Block(NamedTuple):
    """Texts first..first+n of a batch: their bytes and n + 1 borders."""

    first: int
    data: np.ndarray
    borders: np.ndarray

    @property
    def n(self) -> int:
        return len(self.borders) - 1


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        j = min(j, n)
        yield Block(i, raw[at[i]:at[j]], at[i:j + 1] - at[i])
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def spans(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last-plus-one byte of each word, and the text (within the block) that holds it."""
    data, borders = block.data, block.borders
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~IS_SPACE[data]
    inner = borders[(borders > 0) & (borders < len(data))]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(borders, starts, side="right") - 1


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span (spans ascend and do not overlap): equal bytes, equal hash.

    Spans of at most `LONG` bytes by a polynomial, all at once; longer ones, few but for lines, by BLAKE2b.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK // 4, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        forth, back = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + U(1)) * forth[:hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64) * U(0xD6E8FEB86659FD93))
        i = j
    far = np.flatnonzero(ends - starts > LONG)
    if len(far):
        raw = np.ascontiguousarray(data).data
        digests = [hashlib.blake2b(raw[s:e], digest_size=8).digest() for s, e in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
        out[far] = np.frombuffer(b"".join(digests), dtype="<u8")
    return out


def windows(words: np.ndarray, texts: np.ndarray, k: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every run of k words. whole: a text of 1 to k - 1 words has one run, all its words."""
    n = len(words)
    with np.errstate(over="ignore"):
        weights = [U(pow(0xA24BAED4963EE407, i + 1, 1 << 64)) for i in range(k)]
        if n >= k:
            h = words[:n - k + 1] * weights[0]
            for i in range(1, k):
                h = h + words[i:n - k + 1 + i] * weights[i]
            same = texts[:n - k + 1] == texts[k - 1:]
            h, t, at = mix(h[same]), texts[:n - k + 1][same], np.flatnonzero(same)
        else:
            h, t, at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if whole and n:
            ids, first, count = np.unique(texts, return_index=True, return_counts=True)
            few = count < k
            if few.any():
                short = np.zeros(int(few.sum()), np.uint64)
                for i in range(k - 1):
                    there = count[few] > i
                    short[there] += words[first[few][there] + i] * weights[i]
                short = mix(short + count[few].astype(np.uint64) * U(0x8CB92BA72F3D8DD7))
                h, t, at = np.concatenate([h, short]), np.concatenate([t, ids[few]]), np.concatenate([at, first[few]])
                order = np.argsort(at, kind="stable")
                h, t = h[order], t[order]
    return h, t


def repeats(values: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: how often its text holds it, and whether an earlier equal one exists there."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    with np.errstate(over="ignore"):
        key = values + mix(texts.astype(np.uint64) + U(1))
    _, first, back, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(values), dtype=bool)
    later[first] = False
    return count[back], later


def per_text(texts: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(texts, weights=weights, minlength=n)


def byte_sums(block: Block, table: np.ndarray) -> np.ndarray:
    """Per text, how many of its bytes the table of 256 marks."""
    total = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.cumsum(table[block.data], out=total[1:])
    return total[block.borders[1:]] - total[block.borders[:-1]]


def table_of(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(chars.encode("ascii"))] = 1
    return out


LEADS = np.array([0 if 0x80 <= b < 0xC0 else 1 for b in range(256)], dtype=np.int64)  # bytes that begin a code point
SYMBOLS = table_of("#*$%&|<>")
UPPER = table_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = table_of("abcdefghijklmnopqrstuvwxyz")
DIGITS = table_of("0123456789")
MARKS = table_of("!?")
STOPS = table_of(".,;:")


class Counts(NamedTuple):
    """Per text; word_chars in code points, the rest as its name says."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    n_lines: np.ndarray
    n_distinct: np.ndarray
    n_adjacent: np.ndarray


def counts(block: Block, starts: np.ndarray, ends: np.ndarray, texts: np.ndarray, words: np.ndarray) -> Counts:
    n = block.n
    n_words = per_text(texts, n).astype(np.int64)
    leads = byte_sums(block, LEADS)
    word_chars = leads - byte_sums(block, IS_SPACE.astype(np.int64))
    n_symbols = byte_sums(block, SYMBOLS)
    # lines with a word: between borders and line feeds
    breaks = np.flatnonzero(block.data == 10)
    line_start = np.unique(np.concatenate([breaks + 1, block.borders[:-1]]))
    line_start = line_start[line_start < len(block.data)]
    line_text = np.searchsorted(block.borders, line_start, side="right") - 1
    ends_at = np.append(breaks, len(block.data))
    line_end = np.minimum(ends_at[np.searchsorted(breaks, line_start)], block.borders[line_text + 1])
    if len(starts) and len(line_start):
        k = np.searchsorted(starts, line_start, side="left")
        has = (k < len(starts)) & (starts[np.minimum(k, len(starts) - 1)] < line_end)
    else:
        has = np.zeros(len(line_start), dtype=bool)
    ls, le, lt = line_start[has], line_end[has], line_text[has]
    _, again = repeats(hashes(block.data, ls, le), lt)
    n_dup = per_text(lt[again], n).astype(np.int64)
    n_lines = per_text(lt, n).astype(np.int64)
    # words inside windows of three that are found twice or more
    three, where = windows(words, texts, 3)
    often, _ = repeats(three, where)
    covered = np.zeros(len(words) + 3, dtype=bool)
    if len(words) >= 3:
        place = np.flatnonzero(texts[:-2] == texts[2:])[often > 1]
        for i in range(3):
            covered[place + i] = True
    n_repeat = per_text(texts[covered[:len(words)]], n).astype(np.int64)
    _, later = repeats(words, texts)
    n_distinct = n_words - per_text(texts[later], n).astype(np.int64)
    same = (words[1:] == words[:-1]) & (texts[1:] == texts[:-1]) if len(words) else np.zeros(0, bool)
    n_adjacent = per_text(texts[1:][same], n).astype(np.int64) if len(words) else np.zeros(n, np.int64)
    return Counts(n_words, word_chars, n_symbols, n_dup, n_repeat, n_lines, n_distinct, n_adjacent)

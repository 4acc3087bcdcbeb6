"""Token ids of many texts by a tokenizer file, each distinct piece of text encoded once per worker.

A text is cut before white space that follows a visible character. For the tokenizers used here no token spans such a
place and nothing before it changes what follows, so the ids of a text are those of its pieces, one after the other.
"""

from __future__ import annotations

import numpy as np

from colonnade.llm import textops as T

MOST_PIECES, AT_ONCE = 1_000_000, 4096
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True

_TOKENIZERS: dict = {}
_TABLES: dict = {}


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker. Workers share cores, so it uses one thread."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def words(block: T.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces for tokenizers that drop white space: the words themselves."""
    return T.spans(block)


def spaced_words(block: T.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces for tokenizers that keep white space: cut where it follows a visible ASCII or Latin-1 character.

    After other characters (some of them are white space beyond ASCII) the text is not cut.
    """
    data, borders = block.data, block.borders
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    cut = np.zeros(n, dtype=bool)
    solid = _VISIBLE[data].copy()
    solid[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] == 0xC3)
    cut[1:] = T.IS_SPACE[data[1:]] & solid[:-1]
    cut[borders[borders < n]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)
    return starts, ends, np.searchsorted(borders, starts, side="right") - 1


class PieceTable:
    """Ids of the pieces seen so far, by their 64-bit hash."""

    def __init__(self, path: str):
        self.encode = tokenizer(path).encode_batch_fast
        self.clear()

    def clear(self) -> None:
        self.keys, self.first, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def places(self, block: T.Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of each piece in the table, which learns new ones."""
        hashes, where, back = np.unique(T.hashes(block.data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(hashes) > MOST_PIECES:
            self.clear()
        at = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = block.data.tobytes()
            texts = [raw[starts[i]:ends[i]].decode("utf-8") for i in where[new]]
            size, flat = np.zeros(len(new), np.int64), [self.ids]
            for first in range(0, len(new), AT_ONCE):
                found = [e.ids for e in self.encode(texts[first:first + AT_ONCE], add_special_tokens=False)]
                size[first:first + len(found)] = [len(x) for x in found]
                flat.append(np.array([i for x in found for i in x], dtype=np.uint32))
            begin = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate(flat)
            self.first = np.insert(self.first, at[new], begin)
            self.length = np.insert(self.length, at[new], size)
            self.keys = np.insert(self.keys, at[new], hashes[new])
        return np.searchsorted(self.keys, hashes)[back]

    def flat(self, rows: np.ndarray) -> np.ndarray:
        """The ids of the given rows, one after the other."""
        size = self.length[rows]
        total = np.cumsum(size)
        out = np.repeat(self.first[rows] - (total - size), size) + np.arange(total[-1] if len(total) else 0)
        return self.ids[out]


def table(path: str) -> PieceTable:
    """The worker's table of a tokenizer file."""
    if path not in _TABLES:
        _TABLES[path] = PieceTable(path)
    return _TABLES[path]

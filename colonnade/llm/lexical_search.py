"""Ranked lexical search, reversed: the items' inverted index goes to the documents.

The items' terms are indexed (term to items and counts) and broadcast; every document's term counts stream through the
index. A first pass keeps of each document its length and the counts of indexed terms, from which the corpus counts
follow; a second pass weighs them and updates one bounded heap per item in every task. The heaps are merged twice, by
parts of the documents, then by item. Items are taken in blocks whose text has a bounded size, each with its own index.

Terms are runs of ASCII letters and digits and of all other code points from U+0080 on; only A-Z are lower-cased.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colonnade.llm.runtime import ship, stored, text_of

BEST = 10
ITEM_BYTES = 4 << 20  # text of a block of items
PIECE = 1 << 20  # bytes of a text that are split at once
WORK = 1 << 20  # postings that are added at once
PARTS = 64  # parts of the documents in the first merge
#: Bytes outside terms become blanks, A-Z lower case.
FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def term_counts(text: bytes) -> tuple[int, Counter]:
    """The number of terms of a text, and how often each occurs."""
    flat, at, n, counts = text.translate(FOLD), 0, 0, Counter()
    while at < len(flat):
        end = flat.find(b" ", at + PIECE)
        end = len(flat) if end < 0 else end
        terms = flat[at:end].split()
        n += len(terms)
        counts.update(terms)
        at = end
    return n, counts


class Index(NamedTuple):
    """Numbered terms; postings[borders[t]:borders[t + 1]] are the items that hold term t, counts how often they do."""

    terms: dict[bytes, int]
    borders: np.ndarray
    postings: np.ndarray
    counts: np.ndarray
    ids: list


def index_of(items: DataFrame) -> Index:
    """The inverted index of (item_id, text); rows of one id are one item with the terms of its different texts."""
    terms: dict[bytes, int] = {}
    numbers: dict = {}
    found: dict[tuple[int, int], int] = {}
    for row in items.collect():
        item = numbers.setdefault(row.item_id, len(numbers))
        for term, n in term_counts(row.text.encode())[1].items():
            key = (terms.setdefault(term, len(terms)), item)
            found[key] = found.get(key, 0) + n
    pairs = sorted(found)
    borders = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(terms) + 1))
    return Index(terms, borders, np.array([i for _, i in pairs], np.int64), np.array([found[p] for p in pairs], np.int64), list(numbers))


def hits(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, n, terms, tf) of the documents with at least one term: their length and the indexed terms they hold."""
    shared = docs.sparkSession.sparkContext.broadcast(index.terms)

    def run(batches):
        known = shared.value
        for batch in batches:
            lengths, sizes, terms, tf, kept = [], [], [], [], []
            texts = batch.column(1).cast(pa.large_binary())
            for i, text in enumerate(texts):
                n, counts = term_counts(text.as_py())
                if n:
                    held = known.keys() & counts.keys()
                    kept.append(i)
                    lengths.append(n)
                    sizes.append(len(held))
                    terms.extend(map(known.__getitem__, held))
                    tf.extend(map(counts.__getitem__, held))
            cut = pa.array(np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


def corpus_counts(found: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms of all of them, and the documents that hold each indexed term.

    Every task sends one row per term it has seen; their sums, at most one row per indexed term, come to the driver.
    """
    def run(batches):
        docs, length, df = 0, 0, np.zeros(terms, np.int64)
        for batch in batches:
            docs += batch.num_rows
            length += int(np.sum(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64))
            df += np.bincount(batch.column(1).flatten().to_numpy(zero_copy_only=False), minlength=terms)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], seen]), pa.int32()), pa.array(np.concatenate([[docs, length], df[seen]]), pa.int64())], ["term", "n"])

    sums = dict(map(tuple, found.select("n", "terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect()))
    df = np.zeros(terms, np.int64)
    for term, n in sums.items():
        if term >= 0:
            df[term] = n
    return sums.get(-2, 0), sums.get(-1, 0), df


def weights(docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)


class Heaps:
    """Per item the best (score, -doc_id) so far; a null doc_id comes after all others of its score."""

    def __init__(self, items: int, best: int):
        self.best, self.own, self.floor = best, [[] for _ in range(items)], np.ones(items, np.int64)

    def update(self, doc_ids: list, scores: np.ndarray) -> None:
        for d, i in zip(*map(np.ndarray.tolist, np.nonzero(scores >= self.floor)), strict=True):
            doc_id = doc_ids[d]
            entry, heap = (int(scores[d, i]), -math.inf if doc_id is None else -doc_id, doc_id), self.own[i]
            if len(heap) < self.best:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.best:
                self.floor[i] = heap[0][0]


def scored(batch: pa.RecordBatch, index: Index, weight: np.ndarray, docs: int, length: int) -> Iterator[tuple[list, np.ndarray]]:
    """Document ids and their scores for all items, a row per document, some documents at a time."""
    doc_ids, items = batch.column(0).to_pylist(), len(index.ids)
    norm = np.array([100 - 75 + (75 * n * docs) // length for n in batch.column(1).to_pylist()], np.int64)
    lists, owner = batch.column(2), np.repeat(np.arange(batch.num_rows), np.diff(batch.column(2).offsets.to_numpy()))
    term, tf = lists.flatten().to_numpy(zero_copy_only=False), batch.column(3).flatten().to_numpy(zero_copy_only=False)
    impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[owner]))
    size = index.borders[term + 1] - index.borders[term]
    load = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=size, minlength=batch.num_rows) + items)])
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(load, load[first] + WORK, side="right")) - 1)
        lo, hi = np.searchsorted(owner, [first, last])
        n, total = size[lo:hi], int(size[lo:hi].sum())
        posting = np.repeat(index.borders[term[lo:hi]] - np.cumsum(n) + n, n) + np.arange(total)
        out = np.zeros((last - first) * items, np.int64)
        np.add.at(out, np.repeat(owner[lo:hi] - first, n) * items + index.postings[posting], np.repeat(impact[lo:hi], n) * index.counts[posting])
        yield doc_ids[first:last], out.reshape(-1, items)
        first = last


def _ranked(found: DataFrame, *parts: str, best: int) -> DataFrame:
    order = Window.partitionBy(*parts).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """Per item its `best` documents of the highest score above 0: item_id, rank, doc_id, score.

    Equal scores rank by ascending doc_id, null ids last. Every row of docs is a document, whatever its id; null and
    empty texts hold no term. Rows of items that share an id are one item with the terms of its different texts; items
    without terms, and an empty table on either side, give no rows. Extra columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = items.select("item_id", text_of().alias("text")).distinct()
    blocks = math.ceil((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / ITEM_BYTES)
    out = []
    for k in range(blocks):
        index = index_of(texts.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k))
        if not index.terms:
            continue
        found = stored(hits(docs, index), "hits")
        n_docs, length, df = corpus_counts(found, len(index.terms))
        out.append(_best(found, index, weights(n_docs, df), n_docs, length, best, items.schema["item_id"].dataType.simpleString()))
    if not out:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    table = out[0]
    for more in out[1:]:
        table = table.unionByName(more)
    return table


def _best(found: DataFrame, index: Index, weight: np.ndarray, docs: int, length: int, best: int, kind: str) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast(index._replace(terms={}))

    def run(batches):
        own = shared.value
        heaps = Heaps(len(own.ids), best)
        for batch in batches:
            for doc_ids, scores in scored(batch, own, weight, docs, length):
                heaps.update(doc_ids, scores)
        rows = [(own.ids[i], doc_id, score) for i, heap in enumerate(heaps.own) for score, _, doc_id in heap]
        item_ids, doc_ids, scores = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item_ids, arrow), pa.array(doc_ids, pa.int64()), pa.array(scores, pa.int64())], ["item_id", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    arrow = to_arrow_type(StructType.fromDDL(f"x {kind}").fields[0].dataType)
    heaps = found.mapInArrow(run, f"item_id {kind}, doc_id long, score long").withColumn("part", F.pmod(F.hash("doc_id"), F.lit(PARTS)))
    merged = _ranked(heaps, "item_id", "part", best=best).drop("rank", "part")
    return _ranked(merged, "item_id", best=best).select("item_id", "rank", "doc_id", "score")

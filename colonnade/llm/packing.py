"""Harmonic packing of tokenised documents into sequences of a fixed length C.

Class k holds lengths above C/(k+1) and up to C/k, and a bin of class k takes k pieces of it, so bins fill without
looking at what else exists: every worker fills its own. Documents are cut so that each piece lies near the top of its
class: whole sequences first, then powers of two, until the rest wastes at most `SLACK` of a bin. What a worker cannot
make full bins of, less than one bin per class, goes on to a common worker of `FAN_IN` workers, and so on; the last
pieces, less than one bin per class in all, are packed best fit.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm import textops as T
from colonnade.llm import tokens
from colonnade.llm.runtime import ship, stored

LENGTH, END_ID = 4096, 2
SLACK = 1 / 128
FAN_IN = 8
FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
PLACE = [("sequence_id", pa.int64()), ("offset", pa.int64()), ("worker", pa.int64())]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, worker long"


def piece_class(length):
    return LENGTH // length


def tails() -> list[tuple[int, ...]]:
    """For each rest below C, the lengths of its pieces."""
    out: list[tuple[int, ...]] = [()]
    for r in range(1, LENGTH):
        if piece_class(r) * r >= (1 - SLACK) * LENGTH:
            out.append((r,))
        else:
            big = 1 << (r.bit_length() - 1)
            out.append((big, *out[r - big]))
    return out


def fill(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Full bins of the pieces in their order: (bin of each piece or -1, offset in it, number of bins before a class)."""
    kind = piece_class(length)
    order = np.argsort(kind, kind="stable")
    sorted_kind = kind[order]
    first = np.searchsorted(sorted_kind, sorted_kind, side="left")
    count = np.searchsorted(sorted_kind, sorted_kind, side="right") - first
    rank = np.arange(len(kind)) - first
    full = rank < count // sorted_kind * sorted_kind
    opens = full & (rank % sorted_kind == 0)
    number = np.cumsum(opens) - 1
    run = np.cumsum(np.where(full, length[order], 0)) - np.where(full, length[order], 0)
    begin = run[np.flatnonzero(opens)][number[full]] if full.any() else run[full]
    bins, offset = np.full(len(kind), -1), np.zeros(len(kind), np.int64)
    bins[order[full]], offset[order[full]] = number[full], run[full] - begin
    return bins, offset, np.array([int(opens.sum())])


def best_fit(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, longest first, each into the fullest bin that has room."""
    bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    room: list[tuple[int, int]] = []  # (space left, bin), ascending
    opened = 0
    for i in np.argsort(-length, kind="stable"):
        n = int(length[i])
        at = bisect.bisect_left(room, (n, -1))
        space, b = room.pop(at) if at < len(room) else (LENGTH, opened)
        opened += b == opened
        bins[i], offset[i] = b, LENGTH - space
        if space > n:
            bisect.insort(room, (space - n, b))
    return bins, offset


def sequence_id(level: int, worker: int, number: np.ndarray) -> np.ndarray:
    """A number of its own for the bins of each level (below 8) and worker: up to 2^28 workers and 2^32 bins."""
    return (np.int64(level) << np.int64(60)) | (np.int64(worker) << np.int64(32)) | number.astype(np.int64)


def _table(columns: dict[str, np.ndarray], keep: np.ndarray, sequence, offset, worker: int) -> pa.RecordBatch:
    n = int(keep.sum()) if keep.dtype == bool else len(keep)
    arrays = [columns[f].take(np.flatnonzero(keep) if keep.dtype == bool else keep) for f, _ in FIELDS]
    arrays += [sequence, offset, pa.array(np.full(n, worker), pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, [f for f, _ in FIELDS + PLACE])


def _pieces(ids: pa.Array, texts: pa.Array, known: tokens.PieceTable, rests: list[tuple[int, ...]]):
    """Pieces of each block of documents, as arrays of `FIELDS`."""
    for block in T.blocks(texts):
        starts, ends, owner = tokens.words(block)
        rows = known.places(block, starts, ends)
        flat = known.flat(rows)
        n = T.per_text(owner, block.n, known.length[rows] if len(rows) else None).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(n)])
        out = {f: [] for f, _ in FIELDS}
        whole = memoryview(np.ascontiguousarray(flat.astype("<u4")).tobytes())
        end_id = np.array([END_ID], dtype="<u4").tobytes()
        for i in range(block.n):
            at, total = 0, int(n[i]) + 1
            for size in (LENGTH,) * (total // LENGTH) + rests[total % LENGTH]:
                lo, hi = begin[i] + at, min(begin[i] + at + size, begin[i + 1])
                crc = zlib.crc32(whole[4 * lo:4 * hi])
                if at + size == total:
                    crc = zlib.crc32(end_id, crc)
                for f, v in zip(out, (i, at, size, crc, total), strict=True):
                    out[f].append(v)
                at += size
        made = {f: pa.array(v, pa.int64()) for f, v in out.items()}
        made["doc_id"] = ids.slice(block.first, block.n).take(made["doc_id"])
        yield made


def _join(parts: list[dict]) -> dict:
    return {f: pa.concat_arrays([p[f] for p in parts]) for f, _ in FIELDS}


def _own_bins(path: str):
    """Arrow batches (doc_id, text) to pieces: with their sequence where the worker fills one, without it where not."""
    def run(batches):
        from pyspark import TaskContext

        worker = TaskContext.get().partitionId()
        known, rests, number, waiting = tokens.table(path), tails(), 0, None
        for batch in batches:
            for made in _pieces(batch.column(0), batch.column(1), known, rests):
                made = _join([waiting, made]) if waiting else made
                bins, offset, count = fill(made["length"].to_numpy())
                full = bins >= 0
                if full.any():
                    yield _table(made, full, pa.array(sequence_id(0, worker, bins[full] + number)), pa.array(offset[full]), worker)
                number += int(count[0])
                waiting = {f: made[f].take(np.flatnonzero(~full)) for f, _ in FIELDS}
        if waiting and len(waiting["length"]):
            n = len(waiting["length"])
            yield _table(waiting, np.ones(n, bool), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), worker)

    return run


def _common_bins(level: int, last: bool):
    """The pieces that workers left over, one group a common worker."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]).combine_chunks()
        made = {f: table[f].combine_chunks() if isinstance(table[f], pa.ChunkedArray) else table[f] for f, _ in FIELDS}
        worker = int(table["worker"][0].as_py())
        bins, offset, count = fill(made["length"].to_numpy())
        if last and (bins < 0).any():
            rest = np.flatnonzero(bins < 0)
            b, o = best_fit(made["length"].to_numpy()[rest])
            bins[rest], offset[rest] = b + int(count[0]), o
        open_ = pa.array(bins < 0)
        sequence = pc.if_else(open_, pa.scalar(None, pa.int64()), pa.array(sequence_id(level, worker, np.maximum(bins, 0))))
        return pa.Table.from_batches([_table(made, np.ones(len(bins), bool), sequence, pc.if_else(open_, pa.scalar(None, pa.int64()), pa.array(offset)), worker)])

    return run


def packed(docs: DataFrame, path: str) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts are empty, so only their end id is packed. Rows that repeat a doc_id are packed each for itself. Other
    columns are not read. Every level's pieces are written to the shared folder, so a sequence keeps its pieces if an
    executor is lost. A group of leftovers has at most FAN_IN times C * (1 + 1/2 + ... + 1/C) pieces.
    """
    spark = docs.sparkSession
    ship(spark)
    pieces = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_own_bins(path), SCHEMA), "pieces")
    done, level = pieces.filter("sequence_id IS NOT NULL"), 0
    rest = pieces.filter("sequence_id IS NULL")
    most = rest.agg(F.max("worker")).first()[0]
    while most is not None:
        level, most = level + 1, most // FAN_IN
        grouped = rest.withColumn("worker", F.floor(F.col("worker") / FAN_IN)).groupBy("worker").applyInArrow(_common_bins(level, most == 0), SCHEMA)
        pieces = stored(grouped, "pieces")
        done = done.unionByName(pieces.filter("sequence_id IS NOT NULL"))
        if most == 0:
            break
        rest = pieces.filter("sequence_id IS NULL")
        most = rest.agg(F.max("worker")).first()[0]
    return done.drop("worker")

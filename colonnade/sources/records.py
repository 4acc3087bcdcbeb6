"""CSV records that hold line breaks, cut in parallel.

A file is read as lines, range by range. Within a range lines become records at once, but a range may begin inside a
quoted field of the range before. So a first pass summarises every range under both assumptions: how a field open at its
start would close, and which record is open at its end. The summaries, one small row per range, are combined in file
order, which decides for every border whether a record crosses it. A second pass cuts the records; the parts of the few
that cross a border are joined by the record's first range. No file is read by one task.

A quote opens a field only at the field's start and closes it only before a delimiter or the record's end. A line that
leaves a field open is a torn record if the record that it begins has as many fields as the header and at most
`LONGEST` bytes; otherwise the quote is stray, and the line is a record of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.functions.storage import stored

LONGEST = 1 << 24
SLICE = 4096  # lines handled at once
_REST = re.compile(rb'[^"]*(?:""[^"]*)*"(?!")')  # a quoted field's rest, its closing quote included


def advance(line: bytes, delimiter: bytes, inside: bool) -> tuple[int, bool, bool]:
    """Delimiters between fields of a line, whether it ends inside a quoted field, whether all quotes close well."""
    line = line[:-1] if line.endswith(b"\r") else line
    at, found, n = 0, 0, len(line)
    while True:
        if inside or line[at:at + 1] == b'"':
            rest = _REST.match(line, at + (not inside))
            if rest is None:
                return found, True, True
            at, inside = rest.end(), False
            if at < n and not line.startswith(delimiter, at):
                return found, False, False
        else:
            at = line.find(delimiter, at)
            at = n if at < 0 else at
        if at >= n:
            return found, False, True
        at, found = at + len(delimiter), found + 1


def escaped(delimiter: str) -> str:
    """The delimiter in a pattern, inside brackets or out."""
    return delimiter if delimiter.isspace() or delimiter.isalnum() else "\\" + delimiter


def plain_pattern(delimiter: str) -> str:
    """Lines whose quoted fields all close in them."""
    d = escaped(delimiter)
    one = f'(?:"(?:[^"]|"")*"|[^"{d}][^{d}]*|)'
    return f"^{one}(?:{d}{one})*\r?$"


@dataclass
class Cutter:
    """Cuts lines into records, beginning at a record's start.

    `open` holds the lines of a record whose end has not come yet, with `fields` delimiters so far.
    """

    delimiter: bytes
    width: int
    torn: int = 0
    stray: int = 0
    open: list[bytes] = field(default_factory=list)
    fields: int = 0
    size: int = 0

    def feed(self, lines: list[bytes], plain: np.ndarray) -> Iterator[bytes]:
        """The records that end in these lines; plain: lines that cannot leave a field open."""
        at, again = 0, []  # again: lines behind a stray quote, the next one last
        odd = np.flatnonzero(~plain).tolist() + [len(lines)]
        k = 0
        while at < len(lines) or again:
            if not again and not self.open:
                while odd[k] < at:
                    k += 1
                yield from lines[at:odd[k]]
                at = odd[k]
                if at == len(lines):
                    return
            if again:
                line = again.pop()
            else:
                line, at = lines[at], at + 1
            done = self._take(line)
            if done is None:
                continue
            if done:
                yield b"\n".join(self.open)
                self.torn += len(self.open) > 1
            else:
                self.stray += 1
                yield self.open[0]
                again.extend(reversed(self.open[1:]))
            self._clear()

    def _take(self, line: bytes) -> bool | None:
        """Adds a line to the open record: whether that ends it well (True) or ill (False), or it goes on (None)."""
        found, inside, well = advance(line, self.delimiter, bool(self.open))
        self.open.append(line)
        self.fields += found
        self.size += len(line) + 1
        if well and inside and self.size <= LONGEST:
            return None
        if len(self.open) == 1 and not inside:
            return True  # a line by itself is a record, however its quotes stand
        return well and not inside and self.fields + 1 == self.width

    def _clear(self) -> None:
        self.open, self.fields, self.size = [], 0, 0

    def close(self) -> Iterator[bytes]:
        """The lines of the open record, whose quote is stray."""
        while self.open:
            lines = self.open
            self._clear()
            self.stray += 1
            yield lines[0]
            yield from self.feed(lines[1:], np.zeros(len(lines) - 1, bool))


@dataclass
class Head:
    """The lines of a range up to the end of a record that began in an earlier range."""

    delimiter: bytes
    fields: int = 0
    size: int = 0
    state: str = "open"  # or closed, ill

    def feed(self, lines: list[bytes]) -> int:
        """How many of the lines belong to that record."""
        for i, line in enumerate(lines):
            found, inside, well = advance(line, self.delimiter, True)
            self.fields += found
            self.size += len(line) + 1
            if self.size > LONGEST or not well:
                self.state = "ill"
            elif not inside:
                self.state = "closed"
            if self.state != "open":
                return i + 1
        return len(lines)


def _ranges(batches) -> Iterator[tuple[str, int, Iterator[tuple[list[bytes], pa.Array]]]]:
    """Per range its file, its offset and its lines in slices."""
    def slices():
        for batch in batches:
            ends = np.flatnonzero(np.diff(batch.column("block").to_numpy()) != 0) + 1 if batch.num_rows else []
            same = batch.column("file").dictionary_encode().indices.to_numpy() if batch.num_rows else np.zeros(0, int)
            cuts = sorted({0, *map(int, ends), *map(int, np.flatnonzero(np.diff(same) != 0) + 1), batch.num_rows})
            for lo, hi in zip(cuts, cuts[1:]):
                for i in range(lo, hi, SLICE):
                    part = batch.slice(i, min(SLICE, hi - i))
                    yield part["file"][0].as_py(), part["block"][0].as_py(), part["line"]

    for (file, block), own in groupby(slices(), key=lambda s: s[:2]):
        yield file, block, ((lines.to_pylist(), lines) for _, _, lines in own)


def lines_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, block, line): the lines as bytes; a range's lines are in order."""
    read = spark.read.option("lineSep", "\n").text(paths)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


SUMMARY = "file string, block long, torn long, stray long, tail int, size long, head string, head_fields int, head_size long, torn_in long, stray_in long, tail_in int, size_in long"


def summaries(lines: DataFrame, delimiter: str, width: int) -> DataFrame:
    """One row per range: counts of torn records and stray quotes and the delimiters of the record left open (null: none),
    for a range that begins at a record's start and, ending in `_in`, for one that begins inside a quoted field."""
    pattern, mark = plain_pattern(delimiter), delimiter.encode()

    def run(batches):
        for file, block, slices in _ranges(batches):
            out, into, head = Cutter(mark, width), Cutter(mark, width), Head(mark)
            synced, base = False, (0, 0)
            for lines, column in slices:
                plain = pc.match_substring_regex(column, pattern).to_numpy(zero_copy_only=False)
                for _ in out.feed(lines, plain):
                    pass
                if synced:
                    continue
                first = 0
                if head.state == "open":
                    first = head.feed(lines)
                for _ in into.feed(lines[first:], plain[first:]):
                    pass
                if head.state == "closed" and not into.open and not out.open:  # from here on both cut alike
                    synced, base = True, (into.torn - out.torn, into.stray - out.stray)
            if synced:
                counts, tail = (out.torn + base[0], out.stray + base[1]), out
            else:
                counts, tail = (into.torn, into.stray), into
            ends = lambda c: (c.fields if c.open else None, c.size)
            yield pa.RecordBatch.from_pylist([dict(zip(names, (file, block, out.torn, out.stray, *ends(out), head.state, head.fields, head.size, *counts, *ends(tail)), strict=True))], schema)

    names = [part.split()[0] for part in SUMMARY.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in SUMMARY.split(", ")])
    return lines.mapInArrow(run, SUMMARY)


def resolve(ranges: list, width: int) -> tuple[dict[int, tuple[int | None, bool]], int, int]:
    """For the summaries of one file in order: what crosses borders, and the counts of torn records and stray quotes.

    A range maps to the range that holds the first line of the record it begins in (None: it begins at a record's start)
    and whether the record open at its end goes on in the next. Ranges without either are left out.
    """
    crossing: dict[int, tuple[int | None, bool]] = {}
    torn = stray = i = 0
    entered = None  # the range in which the record that range i begins in has its first line
    while i < len(ranges):
        r = ranges[i]
        inside = entered is not None
        torn, stray = torn + (r.torn_in if inside else r.torn), stray + (r.stray_in if inside else r.stray)
        tail, size = (r.tail_in, r.size_in) if inside else (r.tail, r.size)
        accepted = None
        if tail is not None:
            fields, k = tail, i + 1
            while k < len(ranges):
                fields, size = fields + ranges[k].head_fields, size + ranges[k].head_size
                if size > LONGEST or ranges[k].head == "ill":
                    break
                if ranges[k].head == "closed":
                    accepted = k if fields + 1 == width else None
                    break
                k += 1
            stray += accepted is None
            torn += accepted is not None
        if inside or accepted is not None:
            crossing[r.block] = (entered, accepted is not None)
        if accepted is None:
            entered, i = None, i + 1
        else:
            crossing.update({ranges[k].block: (r.block, True) for k in range(i + 1, accepted)})
            entered, i = r.block, accepted
    return crossing, torn, stray


def borders(summary: DataFrame, width: int) -> tuple[dict[tuple[str, int], tuple[int | None, bool]], int, int]:
    """All files' ranges at whose borders a record goes on, and the counts of torn records and stray quotes.

    Summaries come to the driver: one row of a few numbers per range of `spark.sql.files.maxPartitionBytes`.
    """
    rows = sorted(summary.collect(), key=lambda r: (r.file, r.block))
    out, torn, stray = {}, 0, 0
    for file, own in groupby(rows, key=lambda r: r.file):
        crossing, t, s = resolve(list(own), width)
        out.update({(file, block): where for block, where in crossing.items()})
        torn, stray = torn + t, stray + s
    return out, torn, stray


def records(lines: DataFrame, delimiter: str, width: int, crossing: dict, encoding: str = "utf-8") -> DataFrame:
    """(record, header): every record of every file; header: it is a file's first that is not blank.

    Written once to the shared folder, so that later passes read records and not lines.
    """
    pattern, mark = plain_pattern(delimiter), delimiter.encode()
    shared = lines.sparkSession.sparkContext.broadcast(crossing)
    ddl = "file string, block long, start long, record string, header boolean"
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("start", pa.int64()), ("record", pa.string()), ("header", pa.bool_())])

    def run(batches):
        for file, block, slices in _ranges(batches):
            entered, goes_on = shared.value.get((file, block), (None, False))
            cutter, head, first, begun = Cutter(mark, width), Head(mark), [], block > 0

            def rows(texts, start=None):
                nonlocal begun
                marks = [False] * len(texts)
                for i, text in enumerate(texts):
                    if begun:
                        break
                    marks[i] = begun = bool(text.strip())  # noqa: B023
                return pa.RecordBatch.from_arrays([pa.array([file] * len(texts)), pa.array([block] * len(texts), pa.int64()), pa.array([start] * len(texts), pa.int64()),  # noqa: B023
                                                   pa.array([t.decode(encoding, "replace") for t in texts], pa.string()), pa.array(marks, pa.bool_())], schema=schema)

            inside = entered is not None
            for lines_, column in slices:
                taken = 0
                if inside:
                    taken = head.feed(lines_)
                    first += lines_[:taken]
                    inside = head.state == "open"
                plain = pc.match_substring_regex(column, pattern).to_numpy(zero_copy_only=False)
                found = list(cutter.feed(lines_[taken:], plain[taken:]))
                if found:
                    yield rows(found)
            if first:
                yield rows([b"\n".join(first)], entered)
            if goes_on and cutter.open:
                yield rows([b"\n".join(cutter.open)], block)
            elif cutter.open:
                yield rows(list(cutter.close()))

    cut = stored(lines.mapInArrow(run, ddl), "records")
    whole = cut.filter("start IS NULL").select("record", "header")
    parts = cut.filter("start IS NOT NULL").groupBy("file", "start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "record"))), lambda p: p["record"]), "\n").alias("record"), F.bool_or("header").alias("header"))
    return whole.unionByName(parts.select("record", "header"))


def first_record(lines: list[bytes], delimiter: str) -> bytes:
    """The first record that is not blank, as far as the given lines hold it; its first line if it never ends well."""
    mark = delimiter.encode()
    filled = next((i for i, line in enumerate(lines) if line.strip()), None)
    if filled is None:
        return b""
    inside = False
    for k in range(filled, len(lines)):
        _, inside, well = advance(lines[k], mark, inside)
        if not well:
            break
        if not inside:
            return b"\n".join(lines[filled:k + 1])
    return lines[filled]

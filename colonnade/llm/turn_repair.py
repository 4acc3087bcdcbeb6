"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

Valid conversations have the role initials `(s?(ua)+)?`. A turn is kept (0), given another role (2) or deleted (3, the
only choice for blank and repeated turns); an empty turn may be inserted anywhere (2); a truncated turn that stays costs
1 more. A turn is one symbol: its role's initial and its fault. Consecutive equal symbols are one run. A symbol's
min-plus transition takes the costs-to-go of the four states (nothing yet, after s, after u, after a) over one turn; its
binary powers are cached, so a run of n turns costs log n steps. The choices are unrolled from the front by halves of
runs, least letter first, which gives the least audit among the cheapest, because none of them is a prefix of another.

Order of a conversation's turns: turn (nulls first), role, text; of turns equal in turn and role, blank ones come first,
then the first occurrences by text, then repeats. A null role or text counts as one space. Turns equal in all columns
are first counted, and a repeated text is kept once, so neither crosses the network more than once. The rows are then
cut by ranges of their order, so a conversation that holds most rows is read by many tasks; each sends its runs and its
bodies, in pieces of bounded size. One task per conversation reads first the runs, then streams the bodies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from colonnade.llm.runtime import ship

#: States: nothing yet, after s, after u, after a.
START = 0
INSERTED = (2, 2, 3, 2)  # the state after an inserted or re-roled turn
ROLES = ("user", "user", "assistant", "user")  # and that turn's role
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})  # the state after a kept turn, by its initial
LAST = (0, 4, 2, 0)  # cost of the turns to insert at the end
KEEP, CHANGE, DELETE, INSERT = 0, 2, 3, 2
BAD = "x"  # the symbol of turns that must go; other symbols are the initial, in upper case if truncated
NEVER = 1 << 60
PIECE_BYTES, PIECE_RUNS = 32_768, 4096

Runs = tuple[tuple[str, int], ...]


def _edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """What may be done with a turn: letter, cost, next state, in the order of the letters."""
    out = [("D", DELETE, state)]
    if symbol != BAD:
        extra = int(symbol.isupper())
        if symbol.lower() in KEPT[state]:
            out.append(("K", KEEP + extra, KEPT[state][symbol.lower()]))
        out.append(("R", CHANGE + extra, INSERTED[state]))
    return out


@lru_cache(maxsize=None)
def power(symbol: str, k: int) -> tuple[tuple[int, ...], ...]:
    """Least costs from state to state over 2^k turns of one symbol, insertions before each turn included."""
    if k:
        half = power(symbol, k - 1)
        return tuple(tuple(min(half[i][m] + half[m][j] for m in range(4)) for j in range(4)) for i in range(4))
    out = []
    for i in range(4):
        row, state = [NEVER] * 4, i
        for inserted in range(4):  # the fourth insertion leads to no new state
            for _, cost, j in _edits(symbol, state):
                row[j] = min(row[j], inserted * INSERT + cost)
            state = INSERTED[state]
        out.append(tuple(row))
    return tuple(out)


def before(symbol: str, n: int, values: tuple[int, ...]) -> tuple[int, ...]:
    """Costs-to-go in front of n turns of a symbol, from those behind them."""
    k = 0
    while n:
        if n & 1:
            step = power(symbol, k)
            values = tuple(min(step[i][j] + values[j] for j in range(4)) for i in range(4))
        n, k = n >> 1, k + 1
    return values


@lru_cache(maxsize=4096)
def _short(symbol: str, n: int, state: int, values: tuple[int, ...]) -> tuple[str, int]:
    if n > 1:
        half = 1 << ((n - 1).bit_length() - 1)
        one, state = _short(symbol, n - half, state, _level(before(symbol, half, values)))
        two, state = _short(symbol, half, state, values)
        return one + two, state
    letters, front = "", before(symbol, 1, values)
    while True:
        deleted, *rest = _edits(symbol, state)
        inserted = ("I", INSERT, INSERTED[state])
        for letter, cost, to in (deleted, inserted, *rest):
            if cost + (front if letter == "I" else values)[to] == front[state]:
                letters, state = letters + letter, to
                break
        if letter != "I":
            return letters, state


def _level(values: tuple[int, ...]) -> tuple[int, ...]:
    least = min(values)
    return tuple(v - least for v in values)


def unrolled(symbol: str, n: int, state: int, values: tuple[int, ...], size: int = 1024) -> tuple[str, int]:
    """The letters of a run's edits from a state, given the costs-to-go behind it, and the state reached."""
    if n <= size:
        return _short(symbol, n, state, _level(values))
    half = 1 << ((n - 1).bit_length() - 1)
    one, state = unrolled(symbol, n - half, state, before(symbol, half, values))
    two, state = unrolled(symbol, half, state, values)
    return one + two, state


def repair(runs: Runs) -> tuple[int, list[str], str]:
    """The least cost, the letters of each run, and the letters behind the last."""
    return _repair(runs) if sum(n for _, n in runs) <= 64 else _solve(runs)


def _solve(runs: Runs) -> tuple[int, list[str], str]:
    values = [LAST]
    for symbol, n in reversed(runs):
        values.append(before(symbol, n, values[-1]))
    letters, state = [], START
    for (symbol, n), behind in zip(runs, values[-2::-1], strict=True):
        own, state = unrolled(symbol, n, state, behind)
        letters.append(own)
    return values[-1][START], letters, "I" * (LAST[state] // INSERT)


_repair = lru_cache(maxsize=8192)(_solve)


def turns_of(runs: Runs, letters: list[str], tail: str, bodies: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str | None, str | None]]:
    """(letter, role, text) of each edit; deleted turns have neither. `bodies`: role and text of turns that may stay."""
    state = START
    for (symbol, _), own in chain(zip(runs, letters, strict=True), [((BAD, 0), tail)]):
        for letter in own:
            if letter == "I":
                yield letter, ROLES[state], ""
                state = INSERTED[state]
                continue
            role, text = (None, None) if symbol == BAD else next(bodies)
            if letter == "D":
                yield letter, None, None
            elif letter == "K":
                yield letter, role, text
                state = KEPT[state][symbol.lower()]
            else:
                yield letter, ROLES[state], text
                state = INSERTED[state]


# ---- the table of turns ----

def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by crc32(`conv_id:turn`) modulo 20, nulls as one space.

    0 drops the row, 1 empties its text, 2 takes its `.`, `!` and `?`, 3 repeats it, 4 makes its role user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("_fate") == 1, F.lit("")).when(F.col("_fate") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(F.col("_fate") == 4, F.lit("user")).otherwise(space("role"))
    times = F.when(F.col("_fate") == 0, 0).when(F.col("_fate") == 3, 2).otherwise(1)
    rows = turns.select("conv_id", "turn", "role", "text", fate.alias("_fate"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def _symbol(role: Column, truncated: Column) -> Column:
    initial = F.when(F.substring(role, 1, 1).isin("s", "u", "a"), F.substring(role, 1, 1)).otherwise("o")
    return F.when(truncated, F.upper(initial)).otherwise(initial)


def ordered(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The runs of all conversations, sorted by ranges: conv_id, has, turn, role, part, symbol, n, fault, text.

    Part 0 are a turn's blank rows, 1 the first occurrences, 2 the repeats; -1 names a conversation and has no rows.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    full = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    firsts = (rows.filter(full).groupBy("conv_id", "role", "text").agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("none"))
              .select("conv_id", F.when(~F.col("none"), F.col("least")).alias("turn"), "role", "text"))
    counted = rows.select("conv_id", "turn", "role", (~full).cast("long").alias("blank"), full.cast("long").alias("other"))
    counted = counted.unionByName(firsts.select("conv_id", "turn", "role", F.lit(0).alias("blank"), F.lit(-1).alias("other")))
    cells = counted.groupBy("conv_id", "turn", "role").agg(F.sum("blank").alias("blank"), F.sum("other").alias("again"))

    def bad(part, fault):
        return cells.select("conv_id", "turn", "role", F.lit(part).alias("part"), F.lit(BAD).alias("symbol"), F.col(fault).alias("n"), F.lit(fault).alias("fault"), F.lit(None).cast("string").alias("text")).filter("n > 0")

    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    own = firsts.select("conv_id", "turn", "role", F.lit(1).alias("part"), _symbol(F.col("role"), cut).alias("symbol"), F.lit(1).cast("long").alias("n"), F.when(cut, F.lit("truncated")).alias("fault"), "text")
    table = bad(0, "blank").unionByName(own).unionByName(bad(2, "again"))
    if conversations is not None:
        names = conversations.select("conv_id").distinct()
        table = table.unionByName(names.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(-1).alias("part"), F.lit("").alias("symbol"),
                                               F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("fault"), F.lit(None).cast("string").alias("text")))
    table = table.withColumn("has", F.when(F.col("part") < 0, -1).otherwise(F.col("turn").isNotNull().cast("int")))
    # ranges need no more of a text than tells turns of one place apart; the sort within them takes all
    ranged = table.repartitionByRange("conv_id", "has", "turn", "role", "part", F.substring("text", 1, 64))
    return ranged.sortWithinPartitions("conv_id", "has", "turn", "role", "part", "text")


PIECE = ("kind int, part int, place long, symbols string, counts array<long>, blank long, again long, truncated long, illegal long, first string, last string, "
         "least long, most long, turns long, roles array<string>, texts array<string>")


class _Piece:
    """Consecutive runs of one conversation: its summary, and the bodies of the turns that may stay."""

    def __init__(self):
        self.symbols, self.counts, self.roles, self.texts, self.bytes = [], [], [], [], 0
        self.stats = dict.fromkeys(("blank", "again", "truncated", "illegal", "turns"), 0)
        self.first = self.last = self.least = self.most = None

    def add(self, row: dict) -> None:
        n = row["n"]
        if not n:
            return
        if self.symbols and self.symbols[-1] == row["symbol"]:
            self.counts[-1] += n
        else:
            self.symbols.append(row["symbol"])
            self.counts.append(n)
        if row["fault"]:
            self.stats[row["fault"]] += n
        # an initial is a code point; the empty role has none
        initial = row["role"][:1]
        self.stats["illegal"] += n - 1 + (self.last is not None and not legal(self.last, initial))
        self.first = initial if self.first is None else self.first
        self.last = initial
        if row["turn"] is not None:
            self.stats["turns"] += row["turn"] != self.most
            self.least = row["turn"] if self.least is None else self.least
            self.most = row["turn"]
        if row["symbol"] != BAD:
            self.roles.append(row["role"])
            self.texts.append(row["text"])
            self.bytes += len(row["text"]) + len(row["role"])

    def rows(self, conv_id, part: int, place: int) -> Iterator[dict]:
        yield {"conv_id": conv_id, "kind": 0, "part": part, "place": place, "symbols": "".join(self.symbols), "counts": self.counts, **self.stats,
               "first": self.first, "last": self.last, "least": self.least, "most": self.most, "roles": None, "texts": None}
        if self.roles:
            yield {"conv_id": conv_id, "kind": 1, "part": part, "place": place, "roles": self.roles, "texts": self.texts}


def legal(one: str, two: str) -> bool:
    return one + two in ("su", "ua", "au")


def _rows(batches: Iterable[pa.RecordBatch], size: int = 512) -> Iterator[dict]:
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            yield from batch.slice(i, size).to_pylist()


def _batches(rows: Iterable[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _cut(batches):
    """Sorted runs of a range to pieces; `part` is the range's number, `place` the piece's in it."""
    part, place = TaskContext.get().partitionId(), 0
    for conv_id, own in groupby(_rows(batches), key=lambda r: r["conv_id"]):
        piece = _Piece()
        for row in own:
            if piece.bytes >= PIECE_BYTES or len(piece.counts) >= PIECE_RUNS:
                yield from piece.rows(conv_id, part, place)
                piece, place = _Piece(), place + 1
            piece.add(row)
        yield from piece.rows(conv_id, part, place)
        place += 1


def pieces(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The conversations in pieces of bounded size: summaries (kind 0) and bodies (kind 1)."""
    ship(turns.sparkSession)
    source = ordered(turns, conversations)
    fields = [StructField("conv_id", source.schema["conv_id"].dataType), *StructType.fromDDL(PIECE).fields]
    schema = _arrow(fields)
    return source.mapInArrow(lambda batches: _batches(_cut(batches), schema), StructType(fields))


def _arrow(fields) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType(list(fields)))


def _solved(batches) -> Iterator[tuple]:
    """Per conversation: id, summary, runs, letters of runs, tail, an iterator over its bodies (to be used at once)."""
    for conv_id, own in groupby(_rows(batches, 64), key=lambda r: r["conv_id"]):
        sums = dict.fromkeys(("blank", "again", "truncated", "illegal", "turns"), 0)
        runs, last, least, most, body = [], None, None, None, None
        for row in own:
            if row["kind"]:
                body = row
                break
            for symbol, n in zip(row["symbols"], row["counts"], strict=True):
                if runs and runs[-1][0] == symbol:
                    runs[-1] = (symbol, runs[-1][1] + n)
                else:
                    runs.append((symbol, n))
            for name in sums:
                sums[name] += row[name]
            if row["first"] is not None:
                sums["illegal"] += last is not None and not legal(last, row["first"])
                last = row["last"]
            if row["least"] is not None:
                sums["turns"] -= row["least"] == most
                least, most = row["least"] if least is None else least, row["most"]
        sums["gaps"] = 0 if most is None else most - least + 1 - sums["turns"]
        cost, letters, tail = repair(tuple(runs))
        bodies = (pair for r in chain([] if body is None else [body], own) for pair in zip(r["roles"], r["texts"], strict=True))
        yield conv_id, sums | {"cost": cost}, tuple(runs), letters, tail, bodies


def _gathered(turns: DataFrame, conversations: DataFrame | None, work, ddl: str) -> DataFrame:
    cut = pieces(turns, conversations)
    fields = [cut.schema["conv_id"], *StructType.fromDDL(ddl).fields]
    schema = _arrow(fields)
    dealt = cut.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "place")
    return dealt.mapInArrow(lambda batches: _batches(work(batches), schema), StructType(fields))


def _edit_rows(batches):
    for conv_id, _, runs, letters, tail, bodies in _solved(batches):
        for place, (letter, role, text) in enumerate(turns_of(runs, letters, tail, bodies)):
            yield {"conv_id": conv_id, "place": place, "edit": letter, "role": role, "text": text}


def edits(turns: DataFrame) -> DataFrame:
    """Every edit of every conversation in order: conv_id, place (from 0), edit (K, R, D or I), role, text.

    Role and text are those of the repaired turn; deleted turns (D) have none. Extra columns are not read, an empty
    table gives no rows. Rows with a null conv_id are one conversation.
    """
    return _gathered(turns, None, _edit_rows, "place long, edit string, role string, text string")


def _summaries(batches):
    for conv_id, sums, runs, letters, tail, bodies in _solved(batches):
        seen, first = hashlib.sha256(), True
        for letter, role, text in turns_of(runs, letters, tail, bodies):
            if letter != "D":
                seen.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        yield {"conv_id": conv_id, "gaps": sums["gaps"], "blank": sums["blank"], "duplicate": sums["again"], "truncated": sums["truncated"], "illegal": sums["illegal"],
               "cost": sums["cost"], "audit": "".join(letters) + tail, "repaired_sha256": seen.hexdigest()}


def summary(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps are the turn numbers missing between the least and the greatest; blank, duplicate and truncated count turns by
    their first fault; illegal counts neighbours whose initials are not su, ua or au. audit has one letter per edit. The
    digest is that of the repaired conversation's `role:text` lines. Conversations named in `conversations` that have no
    turns get zeros, an empty audit and the digest of the empty text. Null ids are one conversation, null turns come
    first, null roles and texts are one space. Extra columns are not read; an empty table gives no rows.
    """
    return _gathered(turns, conversations, _summaries, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")

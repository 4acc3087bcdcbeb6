"""Conversation repair against a brute-force search over edit scripts."""

import hashlib
import re
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colonnade.llm import turn_repair as R

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def brute(turns):
    """(cost, audit, repaired lines) of [(initial, role, text, must go, truncated)]: every script with at most two insertions in a row."""
    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        found = []
        if i == len(turns) and state in ("", "a"):
            found.append((0, "", ()))
        if inserted < 2:
            cost, audit, lines = best(i, NEXT[state], inserted + 1)
            found.append((cost + 2, "I" + audit, (FULL[NEXT[state]] + ":", *lines)))
        if i < len(turns):
            initial, role, text, bad, cut = turns[i]
            cost, audit, lines = best(i + 1, state, 0)
            found.append((cost + 3, "D" + audit, lines))
            if not bad:
                if initial == NEXT[state] or (state == "" and initial == "s"):
                    cost, audit, lines = best(i + 1, initial, 0)
                    found.append((cost + cut, "K" + audit, (f"{role}:{text}", *lines)))
                cost, audit, lines = best(i + 1, NEXT[state], 0)
                found.append((cost + 2 + cut, "R" + audit, (f"{FULL[NEXT[state]]}:{text}", *lines)))
        return min(found, default=(10 ** 9, "", ()))

    return best(0, "", 0)


def expected(rows):
    """The summary of one conversation's (turn, role, text), by the definition."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    place = lambda t: (t is not None, t or 0)
    blank = lambda x: not re.search(r"[^\x20\x09-\x0D]", x)
    seen, marked = set(), []
    for t, r, x in sorted(rows, key=lambda y: (place(y[0]), y[1], y[2])):
        marked.append((t, r, x, "blank" if blank(x) else "duplicate" if (r, x) in seen else "truncated" if not re.search(r"[.!?][\x20\x09-\x0D]*\Z", x) else ""))
        seen.add((r, x))
    kind = {"blank": 0, "truncated": 1, "": 1, "duplicate": 2}
    marked.sort(key=lambda y: (place(y[0]), y[1], kind[y[3]], y[2]))
    count = lambda k: sum(f == k for *_, f in marked)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(marked, marked[1:])]
    known = [t for t, *_ in marked if t is not None]
    cost, audit, lines = brute(tuple((r[:1], r, x, f in ("blank", "duplicate"), f == "truncated") for _, r, x, f in marked))
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, count("blank"), count("duplicate"), count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def by_id(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


symbols = st.lists(st.tuples(st.sampled_from(["s", "u", "a", "o", "S", "U", "A", "O", R.BAD]), st.integers(1, 3)), max_size=5)


@settings(max_examples=150, deadline=None)
@given(symbols)
def test_least_audit_of_runs(runs):
    cost, letters, tail = R.repair(tuple(runs))
    turns = tuple((s.lower(), s, "", s == R.BAD, s.isupper()) for s, n in runs for _ in range(n))
    assert (cost, "".join(letters) + tail) == brute(turns)[:2]


@pytest.mark.parametrize("symbol", ["s", "u", "A", "O", R.BAD])
def test_long_runs_equal_single_steps(symbol):
    n = 2500
    cost, letters, tail = R.repair(((symbol, n),))
    values = [R.LAST]
    for _ in range(n):
        values.append(R.before(symbol, 1, values[-1]))
    audit, state = "", R.START
    for behind in values[-2::-1]:
        own, state = R._short.__wrapped__(symbol, 1, state, behind)
        audit += own
    assert (cost, "".join(letters) + tail) == (values[-1][0], audit + "I" * (R.LAST[state] // 2))


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Hi."), (1, 4, "assistant", "Hi."), (1, 5, "user", "cut off"),
    (2, None, "assistant", "x."), (2, None, None, None), (2, 3, "user", "  "), (2, 3, "user", "x"), (2, 3, "user", "x"), (2, 9, "user", "x"),
    (3, 1, "tool", "ä!"), (3, 1, "tool", "ä!"), (3, 1, "", "b."), (3, 2, "user", "b.\n"), (None, 1, "user", "lost id"), (None, None, "user", "lost id"), (4, None, "user", ""),
    (5, 1, "user", "a."), (5, 1, "assistant", "b."), (5, -7, "assistant", "c." + "word " * 30000), (5, 2, "system", "later."), (5, 3, "system", "last."),
]
EXTRA = "has string, part int, n double, `a.b` int, letters array<int>"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 0.5, 2, [3]) for r in rows], "conv_id long, turn long, role string, text string, " + EXTRA)


def test_odd_rows(spark):
    want = {c: expected([r[1:] for r in ROWS if r[0] == c]) for c in {r[0] for r in ROWS}}
    for parts in (1, 7):
        assert by_id(R.summary(table(spark, ROWS).repartition(parts))) == want


def test_empty_tables_and_named_conversations(spark):
    none = table(spark, ROWS).limit(0)
    assert R.summary(none).collect() == [] and R.edits(none).collect() == [] and R.damaged(none).collect() == []
    got = by_id(R.summary(none, table(spark, ROWS)))
    assert set(got.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and len(got) == 6


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in [*range(8), None] for t in [*range(9), None]]
    want = []
    for c, t, r, x in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want += [] if fate == 0 else [(c, t, "user" if fate == 4 else r, "" if fate == 1 else "One Two Three" if fate == 2 else x)] * (2 if fate == 3 else 1)
    got = [tuple(r) for r in R.damaged(table(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({zlib.crc32(f"{c}:{t}".encode()) % 20 for c, t, *_ in rows}) == 20


def test_a_conversation_cut_into_many_pieces(spark):
    """One conversation of thousands of turns over several ranges, with repeats far from their first occurrence."""
    import random

    rng = random.Random(5)
    rows = [(7, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system"]), rng.choice(["again and again.", "", f"text {t} " + "w " * 200, f"text {t}."])) for t in range(1500)]
    rows += [(8, 1, "user", "same.")] * 3000
    whole = expected([r[1:] for r in rows if r[0] == 7][:300])
    few = [r for r in rows if r[0] == 7][:300] + [r for r in rows if r[0] == 8]
    got = by_id(R.summary(table(spark, few).repartition(6)))
    assert got[7] == whole and got[8][2] == 2999 and got[8][5:7] == (3 * 2999 + 2, "K" + "D" * 2999 + "I")
    cut, full = R.pieces(table(spark, rows)).collect(), by_id(R.summary(table(spark, rows)))
    assert len([r for r in cut if r.conv_id == 7 and r.kind == 1]) > 2 and len(full[7][6].replace("I", "")) == 1500


def test_edits_hold_the_repaired_turns(spark):
    rows = [r for r in ROWS if r[0] is not None]
    lines = {}
    for r in sorted(R.edits(table(spark, rows)).collect(), key=lambda r: (r.conv_id, r.place)):
        lines.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    for c, own in by_id(R.summary(table(spark, rows))).items():
        body = "\n".join(f"{role}:{text}" for edit, role, text in lines[c] if edit != "D")
        assert "".join(edit for edit, *_ in lines[c]) == own[6] and hashlib.sha256(body.encode()).hexdigest() == own[7]
        assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for edit, role, _ in lines[c] if edit != "D"))

"""Records with line breaks, cut by many tasks, against a reader that sees the whole file."""

import csv
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.sources import csv_files, records


def cut(lines, width, delimiter=b","):
    """All records by one cutter, lines fed in pieces of different sizes."""
    cutter, out, at = records.Cutter(delimiter, width), [], 0
    step = 1
    while at < len(lines):
        part = lines[at:at + step]
        out += cutter.feed(part, np.array([b'"' not in x for x in part]))
        at, step = at + step, step % 3 + 1
    return out + list(cutter.close()), cutter


@pytest.mark.parametrize("line, inside, want", [
    (b"a,b,c", False, (2, False, True)), (b'a,"b,c",d\r', False, (2, False, True)), (b'a,"b', False, (1, True, True)), (b'x"", b"', True, (0, False, True)),
    (b'5" pipe,x', False, (1, False, True)), (b'"a""",b', False, (1, False, True)), (b'"a""', False, (0, True, True)), (b'"a" x,b', False, (0, False, False)),
    (b"", False, (0, False, True)), (b"", True, (0, True, True)), (b'",', True, (1, False, True)), (b'a,', False, (1, False, True)), (b'","', False, (0, False, True)),
])
def test_advance(line, inside, want):
    assert records.advance(line, b",", inside) == want


def test_cutter():
    text = [b"1,a,b", b'2,"two', b'lines, ""x""",c', b'3,"5 inch,c', b'4,"ok",c', b'5,"never closed,c', b"6,x,y"]
    got, cutter = cut(text, 3)
    assert got == [b"1,a,b", b'2,"two\nlines, ""x""",c', b'3,"5 inch,c', b'4,"ok",c', b'5,"never closed,c', b"6,x,y"]
    assert (cutter.torn, cutter.stray) == (1, 2)


def random_lines(rng, n, width=3):
    def value():
        kind = rng.random()
        if kind < 0.55:
            return rng.choice(["", "x", "word", '5" x'])
        body = "".join(rng.choice(["a", "b,", '""', "\n", "\n\n", " "]) for _ in range(rng.randint(0, 7)))
        return f'"{body}"'

    out = []
    for _ in range(n):
        out.append(",".join(value() for _ in range(width)) if rng.random() > 0.07 else rng.choice(['7,"open,x', "short", '"open', ""]))
    return "\n".join(out).encode().split(b"\n")


class Row(dict):
    __getattr__ = dict.__getitem__


def summarised(lines, block, width):
    out, into, head = records.Cutter(b",", width), records.Cutter(b",", width), records.Head(b",")
    odd = np.zeros(len(lines), bool)
    list(out.feed(lines, odd))
    first = head.feed(lines)
    list(into.feed(lines[first:], odd[first:]))
    ends = lambda c: (c.fields if c.open else None, c.size)
    return Row(block=block, torn=out.torn, stray=out.stray, tail=ends(out)[0], size=ends(out)[1], head=head.state, head_fields=head.fields, head_size=head.size,
               torn_in=into.torn, stray_in=into.stray, tail_in=ends(into)[0], size_in=ends(into)[1])


@pytest.mark.parametrize("seed", range(60))
def test_ranges_give_the_records_of_the_whole(seed):
    """Any cut into ranges gives the records that one pass gives."""
    rng = random.Random(seed)
    lines, width = random_lines(rng, 40), 3
    whole, cutter = cut(lines, width)
    borders = sorted({0, *rng.sample(range(1, len(lines)), rng.randint(1, 12)), len(lines)})
    parts = [lines[a:b] for a, b in zip(borders, borders[1:])]
    crossing, torn, _ = records.resolve([summarised(p, a, width) for a, p in zip(borders, parts)], width)
    got, joined = [], {}
    for a, p in zip(borders, parts):
        entered, goes_on = crossing.get(a, (None, False))
        taken = 0
        if entered is not None:
            taken = records.Head(b",").feed(p)
            joined.setdefault(entered, []).append(b"\n".join(p[:taken]))
        c = records.Cutter(b",", width)
        got += list(c.feed(p[taken:], np.zeros(len(p) - taken, bool)))
        if c.open and goes_on:
            joined.setdefault(a, []).append(b"\n".join(c.open))
        else:
            got += list(c.close())
    assert sorted(got + [b"\n".join(x) for x in joined.values()]) == sorted(whole) and torn == cutter.torn


def write(path, rows, ending="\n", encoding="utf-8"):
    with open(path, "w", newline="", encoding=encoding) as f:
        csv.writer(f, lineterminator=ending, quoting=csv.QUOTE_ALL).writerows(rows)
    return str(path)


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    spark.conf.set("spark.sql.files.minPartitionNum", "64")
    yield
    for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{key}")


@pytest.mark.parametrize("ending, encoding", [("\n", "utf-8"), ("\r\n", "utf-8"), ("\n", "latin-1")])
def test_many_tasks_equal_one_reader(spark, tmp_path, small_ranges, ending, encoding):
    rng = random.Random(4)
    rows = [["id", "note", "code"]]
    for i in range(400):
        note = "".join(rng.choice(["é", 'say "x", ', "a, b", ending, "plain "]) for _ in range(rng.randint(1, 12))) + ("long\n" * 300 if i % 97 == 5 else "")
        rows.append([str(i), f"n{note}.", f"c{i}"])
    path = write(tmp_path / "notes.csv", rows, ending, encoding)
    lines = records.lines_of(spark, [path])
    assert lines.rdd.getNumPartitions() > 30
    df, report = csv_files.read_csv(spark, path)
    assert sorted(map(tuple, df.collect())) == sorted((int(i), note, code) for i, note, code in rows[1:])
    assert {"multi_line_records"} <= {a[0] for a in report.actions} and report.skipped_rows == 0 and report.encoding == encoding


def test_stray_quotes_are_reported_and_swallow_nothing(spark, tmp_path, small_ranges):
    body = [f'{i},"name {i}",{i % 7}' for i in range(300)]
    body[100] = '100,"5 inch pipe,2'
    path = tmp_path / "stray.csv"
    path.write_text("id,name,n\n" + "\n".join(body) + "\n")
    df, report = csv_files.read_csv(spark, str(path))
    assert df.count() == 300 and dict((a[0], a[2]) for a in report.actions)["stray_quotes"] == {"rows": "1"}
    assert "multi_line_records" not in [a[0] for a in report.actions]
    body[200] = '200,"two\nlines",4'
    path.write_text("id,name,n\n" + "\n".join(body) + "\n")
    df, report = csv_files.read_csv(spark, str(path))
    assert df.count() == 300 and df.filter(F.col("name").contains("\n")).count() == 1 and "stray_quotes" in [a[0] for a in report.actions]


def test_inch_marks_are_no_quotes(spark, tmp_path):
    path = tmp_path / "pipes.csv"
    path.write_text('id,size\n1,5" pipe\n2,7"\n3,"7"" x"\n')
    df, report = csv_files.read_csv(spark, str(path))
    assert sorted(map(tuple, df.collect())) == [(1, '5" pipe'), (2, '7"'), (3, '7" x')]
    assert not {"stray_quotes", "multi_line_records"} & {a[0] for a in report.actions}


def test_several_files_and_a_torn_header(spark, tmp_path, small_ranges):
    head = ["id", "two\nlines", "x"]
    for k in range(3):
        write(tmp_path / f"part{k}.csv", [head, *[[str(100 * k + i), f"a\n\n{i}", "y,\nz"] for i in range(60)]])
    df, _ = csv_files.read_csv(spark, str(tmp_path))
    assert df.columns == ["id", "two lines", "x"] and df.count() == 180
    assert sorted(r[0] for r in df.collect()) == sorted(100 * k + i for k in range(3) for i in range(60))


def test_surplus_fields_and_blank_lines_of_torn_files(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text('a,b\n\n1,"x\ny"\n2,p,q\n3\n4,z,\n   \n')
    df, report = csv_files.read_csv(spark, str(path))
    assert sorted(map(tuple, df.collect())) == [(1, "x\ny"), (3, None), (4, "z")] and report.skipped_rows == 1

import pytest
from conftest import by, one

from colonnade.functions import storage
from colonnade.plans.profile import ingest_csv
from colonnade.sources import csv_files, sinks, tables


def put(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiter_is_voted(spark, tmp_path, sep):
    path = put(tmp_path, "a.csv", f"a{sep}b{sep}c\n1{sep}2{sep}3\n")
    assert csv_files.detect_delimiters(spark, [path]).first()["delimiter"] == sep


def test_delimiter_defaults_to_comma_and_uses_five_lines(spark, tmp_path):
    path = put(tmp_path, "a.csv", "x\n\n1\n2\n3\n4\n;;;;;;;;\n")
    assert csv_files.detect_delimiters(spark, [path]).first()["delimiter"] == ","


def test_clean_csv(spark, tmp_path):
    path = put(tmp_path, "c.csv", "age,gender,income,target\n25,M,50000,0\n30,F,60000,1\n35,M,,0\n40,F,80000,1\n28,M,52000,0\n")
    df, report = csv_files.read_csv(spark, path)
    assert df.columns == ["age", "gender", "income", "target"]
    assert (df.count(), report.raw_rows, report.raw_columns, report.delimiter) == (5, 5, 4, ",")
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "bigint", "bigint"]


def test_messy_csv_drops_index_and_renames(spark, tmp_path):
    text = "Unnamed: 0,user_id,age,age,status,constant_col,notes\n0,1,25,25,a,1,x\n1,2,30,30,b,1,\n2,2,30,30,b,1,\n3,4,,41,c,1,z\n"
    df, report = csv_files.read_csv(spark, put(tmp_path, "m.csv", text))
    assert df.columns == ["user_id", "age", "age_1", "status", "constant_col", "notes"]
    kinds = [a[0] for a in report.actions]
    assert "unnamed_index" in kinds and "duplicate_or_empty_columns" in kinds
    assert report.to_df(spark).count() == len(kinds)


def test_index_column_that_does_not_step_by_one_stays(spark, tmp_path):
    df, _ = csv_files.read_csv(spark, put(tmp_path, "i.csv", "index,v\n5,1\n9,2\n"))
    assert df.columns == ["index", "v"]


def test_semicolon_latin1(spark, tmp_path):
    df, report = csv_files.read_csv(spark, put(tmp_path, "s.csv", "città;temperature;rainfall\nForlì;20,5;1.5\nKöln;18.0;2.5\n".encode("latin-1")))
    assert report.encoding == "latin-1" and report.delimiter == ";"
    assert df.columns[0] == "città"
    assert {r[0] for r in df.collect()} == {"Forlì", "Köln"}


def test_long_rows_are_skipped_and_counted_short_rows_padded(spark, tmp_path):
    df, report = csv_files.read_csv(spark, put(tmp_path, "b.csv", 'a,b\n1,"x,y"\n2,p,q\n3\n4,z\n'))
    assert report.skipped_rows == 1 and report.raw_rows == 3
    assert sorted(map(tuple, df.collect())) == [(1, "x,y"), (3, None), (4, "z")]
    assert one(report.facts(spark))["skipped_rows"] == 1


def test_empty_file_is_an_error(spark, tmp_path):
    with pytest.raises(csv_files.EmptyDatasetError):
        csv_files.read_csv(spark, put(tmp_path, "e.csv", ""))


def test_header_repair():
    names, renamed = csv_files.repair_header(["a", "a", "", "  ", " b  c ", "x.1"])
    assert names == ["a", "a_1", "Unnamed: 2", "column_4", "b c", "x_1"]
    assert renamed["a.1"] == "a_1"
    assert len(set(csv_files.repair_header(["a", "a", "a_1"])[0])) == 3


def test_preview_rounds_and_hides_non_finite(spark):
    df = spark.createDataFrame([(2, float("inf"), True), (1, 1.23456789, None), (3, float("nan"), False)], "k int, v double, b boolean")
    rows = tables.preview(df, ["k"], 2).collect()
    assert [(r["k"], r["v"], r["b"]) for r in rows] == [(1, 1.234568, None), (2, None, "true")]
    with pytest.raises(ValueError):
        tables.preview(df, ["k"], 101)


def test_result_and_run_sinks(spark):
    df = spark.createDataFrame([("run_1", 0.5), ("run_2", 0.7)], "run_id string, validation_score double")
    path = sinks.write_result(df, storage.scratch_path(spark, "r"), "parquet")
    assert sinks.read_result(spark, path, "parquet").count() == 2
    base = storage.scratch_path(spark, "runs")
    for run in ("run_1", "run_2"):
        sinks.append_run(df.filter(df.run_id == run), base, "d")
    sinks.append_run(df, base, "other")
    assert [r["run_id"] for r in sinks.list_runs(spark, base, "d").collect()] == ["run_2", "run_1"]
    assert sinks.get_run(spark, base, "run_2").filter("dataset = 'd'").count() == 1


def test_scratch_uses_the_sessions_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda _: str(tmp_path))
    assert storage.scratch_path(spark, "x").startswith(str(tmp_path))
    kept = storage.stored(spark.range(5), "numbers")
    assert kept.count() == 5 and any(tmp_path.iterdir())


def test_ingest_and_profile(spark, tmp_path):
    lines = ["age,gender,ratio,patient"] + [f"{20 + i % 50},{'Male' if i % 3 else 'Female'},{'' if i % 20 == 0 else i / 7:},{1 + i % 2}" for i in range(200)]
    lines += lines[1:6]
    parts = ingest_csv(spark, [put(tmp_path, "p.csv", "\n".join(lines))])
    assert parts["table"].count() == 205 and len(parts["table"].columns) == 4
    overview = one(parts["overview"])
    assert overview["missing_cells"] == 11 and overview["duplicate_rows"] == 6  # five repeats, and rows 40 and 140 agree
    kinds = by(parts["summary"], "column")
    assert kinds["gender"]["inferred_dtype"] == "categorical" and kinds["ratio"]["inferred_dtype"] == "float"
    assert parts["checks"].count() == 5 and parts["preview"].count() == 20 and parts["samples"].count() == 20


def test_line_breaks_in_quotes(spark, tmp_path):
    path = tmp_path / "notes.csv"
    path.write_text('id,note,code\n1,"two\nlines, ""quoted""",12d\n2,plain,3f\n')
    df, report = csv_files.read_csv(spark, str(path))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 'two\nlines, "quoted"', "12d"), (2, "plain", "3f")]
    assert report.skipped_rows == 0 and "multi_line_records" in [a[0] for a in report.actions]


def test_index_column_looks_at_all_rows(spark, tmp_path):
    path = tmp_path / "gaps.csv"
    path.write_text("index,v\n" + "".join(f"{i if i < 120 else i * 7},{i}\n" for i in range(130)))
    assert csv_files.read_csv(spark, str(path))[0].columns == ["index", "v"]


def test_storage_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext = Context()

    monkeypatch.setattr(storage, "shared_folder", lambda s: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.scratch_path(Session(), "x")

import pytest
from conftest import by, one

from colonnade.operators import catalog, quality


@pytest.mark.parametrize("kind,values,expected", [
    ("int", [1, 2, 3], "integer"),
    ("int", [0, 1, None], "boolean"),
    ("double", [1.5, 2.5, None], "float"),
    ("double", [1.0, 2.0, float("nan")], "integer"),
    ("double", [1e13, 2.0, 3.0], "float"),
    ("double", [None, None, None], "float"),
    ("boolean", [True, False, None], "boolean"),
    ("string", ["yes", "No", " yes "], "boolean"),
    ("string", ["2023-01-01", "2023-02-15", None], "datetime-like"),
    ("string", ["01/02/2023", "12/31/2023", None], "datetime-like"),
    ("string", ["1", "2", "3"], "integer"),
    ("string", ["1.5", "2", "-3"], "float"),
    ("string", ["5-LOW", "1-HIGH", "2-MID"], "categorical"),
    ("string", ["red", "blue", "red"], "categorical"),
    ("string", [None, None, None], "mixed"),
    ("string", ["word " * 20 + "a", "word " * 20 + "b", "word " * 20 + "c"], "text"),
    ("string", ["word " * 20, "word " * 20, "word " * 20], "categorical"),
])
def test_logical_types(spark, kind, values, expected):
    df = spark.createDataFrame([(v,) for v in values], f"c {kind}")
    assert catalog.column_types(df) == {"c": expected}
    assert catalog.column_summary(df).first()["inferred_dtype"] == expected


def test_structure(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, None, 5), (1, "a", 5), (4, "c", 5)], "num int, cat string, `const` int")
    s = by(catalog.column_summary(df), "column")
    assert s["cat"]["missing_count"] == 1 and s["cat"]["missing_percentage"] == 20.0
    assert s["const"]["is_constant"] and s["num"]["unique_count"] == 4
    assert one(catalog.duplicate_rows(df))["duplicate_rows"] == 1
    assert [r["column"] for r in catalog.constant_columns(catalog.column_summary(df)).collect()] == ["const"]


def test_duplicates_treat_missing_as_equal(spark):
    nan = float("nan")
    df = spark.createDataFrame([(None, nan), (None, nan), (1, 2.0)], "a int, b double")
    assert one(catalog.duplicate_rows(df))["duplicate_rows"] == 1


def test_odd_column_names_and_nested_columns(spark):
    df = spark.createDataFrame([(1, "it's", [1.0])], "`a.b` int, `x 'y` string, v array<double>")
    assert set(catalog.column_types(df)) == {"a.b", "x 'y"}
    assert {r["column"] for r in catalog.column_summary(df).collect()} == {"a.b", "x 'y"}


def test_long_distinct_texts_are_counted_by_digest(spark):
    df = spark.createDataFrame([("z" * 100 + str(i % 7),) for i in range(50)], "t string")
    assert catalog.column_summary(df).first()["unique_count"] == 7


def quality_frame(spark, rows, bad):
    data = [(f"user_{i}" if bad else f"group_{i % 3}", "2023-01-01" if bad else f"v{i % 4}", (i % 20) if i % 5 or not bad else None)
            for i in range(rows)]
    return spark.createDataFrame(data, f"{'user_id' if bad else 'team'} string, {'created_at' if bad else 'kind'} string, normal_val int")


def test_suspicious_columns_and_scores(spark):
    bad = quality_frame(spark, 50, True)
    found = {(r["column"], r["issue_type"]) for r in quality.suspicious_columns(catalog.column_summary(bad)).collect()}
    assert {("user_id", "id_like"), ("created_at", "constant")} <= found
    low = one(quality.quality_score(catalog.column_summary(bad), catalog.duplicate_rows(bad)))
    assert low["constant_columns"] == 5 and low["missing_data"] > 0
    ids = spark.range(100).selectExpr("id * 1.5 AS measure", "cast(id % 7 as int) AS k")
    high = one(quality.quality_score(catalog.column_summary(ids), catalog.duplicate_rows(ids)))
    assert high["quality_score"] >= 90 and high["rating"] == "Excellent"
    assert low["quality_score"] < high["quality_score"]


def test_degraded_table_scores_below_80(spark):
    rows = [(None if i % 2 else 1.0, "x", "same") for i in range(40)]
    df = spark.createDataFrame(rows, "half double, dup string, `const` string")
    summary, dup = catalog.column_summary(df), catalog.duplicate_rows(df)
    score = one(quality.quality_score(summary, dup))
    assert score["quality_score"] < 80
    checks = by(quality.quality_checks(summary, dup), "check_name")
    assert checks["Duplicate Rows"]["status"] == "fail" and checks["Constant Columns"]["status"] == "warning"
    assert checks["Missing Data"]["affected_columns"] == ["half"]


def test_overview_lists(spark):
    df = spark.createDataFrame([(1.5, "a", True, None)] * 3 + [(2.5, "b", False, None)], "n double, c string, b boolean, e string")
    o = one(catalog.dataset_overview(catalog.column_summary(df), catalog.duplicate_rows(df)))
    assert (o["rows"], o["columns"], o["missing_cells"], o["duplicate_rows"]) == (4, 4, 4, 2)
    assert o["numeric_names"] == ["n"] and o["boolean_names"] == ["b"] and o["categorical_names"] == ["c", "e"]

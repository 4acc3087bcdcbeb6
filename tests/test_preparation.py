import math

import pytest
from conftest import by, one
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from colonnade.functions import storage
from colonnade.operators import audit, features, split, suitability, target
from colonnade.plans.prepare import PreparationError, prepare
from colonnade.settings import Settings

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("kind,values,problem,confidence", [
    ("string", ["Yes", "No"] * 10, target.BINARY, "high"),
    ("string", ["A", "B", "C"] * 5, target.MULTICLASS, "high"),
    ("double", [i * 1.37 for i in range(35)], target.REGRESSION, "high"),
    ("int", [1, 2, 3, 4, 5] * 4, target.AMBIGUOUS, "medium"),
    ("int", list(range(25)), target.REGRESSION, "medium"),
    ("int", list(range(40)), target.REGRESSION, "high"),
    ("string", [f"value {i}" for i in range(120)], target.AMBIGUOUS, "low"),
])
def test_problem_types(spark, kind, values, problem, confidence):
    df = spark.createDataFrame([(v,) for v in values], f"t {kind}")
    found = target.inspect_target(df, "t")
    assert (found["problem_type"], found["confidence"]) == (problem, confidence)


@pytest.mark.parametrize("values", [[1] * 20, [1, 2, 3]])
def test_unusable_targets(spark, values):
    with pytest.raises(target.InvalidTargetError):
        target.inspect_target(spark.createDataFrame([(v,) for v in values], "t int"), "t")


def test_id_warning_and_balance(spark):
    ids = spark.range(60).selectExpr("id AS t")
    assert target.target_facts(ids, "t").first()["id_warning"]
    labels = spark.createDataFrame([("a",)] * 9 + [("b",)] + [(None,)], "t string")
    rows = by(target.class_balance(labels, "t"), "class_label")
    assert rows["b"]["percentage"] == 10.0 and rows["a"]["is_imbalanced"] and rows["a"]["minority_percentage"] == 10.0


def test_audit(spark):
    rows = [(i % 2, float(i % 17), 1, f"id_{i}", None if i % 100 < 85 else 2.5 + i, i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "target int, normal_feat double, const_col int, id_col string, missing_col double, target_copy int")
    a = by(audit.feature_audit(df, "target"), "column")
    assert a["const_col"]["status"] == "flagged_exclude" and "constant_column" in a["const_col"]["flags"]
    assert "potential_id" in a["id_col"]["flags"] and a["id_col"]["status"] == "review_recommended"
    assert "excessive_missingness" in a["missing_col"]["flags"]
    assert "duplicate_feature" in a["target_copy"]["flags"] and "leakage" in a["target_copy"]["reason"]
    assert a["normal_feat"]["status"] == "included" and a["normal_feat"]["reason"] is None
    t = one(audit.audit_totals(audit.feature_audit(df, "target")))
    assert (t["total_candidates"], t["included_count"], t["excluded_count"], t["review_count"]) == (5, 1, 4, 2)


def test_identical_columns_need_equal_types_and_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, 1, 1, NAN, None), (None, None, 2, 2.0, 2.0), (3, 3, 3, 3.0, 3.0)], "a int, b int, c int, d double, e double")
    pairs = {(r["column"], r["first_column"]) for r in audit.identical_columns(df).collect()}
    assert pairs == {("b", "a"), ("e", "d")}
    with pytest.raises(audit.TargetLeakageError):
        audit.verify_no_target(["a", "t"], "t")


def test_suitability(spark):
    rows = [(float(i), "x", i % 2, i) for i in range(50)]
    df = spark.createDataFrame(rows, "feat1 double, feat2 string, target_col int, leak_result_target_col int")
    found = suitability.training_suitability(df, "target_col", target.BINARY, ["feat1", "feat2", "leak_result_target_col"])
    codes = {(r["severity"], r["code"]) for r in found.collect()}
    assert codes == {("warning", "resembles_target"), ("warning", "small_table")} and suitability.is_suitable(found)
    few = suitability.training_suitability(df.limit(5).withColumn("k", F.lit(1)), "k", target.BINARY, [])
    assert {"no_features", "too_few_rows", "constant_target", "too_few_classes"} == {r["code"] for r in few.filter("severity = 'blocking'").collect()}
    assert not suitability.is_suitable(suitability.training_suitability(df, "nope", target.BINARY, ["feat1"]))


def test_stratified_split(spark):
    df = spark.range(100).selectExpr("id AS k", "id * 0.5 AS x", "cast(id < 20 AS int) AS y")
    tagged, strategy = split.train_test_split(df, "y", ["k"], target.BINARY, 0.2)
    n = {(r["fold"], r["y"]): r["count"] for r in tagged.groupBy("fold", "y").count().collect()}
    assert n == {("test", 0): 16, ("test", 1): 4, ("train", 0): 64, ("train", 1): 16} and strategy == split.STRATIFIED
    split.check_disjoint(tagged.filter("fold = 'train'"), tagged.filter("fold = 'test'"), ["k"])
    with pytest.raises(split.SplitError):
        split.check_disjoint(tagged, tagged, ["k"])
    again, _ = split.train_test_split(df.repartition(13).orderBy("x"), "y", ["k"], target.BINARY, 0.2)
    assert {r["k"] for r in again.filter("fold = 'test'").collect()} == {r["k"] for r in tagged.filter("fold = 'test'").collect()}


@pytest.mark.parametrize("n,share,digits", [(7, 0.2, 1), (103, 0.33, 1), (1000, 0.1, 2), (5, 0.5, 4)])
def test_split_sizes_are_exact(spark, n, share, digits):
    import math

    df = spark.range(n).selectExpr("id AS k", "cast(id AS double) AS y")
    tagged, _ = split.train_test_split(df, "y", ["k"], target.REGRESSION, share, settings=Settings(hash_digits=digits))
    assert tagged.filter("fold = 'test'").count() == math.ceil(share * n)


def test_rare_class_falls_back_to_random_and_missing_targets_are_dropped(spark):
    df = spark.createDataFrame([(i, None if i < 5 else ("rare" if i == 5 else "a")) for i in range(45)], "k int, y string")
    tagged, strategy = split.train_test_split(df, "y", ["k"], target.BINARY, 0.25)
    assert strategy == split.RANDOM and tagged.count() == 40 and tagged.filter("fold = 'test'").count() == 10
    with pytest.raises(split.SplitError):
        split.check_folds(tagged)
    with pytest.raises(split.SplitError):
        split.train_test_split(df, "y", ["k"], target.BINARY, 1.0)


def test_three_way(spark):
    df = spark.range(1250).selectExpr("id AS k", "id % 5 AS y")
    tagged, _ = split.three_way_split(df, "y", ["k"], target.MULTICLASS)
    n = {r["fold"]: r["n"] for r in split.check_folds(tagged).collect()}
    assert n == {"train": 800, "validation": 200, "test": 250}


def test_fit_sees_training_rows_only(spark):
    train = spark.createDataFrame([(10.0, "A"), (20.0, "B"), (30.0, "A")], "numeric double, category string")
    test = spark.createDataFrame([(1000.0, "C"), (2000.0, "A"), (3000.0, None)], "numeric double, category string")
    fitted = features.preparation(features.Routing([], ["numeric"], ["category"])).fit(train)
    table = one(fitted.stages[0].table(spark))
    assert table["fill"] == 20.0 and table["mean"] == 20.0
    assert table["scale"] == pytest.approx((200 / 3) ** 0.5)
    rows = [list(r["features"]) for r in fitted.transform(test).collect()]
    assert rows[0][1:] == [0.0, 0.0] and rows[1][1:] == [1.0, 0.0] and rows[2][1:] == [1.0, 0.0]
    names = features.feature_lineage(fitted, features.Routing([], ["numeric"], ["category"]))
    assert names == [("numeric", "numeric"), ("category_A", "category"), ("category_B", "category")]


def test_date_parts(spark):
    df = spark.createDataFrame([("2023-01-15", 1), ("2023-06-20", 2), ("2023-12-31", 3), ("soon", 4), (None, 5)], "d string, k int")
    out = features.DateParts(columns=["d"]).fit(df).transform(df).orderBy("k").collect()
    assert "d" not in out[0].asDict()
    assert [r["d_year"] for r in out] == [2023] * 5 and [r["d_month"] for r in out] == [1, 6, 12, 6, 6]
    assert [r["d_dayofweek"] for r in out[:3]] == [6, 1, 6]
    empty = features.DateParts(columns=["d"]).fit(df.filter("k > 3"))
    assert empty.value("medians")["d"] == features.DATE_DEFAULTS


def test_infinities_and_save_load(spark):
    df = spark.createDataFrame([(10.0, "X", 1), (INF, "Y", 2), (-INF, "X", 3), (40.0, "Y", 4)], "n double, c string, k int")
    fitted = features.preparation(features.Routing([], ["n"], ["c"])).fit(df)
    path = storage.scratch_path(spark, "p")
    fitted.write().overwrite().save(path)
    a = [r[0] for r in fitted.transform(df).orderBy("k").select("features").collect()]
    b = [r[0] for r in PipelineModel.load(path).transform(df).orderBy("k").select("features").collect()]
    assert a == b and len(a[0]) == 3 and all(v == v for row in a for v in row)


def test_imputation_choices(spark):
    df = spark.createDataFrame([(1.0, "b"), (1.0, "a"), (4.0, None), (None, "a"), (None, "b")], "n double, c string")
    fill = lambda how: features.NumberPrep(columns=["n"], imputation=how, scaling="none").fit(df).value("fills")["n"]
    assert (fill("median"), fill("mean"), fill("most_frequent")) == (1.0, 2.0, 1.0)
    assert features.CategoryFill(columns=["c"]).fit(df).value("fills")["c"] == "a"
    constant = features.CategoryFill(columns=["c"], imputation="constant").fit(df).transform(df)
    assert constant.filter("c = '__MISSING__'").count() == 1
    with pytest.raises(ValueError):
        features.NumberPrep(columns=["n"], imputation="guess").fit(df)
    flat = features.NumberPrep(columns=["n"]).fit(df.filter("n = 1"))
    assert flat.value("scale")["n"] == 1.0


def test_prepare_mixed_table(spark):
    rows = [(i, 20 + i % 40, 1000.0 + i * 3.5 if i % 9 else None, ["HR", "IT", "Ops", "Law"][i % 4], ["lo", "mid", "hi"][i % 3],
             f"2023-{1 + i % 12:02d}-11", "Yes" if i % 3 else "No") for i in range(150)]
    df = spark.createDataFrame(rows, "k int, age int, income double, department string, tier string, joined string, churn string")
    done = prepare(df, "churn", ["k"], target.BINARY, validation_size=0)
    names = [f for f, _ in done.lineage]
    assert {"age", "income", "department_HR", "tier_hi", "joined_year", "joined_dayofweek"} <= set(names) and len(names) == 13
    r = one(done.report())
    assert (r["train_rows"], r["test_rows"], r["final_features"], r["datetime_features"], r["one_hot_features"]) == (120, 30, 13, 4, 7)
    out = done.transformed()
    assert out.count() == 150
    train = out.filter("fold = 'train'").select(vector_to_array("features")[0].alias("v")).agg(F.avg("v"), F.stddev_pop("v")).first()
    assert train[0] == pytest.approx(0, abs=1e-9) and train[1] == pytest.approx(1)
    assert done.preview(5).count() == 5
    assert prepare(df, "churn", ["k"], target.BINARY, selected=["age"]).selected == ["age"]
    assert "tier" not in prepare(df, "churn", ["k"], target.BINARY, excluded=["tier"]).selected
    with pytest.raises(PreparationError):
        prepare(df, "churn", ["k"], target.BINARY, selected=["churn"])


def test_fitted_pipeline_scores_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(float(i), "a" if i % 2 else "b") for i in range(20)], "n double, c string")
    fitted = features.preparation(features.Routing([], ["n"], ["c"])).fit(df)
    df.write.parquet(str(tmp_path / "in"))
    stream = fitted.transform(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("prepared_rows").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert spark.table("prepared_rows").count() == 20
    finally:
        q.stop()


@pytest.mark.parametrize("digits, rows", [(1, 3), (2, 40), (4, 250_000)])
def test_cutoffs_of_many_classes(spark, digits, rows):
    sizes = {f"c{i}": 2 + (i * i) % 23 for i in range(900)} | {"hot": 4000, "": 5}
    data = spark.createDataFrame([(f"{c}-{k}", c) for c, n in sizes.items() for k in range(n)], "k string, y string")
    hashes = data.select(F.col("y").alias("cls"), F.md5("k").alias("h"))
    got = {r["cls"]: r["cutoff"] for r in split.cutoffs(hashes, 0.3, Settings(hash_digits=digits, range_rows=rows)).collect()}
    by_class = {}
    for r in hashes.collect():
        by_class.setdefault(r["cls"], []).append(r["h"])
    total = sum(sizes.values())
    kept = total - math.ceil(0.3 * total)
    exact = {c: kept * n / total for c, n in sizes.items()}
    extra = kept - sum(map(math.floor, exact.values()))
    lucky = sorted(sizes, key=lambda c: (math.floor(exact[c]) - exact[c], c))[:extra]
    want = {}
    for c, n in sizes.items():
        held = n - math.floor(exact[c]) - (c in lucky)
        if held:
            want[c] = sorted(by_class[c])[held - 1]
    assert got == want


def test_classes_that_meet_few_rows_and_clashing_names(spark):
    data = spark.createDataFrame([(i, f"y{i % 400}", i, 1.0) for i in range(1600)], "k long, cls string, cutoff long, h double")
    tagged, strategy = split.three_way_split(data, "cls", ["k"], target.MULTICLASS, 0.25, 1 / 3)
    assert strategy == split.STRATIFIED and set(tagged.columns) == {"k", "cls", "cutoff", "h", "fold"}
    n = {(r["cls"], r["fold"]): r["n"] for r in tagged.groupBy("cls", "fold").agg(F.count("*").alias("n")).collect()}
    assert all(n[f"y{i}", "test"] == 1 and n[f"y{i}", "validation"] == 1 and n[f"y{i}", "train"] == 2 for i in range(400))

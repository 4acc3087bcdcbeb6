import random

import numpy as np
import pytest
from conftest import by, one
from pyspark.sql import functions as F

from colonnade.functions.quantiles import order_statistics
from colonnade.functions.ranking import running_totals
from colonnade.operators import association, catalog, charts, distribution, statistics
from colonnade.plans.explore import explore
from colonnade.settings import Settings

NAN, INF = float("nan"), float("inf")
SMALL = Settings(one_task_rows=10, range_rows=10, exact_percentile_rows=10, quantile_bins=8)


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}")


def test_standard_numbers(spark):
    r = one(statistics.numeric_profile(column(spark, [10.0, 20.0, 30.0, 40.0, 50.0]), ["c"]))
    assert (r["mean"], r["median"], r["q1"], r["q3"], r["iqr"]) == (30.0, 30.0, 20.0, 40.0, 20.0)
    assert r["skewness"] == 0.0 and r["kurtosis"] == -1.2


def test_nan_and_infinity_are_missing(spark):
    r = one(statistics.numeric_profile(column(spark, [10.0, NAN, INF, -INF, 20.0, 30.0]), ["c"]))
    assert (r["valid_count"], r["missing_count"], r["mean"], r["min"], r["max"]) == (3, 3, 20.0, 10.0, 30.0)


def test_all_null_constant_single(spark):
    empty = one(statistics.numeric_profile(column(spark, [None] * 3), ["c"]))
    assert empty["mean"] is None and empty["q1"] is None and empty["valid_count"] == 0
    const = one(statistics.numeric_profile(column(spark, [42.0] * 4), ["c"]))
    assert const["std"] == 0.0 and const["iqr"] == 0.0 and const["skewness"] is None
    single = one(statistics.numeric_profile(column(spark, [99.0]), ["c"]))
    assert single["std"] == 0.0 and single["median"] == 99.0


@pytest.mark.parametrize("values", [
    [random.Random(1).gauss(0, 1) for _ in range(500)],
    [random.Random(2).lognormvariate(0, 6) for _ in range(500)],
    [0.0] * 300 + [float(i) for i in range(200)],
    [1e308, -1e308, 0.0, 1.0, 2.0, 5e-324] * 20,
    [3.0], [1.0, 2.0], [7.0] * 50,
])
def test_quantiles_by_narrowing_are_exact(spark, values):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    long = spark.createDataFrame([("g", v) for v in values] + [("h", v / 4) for v in values], "grp string, v double")
    got = order_statistics(long, probs, SMALL)
    for grp, scale in (("g", 1), ("h", 4)):
        ordered = sorted(v / scale for v in values)
        for p, have in zip(probs, got[grp]):
            at = p * (len(ordered) - 1)
            lo, hi = ordered[int(at)], ordered[min(int(at) + 1, len(ordered) - 1)]
            assert have == pytest.approx(lo + (hi - lo) * (at - int(at)), rel=1e-12, abs=1e-300)


def test_profile_is_the_same_in_both_forms(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.random(), rng.choice([1.0, 2.0, None])) for _ in range(300)], "a double, b double")
    assert statistics.numeric_profile(df, ["a", "b"]).collect() == statistics.numeric_profile(df, ["a", "b"], SMALL).collect()
    assert statistics.outliers(df, ["a", "b"]).collect() == statistics.outliers(df, ["a", "b"], settings=SMALL).collect()


def test_empty_table(spark):
    df = column(spark, [])
    assert one(statistics.numeric_profile(df, ["c"], SMALL))["count"] == 0
    assert one(statistics.outliers(df, ["c"]))["q1"] is None
    assert charts.histogram(df, "c").count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_match_a_plain_scan(spark, descending):
    rng = random.Random(4)
    rows = [(k, float(p), rng.randint(0, 5)) for k in "ab" for p in rng.sample(range(1000), 120)]
    df = spark.createDataFrame(rows, "k string, p double, n int")
    for limit in (1000, 25):
        out = running_totals(df, ["k"], "p", ["n"], len(rows), Settings(range_rows=limit), descending)
        got = {(r["k"], r["p"]): r["n_before"] for r in out.collect()}
        assert len(got) == len(rows)
        for k, p, _ in rows:
            want = sum(n for k2, p2, n in rows if k2 == k and (p2 > p if descending else p2 < p))
            assert got[(k, p)] == want


def test_fruit(spark):
    df = column(spark, ["apple", "apple ", " apple", "banana", "banana", "cherry", None], "string")
    r = one(statistics.categorical_profile(df, ["c"], top=2))
    assert (r["unique_values"], r["mode"], r["mode_count"], r["other_count"], r["missing_count"]) == (3, "apple", 3, 1, 1)
    top = [(t["category"], t["n"], t["percentage"]) for t in statistics.top_categories(df, ["c"], 2).orderBy("rank").collect()]
    assert top == [("apple", 3, 42.86), ("banana", 2, 28.57)]
    empty = one(statistics.categorical_profile(column(spark, [None, None], "string"), ["c"]))
    assert empty["mode"] is None and empty["unique_values"] == 0 and empty["missing_count"] == 2


def test_missing(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, None), (3, None, 3.0), (4, "x", 4.0)], "a int, b string, c double")
    m = statistics.missing_by_column(df)
    assert [r["column"] for r in m.collect()] == ["b", "c", "a"]
    t = one(statistics.missing_totals(m))
    assert (t["total_cells"], t["total_missing_cells"], t["severe_missing_columns"]) == (12, 4, ["b"])
    bars = by(charts.missingness_bars(m), "column")
    assert (bars["b"]["severity"], bars["c"]["severity"], bars["a"]["severity"]) == ("severe", "moderate", "low")


def test_temporal_span(spark):
    df = spark.sql("SELECT date_format(date_add(DATE'2023-01-01', cast(id AS int)), 'yyyy-MM-dd') AS t FROM range(60)")
    r = one(statistics.temporal_profile(df))
    assert r["date_range_days"] == 59.0 and r["valid_dates_count"] == 60


def test_correlation_matches_numpy_with_gaps(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(1e6, 3, 400)
    b = 2 * a + rng.normal(0, 5, 400)
    rows = [(float(x), None if i % 7 == 0 else float(y), 5.0, INF if i % 11 == 0 else float(x * y)) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    m = by(association.correlation_matrix(df, ["a", "b", "c", "d"]), "feature_a", "feature_b")
    keep = np.array([i % 7 != 0 for i in range(400)])
    assert m[("a", "b")]["correlation"] == round(np.corrcoef(a[keep], b[keep])[0, 1], 4)
    assert m[("b", "a")] == {**m[("a", "b")], "position_a": 1, "position_b": 0, "feature_a": "b", "feature_b": "a"}
    assert m[("c", "c")]["correlation"] == 0.0 and m[("a", "c")]["correlation"] == 0.0 and m[("a", "a")]["correlation"] == 1.0
    strong = association.strong_pairs(association.correlation_matrix(df, ["a", "b", "c", "d"])).collect()
    assert all(r["abs_correlation"] >= 0.5 for r in strong) and (strong[0]["feature_a"], strong[0]["feature_b"]) != ("c", "d")


def test_column_selection_above_the_limit(spark):
    df = spark.createDataFrame([(float(i), 100.0 + i, float(i * i)) for i in range(10)], "a double, b double, c double")
    assert association.select_columns(df, ["a", "b", "c"], 2) == ["c", "a"]
    m = association.correlation_matrix(df, limit=2)
    assert m.count() == 4


def test_target_associations_guards(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, None), (4.0, 5.0, 8.0)], "x double, k double, y double")
    assert [r["feature"] for r in association.target_associations(df, "y", ["x", "k"]).collect()] == ["x"]


def test_outlier(spark):
    r = one(statistics.outliers(column(spark, [float(v) for v in range(10, 20)] + [1000.0]), ["c"]))
    assert (r["upper_count"], r["lower_count"], r["has_outliers"]) == (1, 0, True)
    few = one(statistics.outliers(column(spark, [1.0, 2.0, 3.0]), ["c"]))
    assert few["q1"] is None and few["outliers_count"] == 0 and few["min_val"] is None


def test_stress_scenario(spark):
    rows = [(None, 1.0 if i % 2 else None, "const", f"id_{i}", -500.0 if i == 0 else 500.0 if i == 1 else float(i % 10)) for i in range(100)]
    df = spark.createDataFrame(rows, "all_missing double, half_missing double, constant_val string, high_card_id string, outlier_col double")
    t = one(statistics.missing_totals(statistics.missing_by_column(df)))
    assert t["severe_missing_columns"] == ["all_missing", "half_missing"]
    o = one(statistics.outliers(df, ["outlier_col"]))
    assert o["lower_count"] == 1 and o["upper_count"] == 1


def test_histogram_and_box(spark):
    h = charts.histogram(column(spark, [0.0, 0.5, 1.0, 10.0, None, INF]), "c", 10).orderBy("bin").collect()
    assert [r["n"] for r in h] == [2, 1, 0, 0, 0, 0, 0, 0, 0, 1] and (h[0]["bin_start"], h[-1]["bin_end"]) == (0.0, 10.0)
    flat = charts.histogram(column(spark, [4.0, 4.0]), "c", 4).collect()
    assert sum(r["n"] for r in flat) == 2 and {r["bin_start"] for r in flat} == {3.5, 3.75, 4.0, 4.25}
    b = one(charts.box_numbers(column(spark, [float(v) for v in range(10, 20)] + [1000.0]), ["c"]))
    assert (b["lower_whisker"], b["upper_whisker"], b["outliers_count"]) == (10.0, 19.0, 1)


def test_bars_have_other(spark):
    df = column(spark, [f"c{i % 12}" for i in range(60)], "string")
    bars = charts.category_bars(df, "c").orderBy("rank").collect()
    assert len(bars) == 11 and (bars[-1]["category"], bars[-1]["n"]) == ("Other", 10)
    assert charts.category_bars(column(spark, ["a", "b"], "string"), "c").count() == 2


def test_chart_rules(spark):
    df = spark.createDataFrame(
        [(1.5, 2.5, "a", "x", "2023-01-01"), (2.5, 3.5, "b", "y", "2023-01-02"), (3.5, 4.5, "a", "x", "2023-01-03"),
         (4.5, 5.5, "b", "y", "2023-01-04"), (5.5, 6.5, "a", "x", "2023-01-05")],
        "num1 double, num2 double, cat1 string, cat2 string, dt string").selectExpr("monotonically_increasing_id() AS k", "*")
    expected = {("num1", "num2"): "scatter", ("cat1", "num1"): "box", ("cat1", "cat2"): "heatmap", ("num1", None): "histogram",
                ("cat1", None): "bar", ("dt", "num1"): "line", ("dt", None): "histogram"}
    for (x, y), kind in expected.items():
        name, data = charts.chart_data(df, x, y, ["k"])
        assert name == kind and data.count() > 0
    with pytest.raises(charts.UnsupportedChartError):
        charts.chart_data(df, "dt", "cat1", ["k"])
    with pytest.raises(catalog.UnknownColumnError):
        charts.chart_data(df, "nope", None, ["k"])


def test_trend_needs_three_points_and_a_spread(spark):
    line = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0)], "x double, y double")
    r = one(charts.trend_line(line, "x", "y"))
    assert (r["slope"], r["intercept"], r["y_at_min"], r["y_at_max"]) == (2.0, 1.0, 3.0, 7.0)
    assert charts.trend_line(line.limit(2), "x", "y").count() == 0
    assert charts.trend_line(line.selectExpr("1.0D AS x", "y"), "x", "y").count() == 0


@pytest.mark.parametrize("limit_rows", [10_000, 60])
def test_time_series_positions_with_a_hot_time(spark, limit_rows):
    rows = [(i, "2024-01-01" if i % 3 == 0 else f"2024-02-{1 + i % 28:02d}", float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, t string, v double")
    out = charts.time_series(df, "t", "v", ["k"], 100, Settings(range_rows=limit_rows, one_task_rows=limit_rows))
    assert out.count() == 100  # 900 // 100 = 9, every ninth of 900
    again = charts.time_series(df.repartition(7), "t", "v", ["k"], 100)
    assert set(out.collect()) == set(again.collect())


def test_scatter_is_reproducible_and_contingency_zero_filled(spark):
    df = spark.range(5000).selectExpr("id AS k", "id * 1.5 AS x", "id * 2.5 AS y")
    a, b = charts.scatter_sample(df, "x", "y", ["k"]), charts.scatter_sample(df.repartition(9), "x", "y", ["k"])
    assert set(a.collect()) == set(b.collect()) and a.count() == 2000 and a.first()["sampled"]
    c = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "p string, q string")
    cellmap = by(charts.contingency(c, "p", "q"), "x", "y")
    assert cellmap[("a", "x")]["n"] == 2 and cellmap[("a", "y")]["n"] == 0 and len(cellmap) == 4


def test_grouped_box_both_forms(spark):
    df = spark.createDataFrame([(f"g{i % 10}", float(i * 7 % 101)) for i in range(300)], "g string, v double")
    a, b = charts.grouped_box(df, "g", "v"), charts.grouped_box(df, "g", "v", settings=SMALL)
    assert a.count() == 8 and set(a.collect()) == set(b.collect())


def test_bundles_and_plan(spark):
    df = spark.createDataFrame([(i, 20 + i % 30, "M" if i % 2 else "F", f"2023-01-{1 + i % 28:02d}") for i in range(90)],
                               "row_id int, age int, gender string, signup string")
    assert set(distribution.column_distribution(df, "age")) == {"stats", "outliers", "histogram", "box"}
    assert set(distribution.column_distribution(df, "signup")) == {"temporal", "chart"}
    assert set(distribution.column_distribution(df, "gender")) == {"stats", "chart"}
    assert "associations" in distribution.target_analysis(df, "age")
    flagged = spark.createDataFrame([("a",)] * 9 + [("b",)], "t string")
    assert one(distribution.target_analysis(flagged, "t")["stats"])["is_imbalanced"]
    parts = explore(df)
    assert parts["numeric"].count() == 2 and parts["categorical"].count() == 1 and parts["temporal"].count() == 1
    with pytest.raises(catalog.UnknownColumnError):
        distribution.column_distribution(df, "nope")


def test_top_categories_of_long_texts(spark):
    same = "s" * 300
    values = {same + f"{i:03d}": 2 for i in range(40)} | {same: 2, same + "z" * 900: 2, "s" * 64: 2, "s" * 65: 2, "s" * 128: 2, "a" * 500: 7, "short": 5, "é" * 70: 2, "once" * 40: 1}
    df = spark.createDataFrame([(v, v[:3]) for v, n in values.items() for _ in range(n)] + [(None, None)], "long string, brief string")
    for top in (1, 2, 3, 5, 6, 9, 12, 60):
        want = sorted(values.items(), key=lambda p: (-p[1], p[0].encode()))[:top]
        rows = statistics.top_categories(df, ["long", "brief"], top).filter("column = 'long'").orderBy("rank").collect()
        assert [(r["category"], r["n"], r["rank"]) for r in rows] == [(v, n, i + 1) for i, (v, n) in enumerate(want)]
    r = one(statistics.categorical_profile(df, ["long"], 3))
    assert (r["valid_count"], r["unique_values"], r["mode"], r["mode_count"], r["other_count"]) == (sum(values.values()), len(values), "a" * 500, 7, sum(values.values()) - 14)


def test_long_texts_do_not_cross_the_network(spark):
    df = spark.createDataFrame([(f"{i:04d}" + "x" * 5000,) for i in range(400)], "t string")
    counts = statistics.category_counts(df, ["t"])
    assert counts.agg(F.max(F.length("head")), F.max(F.length("digest")), F.count("*")).first()[:] == (64, 32, 400)
    assert [r["category"][:4] for r in statistics.top_categories(df, ["t"], 3).orderBy("rank").collect()] == ["0000", "0001", "0002"]

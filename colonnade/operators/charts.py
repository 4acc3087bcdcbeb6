"""Rows a plotting tool would draw: binned, ranked, thinned or sampled on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colonnade.functions import cells
from colonnade.functions.quantiles import grouped_quantiles
from colonnade.functions.ranking import running_totals
from colonnade.operators import association, catalog, statistics
from colonnade.settings import DEFAULTS, Settings


class UnsupportedChartError(ValueError):
    pass


def missingness_bars(by_column: DataFrame) -> DataFrame:
    """Missing share per column with a severity, lowest first."""
    share = F.col("missing_percentage")
    return by_column.select(
        "position", "column", "missing_count", "missing_percentage",
        F.when(share >= 50, "severe").when(share > 10, "moderate").otherwise("low").alias("severity"),
    ).orderBy("missing_percentage", "position")


def bin_edges(df: DataFrame, column: str) -> tuple[float, float] | None:
    """Range of a numeric column on the driver; a constant range is widened by half a unit each way."""
    v = cells.number(df, column)
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    if lo is None:
        return None
    return (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)


def histogram(
    df: DataFrame, column: str, bins: int | None = None, keys: list[str] | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Counts in equal bins over the whole range, last bin closed, empty bins included."""
    catalog.require_columns(df, column)
    bins = settings.histogram_bins if bins is None else bins
    edges = bin_edges(df, column)
    if edges is None:
        return statistics._empty(df, "bin long, bin_start double, bin_end double, n long")
    lo, hi = edges
    v = cells.number(df, column)
    b = F.least(F.width_bucket(v, F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins))
    counted = df.filter(v.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(1, bins + 1, 1, 1).select(F.col("id").alias("bin"))
    width = (hi - lo) / bins
    return every.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        F.round(F.lit(lo) + (F.col("bin") - 1) * F.lit(width), 4).alias("bin_start"),
        F.round(F.lit(lo) + F.col("bin") * F.lit(width), 4).alias("bin_end"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def box_numbers(
    df: DataFrame, columns: list[str], multiplier: float | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Quartiles, whisker ends (last value inside the fences) and outlier count per column."""
    catalog.require_columns(df, *columns)
    multiplier = settings.iqr_multiplier if multiplier is None else multiplier
    narrow = df.select(*[cells.quoted(c) for c in columns])
    ranges = statistics.column_ranges(narrow, columns, settings)
    quarts = statistics.quantiles_of(narrow, columns, ranges, [0.25, 0.5, 0.75], settings)
    wide = cells.numbers(narrow, columns)
    aggs, structs = {}, []
    for i, c in enumerate(columns):
        if not ranges[c]["n"]:
            continue
        q1, q2, q3 = quarts[c]
        reach = multiplier * (q3 - q1)
        inside = f"v_{i} BETWEEN {cells.sql_double(q1 - reach)} AND {cells.sql_double(q3 + reach)}"
        aggs |= {
            f"lo_{i}": f"min(v_{i}) FILTER (WHERE {inside})", f"hi_{i}": f"max(v_{i}) FILTER (WHERE {inside})",
            f"out_{i}": f"count_if(NOT ({inside}))",
        }
        structs.append({
            "column": cells.sql_text(c),
            **{k: f"round({cells.sql_double(v)}, 4)" for k, v in (("q1", q1), ("median", q2), ("q3", q3))},
            "lower_whisker": f"round(lo_{i}, 4)", "upper_whisker": f"round(hi_{i}, 4)", "outliers_count": f"out_{i}",
        })
    if not structs:
        return statistics._empty(df, "`column` string, q1 double, median double, q3 double, lower_whisker double, "
                                     "upper_whisker double, outliers_count long")
    return cells.inline_rows(cells.aggregate(wide, aggs), structs)


def category_bars(df: DataFrame, column: str, top: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Most frequent categories, then one `Other` bar when something is left over."""
    top = settings.top_categories if top is None else top
    bars = statistics.top_categories(df, [column], top, settings).select("rank", "category", "n")
    rest = (
        statistics.categorical_profile(df, [column], top, settings)
        .filter("other_count > 0")
        .select(F.lit(top + 1).cast("long").alias("rank"), F.lit("Other").alias("category"),
                F.col("other_count").alias("n"))
    )
    return bars.unionByName(rest)


def correlation_heatmap(df: DataFrame, columns: list[str] | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Heatmap cells in column order: (row, col, feature_a, feature_b, z)."""
    m = association.correlation_matrix(df, columns, settings)
    return m.select(
        F.col("position_a").alias("row"), F.col("position_b").alias("col"),
        "feature_a", "feature_b", F.col("correlation").alias("z"),
    )


def records_over_time(df: DataFrame, column: str, unit: str = "day") -> DataFrame:
    """Row count per calendar unit."""
    catalog.require_columns(df, column)
    t = cells.time(df, column)
    return (
        df.select(F.date_trunc(unit, t).cast("timestamp_ntz").alias("bucket"))
        .filter(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(F.count("*").alias("n"))
    )


def _points(df: DataFrame, x: str, y: str, keep: list[str]) -> DataFrame:
    both = df.select(*[cells.quoted(k) for k in keep], cells.number(df, x).alias("x"), cells.number(df, y).alias("y"))
    return both.dropna(subset=["x", "y"])


def scatter_sample(
    df: DataFrame, x: str, y: str, keys: list[str], limit: int | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Complete pairs; above the limit a reproducible sample, chosen by the hash of the row key.

    The top-k keeps at most `limit` rows per task, so the table is not sorted.
    """
    catalog.require_columns(df, x, y, *keys)
    limit = settings.chart_points if limit is None else limit
    points = _points(df, x, y, keys)
    total = points.count()
    chosen = points.orderBy(cells.hash_order(keys, settings.seed), *keys).limit(limit)
    return chosen.select(
        *keys,
        F.round("x", 4).alias("x"), F.round("y", 4).alias("y"),
        F.lit(total > limit).alias("sampled"), F.lit(total).cast("long").alias("total_points"),
    )


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line over all complete pairs and its two end points; needs more than two points."""
    catalog.require_columns(df, x, y)
    fit = _points(df, x, y, []).agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"), F.min("x").alias("x_min"), F.max("x").alias("x_max"),
    )
    at = lambda end: F.round(F.col("slope") * F.col(end) + F.col("intercept"), 4)
    return fit.filter((F.col("n") > 2) & F.col("slope").isNotNull()).select(
        "n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"),
        F.round("x_min", 4).alias("x_min"), F.round("x_max", 4).alias("x_max"),
        at("x_min").alias("y_at_min"), at("x_max").alias("y_at_max"),
    )


def time_series(
    df: DataFrame,
    time_column: str,
    value: str,
    keys: list[str],
    limit: int | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Every stride-th row in time order, stride = max(n // limit, 1) above the limit.

    Positions come from counts per (time, hash prefix of the key): running totals of the
    counts tell which few groups hold a wanted position, and only rows of those groups are
    ranked. Rows with equal times are ordered by the key's hash, so a time shared by a third
    of the table still splits into many small groups.
    """
    catalog.require_columns(df, time_column, value, *keys)
    limit = settings.chart_points if limit is None else limit
    points = df.select(
        *[cells.quoted(k) for k in keys],
        cells.time(df, time_column).alias("t"),
        cells.number(df, value).alias("v"),
        cells.hash_order(keys, settings.seed).alias("h"),
    ).dropna(subset=["t", "v"]).withColumn("prefix", F.substring("h", 1, settings.hash_digits))
    total = points.count()
    stride = max(total // limit, 1) if total > limit else 1
    if stride == 1:
        return points.select("t", F.round("v", 4).alias("v"), *keys)
    groups = points.groupBy("t", "prefix").agg(F.count("*").alias("n"))
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("t")).cast("double")
    placed = running_totals(
        groups.withColumn("at", micros), [], "at", ["n"], total, settings, ties=[F.col("t"), F.col("prefix")]
    )
    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1
    wanted = placed.filter(F.ceil(first / stride) <= F.floor(last / stride)).select("t", "prefix", "n_before")
    # At most one group per wanted position: total / stride + 1 rows, below twice the limit.
    near = points.join(F.broadcast(wanted), ["t", "prefix"])
    w = Window.partitionBy("t", "prefix").orderBy("h", *keys)
    position = F.col("n_before") + F.row_number().over(w) - 1
    return near.withColumn("position", position).filter(F.col("position") % stride == 0).select(
        "t", F.round("v", 4).alias("v"), *keys
    )


def bucketed_series(df: DataFrame, time_column: str, value: str, unit: str = "hour") -> DataFrame:
    """Mean, lowest and highest value per calendar unit: the summary form of the series."""
    catalog.require_columns(df, time_column, value)
    pairs = df.select(F.date_trunc(unit, cells.time(df, time_column)).cast("timestamp_ntz").alias("bucket"),
                      cells.number(df, value).alias("v")).dropna()
    return pairs.groupBy("bucket").agg(
        F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.min("v").alias("low"), F.max("v").alias("high")
    )


def grouped_box(
    df: DataFrame, category: str, value: str, top: int | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Quartiles of a number per category, for the most frequent categories, over all their rows."""
    catalog.require_columns(df, category, value)
    top = settings.chart_categories if top is None else top
    pairs = df.select(cells.category(df, category).alias("category"), cells.number(df, value).alias("v")).dropna()
    counts = pairs.groupBy("category").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    best = counts.orderBy(F.desc("n"), "category").limit(top).collect()
    if not best:
        return statistics._empty(df, "rank long, category string, n long, min double, q1 double, median double, "
                                     "q3 double, max double")
    names = [r["category"] for r in best]
    chosen = pairs.filter(F.col("category").isin(names))
    quarts = grouped_quantiles(chosen, "category", F.col("v"), [0.25, 0.5, 0.75], settings, sum(r["n"] for r in best))
    heads = df.sparkSession.createDataFrame(
        [(i + 1, r["category"], r["n"], r["low"], r["high"]) for i, r in enumerate(best)],
        "rank long, category string, n long, low double, high double",
    )
    return quarts.join(F.broadcast(heads), "category").select(
        "rank", "category", "n", F.round("low", 4).alias("min"), F.round(F.col("q")[0], 4).alias("q1"),
        F.round(F.col("q")[1], 4).alias("median"), F.round(F.col("q")[2], 4).alias("q3"),
        F.round("high", 4).alias("max"),
    )


def contingency(df: DataFrame, x: str, y: str, top: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Counts of the most frequent x values against the most frequent y values, zeros filled in."""
    catalog.require_columns(df, x, y)
    top = settings.chart_categories if top is None else top
    pairs = df.select(cells.category(df, x).alias("x"), cells.category(df, y).alias("y")).dropna()

    def best(c: str) -> list[str]:
        ranked = pairs.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(top).collect()
        return [r[c] for r in ranked]

    top_x, top_y = best("x"), best("y")
    grid = df.sparkSession.createDataFrame(
        [(i + 1, j + 1, a, b) for j, b in enumerate(top_y) for i, a in enumerate(top_x)],
        "x_rank long, y_rank long, x string, y string",
    )
    counted = (
        pairs.filter(F.col("x").isin(top_x) & F.col("y").isin(top_y)).groupBy("x", "y").agg(F.count("*").alias("n"))
    )
    return grid.join(F.broadcast(counted), ["x", "y"], "left").select(
        "x_rank", "y_rank", "x", "y", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def chart_for(kind_x: str, kind_y: str | None = None) -> str:
    """Chart kind for one logical type or a pair of them."""
    def family(kind):
        if kind in catalog.NUMERIC:
            return "number"
        return "time" if kind == "datetime-like" else "category" if kind in catalog.CATEGORY_LIKE else "none"

    if kind_y is None:
        return "histogram" if family(kind_x) in ("number", "time") else "bar"
    rules = {
        ("number", "number"): "scatter",
        ("number", "time"): "line",
        ("category", "number"): "box",
        ("category", "category"): "heatmap",
    }
    found = rules.get(tuple(sorted((family(kind_x), family(kind_y)))))
    if found is None:
        raise UnsupportedChartError(f"no chart for a pair of {kind_x} and {kind_y} columns")
    return found


def recommend_charts(summary: DataFrame) -> DataFrame:
    """Chart kind for every column and every column pair of a catalogue; `unsupported` where none fits."""
    kind = F.col("inferred_dtype")
    family = (
        F.when(kind.isin(*catalog.NUMERIC), "number")
        .when(kind == "datetime-like", "time")
        .when(kind.isin(*catalog.CATEGORY_LIKE), "category")
        .otherwise("none")
    )
    columns = summary.select("position", "column", family.alias("family"))
    # One row per column of the table: the catalogue, not the data, is paired with itself.
    listed = columns.agg(F.array_sort(F.collect_list(F.struct("position", "column", "family"))).alias("all"))
    paired = listed.select(F.explode("all").alias("x"), "all").select("x", F.explode(F.col("all")).alias("y"))
    pair = F.concat_ws("+", F.least("x.family", "y.family"), F.greatest("x.family", "y.family"))
    single = F.when(F.col("x.family").isin("number", "time"), "histogram").otherwise("bar")
    both = (
        F.when(pair == "number+number", "scatter")
        .when(pair == "number+time", "line")
        .when(pair == "category+number", "box")
        .when(pair == "category+category", "heatmap")
        .otherwise("unsupported")
    )
    alone = F.col("x.position") == F.col("y.position")
    return paired.filter(F.col("x.position") <= F.col("y.position")).select(
        F.col("x.column").alias("x"),
        F.when(~alone, F.col("y.column")).alias("y"),
        F.when(alone, single).otherwise(both).alias("chart"),
    )


def chart_data(
    df: DataFrame, x: str, y: str | None, keys: list[str], types: dict[str, str] | None = None,
    settings: Settings = DEFAULTS,
) -> tuple[str, DataFrame]:
    """Pick the chart for one column or a pair and return its name and its rows."""
    catalog.require_columns(df, x, *([y] if y else []))
    types = catalog.column_types(df.select(x, *([y] if y and y != x else [])), settings) if types is None else types
    kind = chart_for(types[x], types[y] if y else None)
    if y is None:
        if types[x] == "datetime-like":
            return kind, records_over_time(df, x)
        return kind, histogram(df, x, settings=settings) if kind == "histogram" else category_bars(df, x, settings=settings)
    if kind == "scatter":
        return kind, scatter_sample(df, x, y, keys, settings=settings)
    if kind == "line":
        t, v = (x, y) if types[x] == "datetime-like" else (y, x)
        return kind, time_series(df, t, v, keys, settings=settings)
    if kind == "box":
        c, v = (x, y) if types[y] in catalog.NUMERIC else (y, x)
        return kind, grouped_box(df, c, v, settings=settings)
    return kind, contingency(df, x, y, settings=settings)

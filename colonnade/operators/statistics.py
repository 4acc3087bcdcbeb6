"""Numeric, categorical, missing-value, temporal and outlier profiles in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.functions import cells
from colonnade.functions.quantiles import column_quantiles
from colonnade.functions.storage import stored
from colonnade.operators import catalog
from colonnade.settings import DEFAULTS, Settings


def unbiased_skewness(g1: Column, n: Column) -> Column:
    """Sample skewness from the population form."""
    n = n.cast("double")
    return g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))


def unbiased_kurtosis(g2: Column, n: Column) -> Column:
    """Sample excess kurtosis from the population form; the population form itself for n = 3."""
    n = n.cast("double")
    spread = F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n > 3, (n - 1) / spread * ((n + 1) * g2 + 6)).otherwise(g2)


def _numeric(df: DataFrame, columns: list[str] | None, settings: Settings) -> list[str]:
    if columns is None:
        return catalog.columns_of(catalog.column_types(df, settings), *catalog.NUMERIC)
    catalog.require_columns(df, *columns)
    return columns


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


NUMERIC_SCHEMA = (
    "`column` string, `count` long, valid_count long, missing_count long, missing_percentage double, mean double, "
    "median double, std double, min double, max double, q1 double, q3 double, iqr double, "
    "skewness double, kurtosis double"
)


def column_ranges(df: DataFrame, columns: list[str], settings: Settings = DEFAULTS) -> dict[str, dict]:
    """Row total, valid count, mean and range per column on the driver: the first pass of most numeric operators."""
    out: dict[str, dict] = {}
    for k in range(0, len(columns), settings.columns_per_aggregate):
        chunk = columns[k:k + settings.columns_per_aggregate]
        aggs = {"total": "count(1)"}
        for i in range(len(chunk)):
            aggs |= {f"n_{i}": f"count(v_{i})", f"mean_{i}": f"avg(v_{i})", f"min_{i}": f"min(v_{i})", f"max_{i}": f"max(v_{i})"}
        row = cells.aggregate(cells.numbers(df, chunk), aggs).first()
        for i, c in enumerate(chunk):
            out[c] = {"total": row["total"], **{fact: row[f"{fact}_{i}"] for fact in ("n", "mean", "min", "max")}}
    return out


def numeric_profile(
    df: DataFrame, columns: list[str] | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """One row per numeric column; infinities and unreadable cells count as missing.

    First pass: count, mean and range. Second: exact quantiles. Third: sums of powers of the
    deviations from the mean, which give spread and shape without cancellation.
    """
    columns = _numeric(df, columns, settings)
    if not columns:
        return _empty(df, NUMERIC_SCHEMA)
    narrow = df.select(*[cells.quoted(c) for c in columns])
    ranges = column_ranges(narrow, columns, settings)
    quarts = quantiles_of(narrow, columns, ranges, [0.25, 0.5, 0.75], settings)
    parts = []
    for k in range(0, len(columns), settings.columns_per_aggregate):
        chunk = columns[k:k + settings.columns_per_aggregate]
        aggs, structs = {}, []
        for i, c in enumerate(chunk):
            d = f"(v_{i} - {cells.sql_double(ranges[c]['mean'] or 0.0)})"
            aggs |= {f"p{power}_{i}": f"sum({' * '.join([d] * power)})" for power in (2, 3, 4)}
            q1, q2, q3 = map(cells.sql_double, quarts[c])
            structs.append({
                "column": cells.sql_text(c), "total": f"{ranges[c]['total']}L", "n": f"{ranges[c]['n']}L",
                **{fact: cells.sql_double(ranges[c][fact]) for fact in ("mean", "min", "max")},
                "q1": q1, "q2": q2, "q3": q3, **{f"p{power}": f"p{power}_{i}" for power in (2, 3, 4)},
            })
        parts.append(cells.inline_rows(cells.aggregate(cells.numbers(narrow, chunk), aggs), structs))
    n, flat = F.col("n"), F.col("min") == F.col("max")
    variance = F.when(flat, 0.0).otherwise(F.col("p2") / F.nullif(n, F.lit(0)))
    facts = _union(parts).withColumns({
        "variance": variance,
        "std": F.when((n == 1) | (flat & (n > 0)), 0.0).otherwise(F.sqrt(F.col("p2") / F.nullif(n - 1, F.lit(0)))),
    })
    shaped = (n >= 3) & (F.col("std") > 1e-9)
    g1 = F.col("p3") / n / F.pow(F.nullif("variance", F.lit(0.0)), F.lit(1.5))
    g2 = F.col("p4") / n / F.pow(F.nullif("variance", F.lit(0.0)), F.lit(2.0)) - 3.0
    return facts.select(
        "column",
        F.col("total").alias("count"),
        n.alias("valid_count"),
        (F.col("total") - n).alias("missing_count"),
        cells.percent(F.col("total") - n, F.col("total")).alias("missing_percentage"),
        cells.rounded(F.col("mean")).alias("mean"),
        cells.rounded(F.col("q2")).alias("median"),
        cells.rounded(F.col("std")).alias("std"),
        cells.rounded(F.col("min")).alias("min"),
        cells.rounded(F.col("max")).alias("max"),
        cells.rounded(F.col("q1")).alias("q1"),
        cells.rounded(F.col("q3")).alias("q3"),
        cells.rounded(F.col("q3") - F.col("q1")).alias("iqr"),
        cells.rounded(F.when(shaped, unbiased_skewness(g1, n))).alias("skewness"),
        cells.rounded(F.when(shaped, unbiased_kurtosis(g2, n))).alias("kurtosis"),
    )


def quantiles_of(
    df: DataFrame, columns: list[str], ranges: dict[str, dict], probs: list[float], settings: Settings = DEFAULTS
) -> dict[str, list[float | None]]:
    """Exact quantiles per column, given the counts and ranges of the first pass."""
    out: dict[str, list[float | None]] = {}
    for k in range(0, len(columns), settings.columns_per_aggregate):
        chunk = columns[k:k + settings.columns_per_aggregate]
        names = [f"v_{i}" for i in range(len(chunk))]
        heads = {f"v_{i}": (ranges[c]["n"], ranges[c]["min"], ranges[c]["max"]) for i, c in enumerate(chunk)}
        rows = max(r["total"] for r in ranges.values())
        found = column_quantiles(cells.numbers(df, chunk), names, probs, settings, rows, heads)
        out |= {c: found[f"v_{i}"] for i, c in enumerate(chunk)}
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


HEAD = 64  # leading characters of a text that are counted as they are; the rest of a longer one goes as a digest


def _category_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """`(column, value)`: every present cell of the columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), cells.category(df, c).alias("value")) for c in columns])
    return df.select(F.inline(pairs)).filter(F.col("value").isNotNull())


def _counted(long: DataFrame, begin: int, size: int) -> DataFrame:
    """`(column, head, digest, n)`: `size` characters from `begin` on, and a digest of texts that are longer."""
    digest = F.when(F.char_length("value") >= begin + size, F.md5("value"))
    narrow = long.select("column", F.substring("value", begin, size).alias("head"), digest.alias("digest"))
    return narrow.groupBy("column", "head", "digest").agg(F.count("*").alias("n"))


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """`(column, head, digest, n)`, a row per distinct value: the one shuffle behind every categorical result, stored.

    Counting is pre-aggregated before the exchange, so a value that fills a third of the table costs one row per map
    task, and a long text crosses as its first characters and a digest. Short texts have no digest.
    """
    return stored(_counted(_category_cells(df, columns), 1, HEAD), "categories")


def top_values(df: DataFrame, columns: list[str], top: int, counts: DataFrame | None = None) -> DataFrame:
    """`(column, value, n, rank)`: the most frequent values per column, ties by value.

    The heads decide nearly all ranks. Where values of one count and one head lie on both sides of the last rank, only
    those are counted again by a stretch of text twice as long, until none do. Full texts cross the network for the
    values of the list alone, whose size bounds everything that is collected or broadcast here.
    """
    spark = df.sparkSession
    long = _category_cells(df, columns)
    counts = category_counts(df, columns) if counts is None else counts
    places = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("head"), F.asc_nulls_first("digest"))
    picks: list[tuple] = []  # column, value or None, digest or None, n
    prefix, wanted, size = dict.fromkeys(columns, ""), dict.fromkeys(columns, top), HEAD
    while wanted:
        leading = counts.withColumn("place", F.row_number().over(places)).filter(F.col("place") <= top + 1)
        groups: dict[str, list] = {c: [] for c in wanted}
        for r in leading.orderBy("column", "place").collect():
            groups[r["column"]].append(r)
        tied = {}
        for c, rows in groups.items():
            taken, beyond = rows[:wanted[c]], rows[wanted[c]:wanted[c] + 1]
            if taken and beyond and taken[-1]["digest"] and [beyond[0][k] for k in ("n", "head")] == [taken[-1][k] for k in ("n", "head")]:
                tied[c] = taken[-1]
                taken = [r for r in taken if r["digest"] is None or (r["n"], r["head"]) != (tied[c]["n"], tied[c]["head"])]
            picks += [(c, None if r["digest"] else prefix[c] + r["head"], r["digest"], r["n"]) for r in taken]
            wanted[c] -= len(taken)
        wanted = {c: wanted[c] for c in tied}
        if tied:
            prefix |= {c: prefix[c] + r["head"] for c, r in tied.items()}
            begin = len(next(iter(prefix[c] for c in tied))) + 1
            among = [(F.col("column") == c) & F.startswith("value", F.lit(prefix[c])) & (F.char_length("value") >= begin) for c in tied]
            even = [(F.col("column") == c) & (F.col("n") == r["n"]) for c, r in tied.items()]
            counts = _counted(long.filter(reduce(Column.__or__, among)), begin, size).filter(reduce(Column.__or__, even))
            size *= 2
    schema = "column string, value string, digest string, n long"
    out = spark.createDataFrame([p for p in picks if not p[2]], schema).select("column", "value", "n")
    if any(p[2] for p in picks):
        listed = spark.createDataFrame([p for p in picks if p[2]], schema).select("column", "digest", "n")
        texts = long.filter(F.char_length("value") > HEAD).withColumn("digest", F.md5("value"))
        found = texts.join(F.broadcast(listed), ["column", "digest"]).groupBy("column", "digest", "n").agg(F.first("value").alias("value"))
        out = out.unionByName(found.select("column", "value", "n"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value")))
    return out.withColumn("rank", rank)


def _categorical(df: DataFrame, columns: list[str] | None, settings: Settings) -> list[str]:
    if columns is None:
        return catalog.columns_of(catalog.column_types(df, settings), *catalog.CATEGORY_LIKE)
    catalog.require_columns(df, *columns)
    return columns


def row_totals(df: DataFrame, columns: list[str]) -> DataFrame:
    """`(column, count)`: the table's row count repeated per column."""
    names = F.array(*map(F.lit, columns))
    return df.agg(F.count(F.lit(1)).alias("count")).select(F.explode(names).alias("column"), "count")


def categorical_profile(
    df: DataFrame, columns: list[str] | None = None, top: int | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """One row per categorical column: validity, distinct values, mode, what the top list leaves out."""
    columns = _categorical(df, columns, settings)
    top = settings.top_categories if top is None else top
    counts = category_counts(df, columns)
    totals = counts.groupBy("column").agg(F.sum("n").alias("valid_count"), F.count("*").alias("unique_values"))
    best = top_values(df, columns, top, counts).groupBy("column").agg(
        F.min_by("value", "rank").alias("mode"), F.max("n").alias("mode_count"), F.sum("n").alias("top_count")
    )
    joined = row_totals(df, columns).join(totals, "column", "left").join(best, "column", "left")
    filled = joined.fillna(0, ["valid_count", "unique_values", "mode_count", "top_count"])
    return filled.select(
        "column", "count", "valid_count",
        (F.col("count") - F.col("valid_count")).alias("missing_count"),
        cells.percent(F.col("count") - F.col("valid_count"), F.col("count")).alias("missing_percentage"),
        "unique_values", "mode", "mode_count",
        cells.percent(F.col("mode_count"), F.col("count")).alias("mode_percentage"),
        (F.col("valid_count") - F.col("top_count")).alias("other_count"),
        cells.percent(F.col("valid_count") - F.col("top_count"), F.col("count")).alias("other_percentage"),
    )


def top_categories(
    df: DataFrame, columns: list[str] | None = None, top: int | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """The frequency table behind the profile: (column, rank, category, n, percentage of all rows)."""
    columns = _categorical(df, columns, settings)
    top = settings.top_categories if top is None else top
    ranked = top_values(df, columns, top)
    return ranked.join(row_totals(df, columns), "column").select(
        "column",
        F.col("rank").cast("long").alias("rank"),
        F.col("value").alias("category"),
        "n",
        cells.percent(F.col("n"), F.col("count")).alias("percentage"),
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """Missing and present cells per column, most missing first. One map-side aggregate."""
    one = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(cells.is_missing(df, c)).alias(f"m_{i}") for i, c in enumerate(df.columns)],
    )
    long = cells.inline_rows(one, [
        {"position": f"{i}L", "column": cells.sql_text(c), "row_count": "total", "missing_count": f"m_{i}"}
        for i, c in enumerate(df.columns)
    ])
    share = cells.percent(F.col("missing_count"), F.col("row_count"))
    return long.select(
        "*", share.alias("missing_percentage"),
        (F.col("row_count") - F.col("missing_count")).alias("present_count"),
        F.round(100.0 - share, 2).alias("present_percentage"),
    ).orderBy(F.desc("missing_count"), "position")


def missing_totals(by_column: DataFrame) -> DataFrame:
    """One row over the whole table: missing cells, share, columns with any, severe columns."""
    cells_total = F.greatest(F.sum("row_count"), F.lit(1))
    return by_column.agg(
        cells_total.alias("total_cells"),
        F.sum("missing_count").alias("total_missing_cells"),
        cells.percent(F.sum("missing_count"), cells_total).alias("missing_percentage"),
        F.count_if(F.col("missing_count") > 0).alias("columns_with_missing_count"),
        catalog.name_list(F.col("missing_count") > 0).alias("columns_with_missing"),
        catalog.name_list(F.col("missing_percentage") >= 50.0).alias("severe_missing_columns"),
    )


def temporal_profile(df: DataFrame, columns: list[str] | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """First and last moment and the span in days per datetime-like column."""
    if columns is None:
        columns = catalog.columns_of(catalog.column_types(df, settings), "datetime-like")
    catalog.require_columns(df, *columns)
    if not columns:
        return _empty(df, "`column` string, total_count long, valid_dates_count long, missing_count long, "
                          "min_date timestamp_ntz, max_date timestamp_ntz, date_range_days double")
    aggs, lead = [], cells.date_orders(df, columns)
    for i, c in enumerate(columns):
        t = cells.time(df, c, lead[c])
        aggs += [F.count(t).alias(f"n_{i}"), F.min(t).alias(f"lo_{i}"), F.max(t).alias(f"hi_{i}")]
    one = df.agg(F.count(F.lit(1)).alias("total"), *aggs)
    long = cells.inline_rows(one, [
        {"column": cells.sql_text(c), "total_count": "total", "valid_dates_count": f"n_{i}",
         "min_date": f"lo_{i}", "max_date": f"hi_{i}"}
        for i, c in enumerate(columns)
    ])
    return long.filter("valid_dates_count > 0").select(
        "column", "total_count", "valid_dates_count",
        (F.col("total_count") - F.col("valid_dates_count")).alias("missing_count"),
        "min_date", "max_date",
        F.round(F.timestamp_diff("MICROSECOND", F.col("min_date"), F.col("max_date")) / 86400e6, 2)
        .alias("date_range_days"),
    )


def fences(n: int, q1: float | None, q3: float | None, multiplier: float):
    """Lower and upper fence; None for fewer than four values."""
    if n < 4 or q1 is None or q3 is None:
        return None
    reach = multiplier * (q3 - q1)
    return q1 - reach, q3 + reach


OUTLIER_SCHEMA = (
    "`column` string, q1 double, q3 double, iqr double, lower_bound double, upper_bound double, "
    "outliers_count long, outliers_percentage double, lower_count long, upper_count long, min_val double, "
    "max_val double, has_outliers boolean"
)


def outliers(
    df: DataFrame,
    columns: list[str] | None = None,
    multiplier: float | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Interquartile fences per numeric column and how many values fall outside them."""
    columns = _numeric(df, columns, settings)
    if not columns:
        return _empty(df, OUTLIER_SCHEMA)
    multiplier = settings.iqr_multiplier if multiplier is None else multiplier
    narrow = df.select(*[cells.quoted(c) for c in columns])
    ranges = column_ranges(narrow, columns, settings)
    quarts = quantiles_of(narrow, columns, ranges, [0.25, 0.75], settings)
    parts = []
    for k in range(0, len(columns), settings.columns_per_aggregate):
        aggs, structs = {}, []
        chunk = columns[k:k + settings.columns_per_aggregate]
        for i, c in enumerate(chunk):
            r, (q1, q3) = ranges[c], quarts[c]
            bounds = fences(r["n"], q1, q3, multiplier)
            known = bounds is not None  # too few values: no quartiles, no range
            lo, hi = map(cells.sql_double, bounds or (None, None))
            aggs |= {f"low_{i}": f"count_if(v_{i} < {lo})", f"high_{i}": f"count_if(v_{i} > {hi})"}
            structs.append({
                "column": cells.sql_text(c), "q1": cells.sql_double(q1 if known else None),
                "q3": cells.sql_double(q3 if known else None), "lo": lo, "hi": hi, "n": f"{r['n']}L",
                "min": cells.sql_double(r["min"] if known else None), "max": cells.sql_double(r["max"] if known else None),
                "low": f"low_{i}", "high": f"high_{i}",
            })
        parts.append(cells.inline_rows(cells.aggregate(cells.numbers(narrow, chunk), aggs), structs))
    both = F.col("low") + F.col("high")
    return _union(parts).select(
        "column",
        cells.rounded(F.col("q1")).alias("q1"),
        cells.rounded(F.col("q3")).alias("q3"),
        cells.rounded(F.col("q3") - F.col("q1")).alias("iqr"),
        cells.rounded(F.col("lo")).alias("lower_bound"),
        cells.rounded(F.col("hi")).alias("upper_bound"),
        both.alias("outliers_count"),
        cells.percent(both, F.col("n")).alias("outliers_percentage"),
        F.col("low").alias("lower_count"),
        F.col("high").alias("upper_count"),
        cells.rounded(F.col("min")).alias("min_val"),
        cells.rounded(F.col("max")).alias("max_val"),
        (both > 0).alias("has_outliers"),
    )

"""Column catalogue: logical types, summaries, duplicate rows, dataset overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.functions import cells
from colonnade.settings import DEFAULTS, Settings

NUMERIC = ("integer", "float")
CATEGORY_LIKE = ("categorical", "boolean", "text")

# Texts read as booleans.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "t", "f", "1", "0")


class UnknownColumnError(ValueError):
    pass


def require_columns(df: DataFrame, *names: str) -> None:
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise UnknownColumnError(f"unknown column(s) {unknown}; available: {df.columns}")


def profiled_columns(df: DataFrame) -> list[str]:
    """Columns with a scalar type; arrays, maps, structs and binaries have no profile."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, cells.PROFILED_TYPES)]


def _fact_inputs(df: DataFrame, names: list[str]) -> DataFrame:
    """Cells as the facts need them, computed once per row: r_i raw, s_i stripped text, m_i missing."""
    columns = []
    for i, c in enumerate(names):
        dtype = cells.type_of(df, c)
        columns += [
            cells.without_nan(cells.quoted(c), dtype).alias(f"r_{i}"), cells.is_missing(df, c).alias(f"m_{i}")
        ]
        if isinstance(dtype, T.StringType):
            columns.append(cells.stripped(cells.quoted(c)).alias(f"s_{i}"))
    return df.select(*columns)


def _fact_aggregates(df: DataFrame, name: str, i: int) -> dict[str, str | Column]:
    dtype = cells.type_of(df, name)
    r, s = f"r_{i}", f"s_{i}"
    aggs: dict[str, str | Column] = {f"missing_{i}": f"count_if(m_{i})"}
    if isinstance(dtype, cells.INTEGER_TYPES):
        aggs |= {f"min_{i}": f"min({r})", f"max_{i}": f"max({r})"}
    elif isinstance(dtype, cells.FRACTION_TYPES):
        v = f"CAST({r} AS DOUBLE)"
        aggs |= {f"max_{i}": f"max({v})", f"whole_{i}": f"bool_and({v} = rint({v}))"}
    elif isinstance(dtype, T.StringType):
        n = cells.text_as_double(s)
        present = f"FILTER (WHERE {s} IS NOT NULL)"
        words = ", ".join(map(cells.sql_text, BOOLEAN_WORDS))
        aggs |= {
            f"flags_{i}": f"bool_and(length({s}) <= 5 AND lower({s}) IN ({words}))",
            f"dated_{i}": f"count_if(contains({s}, '-') OR contains({s}, '/') OR contains({s}, ':'))",
            f"times_{i}": F.bool_and(F.when(F.col(s).isNotNull(), cells.text_as_time(s).isNotNull()))
            | F.bool_and(F.when(F.col(s).isNotNull(), cells.text_as_time(s, True).isNotNull())),
            f"numbers_{i}": f"bool_and({n} IS NOT NULL) {present}",
            f"whole_{i}": f"bool_and({n} = rint({n}))",
            f"length_{i}": f"avg(length({s}))",
        }
    return aggs


def _facts(df: DataFrame, names: list[str]) -> DataFrame:
    """One row: the row count `n` and every fact of every named column."""
    aggs: dict[str, str | Column] = {"n": "count(1)"}
    for i, c in enumerate(names):
        aggs |= _fact_aggregates(df, c, i)
    return _fact_inputs(df, names).agg(
        *[(F.expr(v) if isinstance(v, str) else v).alias(k) for k, v in aggs.items()]
    )


def _logical_type(df: DataFrame, name: str, i: int) -> str:
    """Logical type from the aggregated facts, as SQL text; long distinct text still counts as categorical."""
    dtype = cells.type_of(df, name)
    if isinstance(dtype, T.BooleanType):
        return "'boolean'"
    if isinstance(dtype, cells.TIME_TYPES):
        return "'datetime-like'"
    if isinstance(dtype, cells.INTEGER_TYPES):
        return f"CASE WHEN min_{i} >= 0 AND max_{i} <= 1 THEN 'boolean' ELSE 'integer' END"
    if isinstance(dtype, cells.FRACTION_TYPES):
        return f"CASE WHEN whole_{i} AND max_{i} < 1e12D THEN 'integer' ELSE 'float' END"
    return f"""CASE WHEN n = missing_{i} THEN 'mixed' WHEN flags_{i} THEN 'boolean'
        WHEN dated_{i} >= (n - missing_{i}) * 0.8D AND times_{i} THEN 'datetime-like'
        WHEN numbers_{i} THEN CASE WHEN whole_{i} THEN 'integer' ELSE 'float' END ELSE 'categorical' END"""


def _is_long(df: DataFrame, name: str, i: int) -> str:
    return f"coalesce(length_{i} > 60, false)" if isinstance(cells.type_of(df, name), T.StringType) else "false"


def _chunks(names: list[str], size: int) -> list[list[str]]:
    return [names[k:k + size] for k in range(0, len(names), size)]


def column_types(df: DataFrame, settings: Settings = DEFAULTS) -> dict[str, str]:
    """Logical type per column, read on the driver to plan later operators.

    One aggregate per chunk of columns. Distinct counts shuffle, so they are taken only
    for long strings, where they separate text from categories.
    """
    out: dict[str, str] = {}
    unsure: list[str] = []
    names = profiled_columns(df)
    for chunk in _chunks(names, settings.columns_per_aggregate):
        facts = _facts(df, chunk).select(
            *[F.expr(f"{_logical_type(df, c, i)} AS k_{i}") for i, c in enumerate(chunk)],
            *[F.expr(f"{_is_long(df, c, i)} AS long_{i}") for i, c in enumerate(chunk)],
        ).first()
        for i, c in enumerate(chunk):
            out[c] = facts[f"k_{i}"]
            if facts[f"long_{i}"] and out[c] == "categorical":
                unsure.append(c)
    if unsure:
        rows = df.count()
        for r in distinct_counts(df, unsure).collect():
            if r["unique_count"] / max(rows, 1) > 0.70:
                out[unsure[r["position"]]] = "text"
    return out


def distinct_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(position, unique_count) of the named columns, by position in the list; absent where nothing is present.

    All columns go through one shuffle of narrow (column, value) rows, combined per map task;
    a value that fills a third of a column is one row per task.
    """
    structs = []
    for i, c in enumerate(names):
        dtype = cells.type_of(df, c)
        v = cells.distinct_key(cells.quoted(c), dtype)
        whole, fraction, text = (F.lit(None).cast(t) for t in ("bigint", "double", "string"))
        if isinstance(dtype, cells.INTEGER_TYPES + (T.BooleanType,)):
            whole = v.cast("bigint")
        elif isinstance(dtype, cells.TIME_TYPES):
            epoch = F.lit("1970-01-01").cast("timestamp_ntz")
            whole = F.timestamp_diff("MICROSECOND", epoch, v.cast("timestamp_ntz"))
        elif cells.is_floating(dtype):
            fraction = v.cast("double")
        else:
            text = v.cast("string")
        structs.append(F.struct(F.lit(i).cast("long").alias("position"), whole.alias("w"), fraction.alias("f"), text.alias("t")))
    long = df.select(F.inline(F.array(*structs))).filter("w IS NOT NULL OR f IS NOT NULL OR t IS NOT NULL")
    once = long.groupBy("position", "w", "f", "t").agg(F.lit(1).alias("one"))
    return once.groupBy("position").agg(F.count("*").alias("unique_count"))


def columns_of(types: dict[str, str], *kinds: str) -> list[str]:
    return [c for c, k in types.items() if k in kinds]


def column_summary(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per column: types, missing and distinct facts, constant and high-cardinality flags."""
    names = profiled_columns(df)
    place = {c: k for k, c in enumerate(names)}
    parts = []
    for chunk in _chunks(names, settings.columns_per_aggregate):
        facts = _facts(df, chunk)
        parts.append(cells.inline_rows(facts, [
            {
                "position": f"{place[c]}L", "column": cells.sql_text(c),
                "raw_dtype": cells.sql_text(cells.type_of(df, c).simpleString()), "kind": _logical_type(df, c, i),
                "long": _is_long(df, c, i), "row_count": "n", "missing_count": f"missing_{i}",
            }
            for i, c in enumerate(chunk)
        ]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # One row per column of the table on either side.
    out = out.join(F.broadcast(distinct_counts(df, names)), "position", "left")
    unique = F.coalesce("unique_count", F.lit(0)).cast("long")
    varied = unique / F.greatest(F.col("row_count"), F.lit(1)) > 0.70
    kind = F.when((F.col("kind") == "categorical") & F.col("long") & varied, "text").otherwise(F.col("kind"))
    out = out.select(
        "position", "column", "raw_dtype", kind.alias("inferred_dtype"), "row_count", "missing_count",
        unique.alias("unique_count"),
    )
    share = F.col("unique_count") / F.greatest(F.col("row_count"), F.lit(1))
    return out.select(
        "*",
        cells.percent(F.col("missing_count"), F.col("row_count")).alias("missing_percentage"),
        cells.percent(F.col("unique_count"), F.col("row_count")).alias("unique_percentage"),
        (F.col("unique_count") <= settings.constant_max_distinct).alias("is_constant"),
        (
            (F.col("unique_count") > settings.high_cardinality_min)
            & (share >= settings.high_cardinality_ratio)
        ).alias("is_high_cardinality"),
    )


def sample_values(df: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """Up to n present example values per column, as text, the first ones in key order.

    One bounded top-n per column, which reads that column and the keys and sorts nothing else.
    """
    from pyspark.sql import Window

    key = F.struct(*[cells.quoted(k) for k in keys]).alias("key")
    out = None
    for c in profiled_columns(df):
        value = cells.without_nan(cells.quoted(c), cells.type_of(df, c)).cast("string").alias("value")
        first = df.select(F.lit(c).alias("column"), key, value).filter(F.col("value").isNotNull()).orderBy("key").limit(n)
        out = first if out is None else out.unionByName(first)
    return out.select("column", F.row_number().over(Window.partitionBy("column").orderBy("key")).alias("rank"), "value")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical group, and their share. Rows cross the network as digests."""
    named = []
    for c in df.columns:
        dtype = cells.type_of(df, c)
        value = cells.without_nan(cells.quoted(c), dtype)
        named.append(value + F.lit(0.0).cast(dtype) if cells.is_floating(dtype) else value)
    groups = df.select(F.md5(cells.row_text(named)).alias("row")).groupBy("row").agg(F.count("*").alias("n"))
    counted = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )
    return counted.withColumn(
        "duplicate_percentage", cells.percent(F.col("duplicate_rows"), F.col("row_count"))
    )


def constant_columns(summary: DataFrame) -> DataFrame:
    return summary.filter("is_constant").select("position", "column", "unique_count")


def high_cardinality_columns(summary: DataFrame) -> DataFrame:
    return summary.filter("is_high_cardinality").select(
        "position", "column", "inferred_dtype", "unique_count", "unique_percentage"
    )


def name_list(keep: Column) -> Column:
    """Sorted-by-position column names where `keep` holds, as an aggregate."""
    kept = F.collect_list(F.when(keep, F.struct("position", "column")))
    return F.transform(F.array_sort(kept), lambda x: x["column"])


def one_row(*frames: DataFrame) -> DataFrame:
    """Side by side, tables that have exactly one row each."""
    merged = frames[0]
    for f in frames[1:]:
        merged = merged.unionByName(f, allowMissingColumns=True)
    return merged.agg(*[F.max(cells.quoted(c)).alias(c) for c in merged.columns])


def dataset_overview(summary: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row: sizes, columns by class, missing cells, duplicates, flagged columns."""
    kind = F.col("inferred_dtype")
    classes = {
        "numeric": kind.isin("integer", "float"),
        "categorical": kind.isin("categorical", "mixed"),
        "boolean": kind == "boolean",
        "datetime": kind == "datetime-like",
        "text": kind == "text",
    }
    shape = summary.agg(
        F.max("row_count").alias("rows"),
        F.count("*").alias("columns"),
        *[F.count_if(test).alias(f"{k}_columns") for k, test in classes.items()],
        F.sum("missing_count").alias("missing_cells"),
        *[name_list(test).alias(f"{k}_names") for k, test in classes.items()],
        name_list(F.col("is_constant")).alias("constant_names"),
        name_list(F.col("is_high_cardinality")).alias("high_cardinality_names"),
    ).withColumn(
        "missing_percentage",
        cells.percent(F.col("missing_cells"), F.col("rows") * F.col("columns")),
    )
    return one_row(shape, duplicates.select("duplicate_rows", "duplicate_percentage"))

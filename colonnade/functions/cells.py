"""Cell-level expressions shared by every operator. All are built-in Spark functions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTION_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)
TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
PROFILED_TYPES = INTEGER_TYPES + FRACTION_TYPES + TIME_TYPES + (T.StringType, T.BooleanType)

# Characters removed by a whitespace strip.
WHITESPACE = " \t\n\r\x0b\x0c"

# Fixed value: the shape of a decimal number in text; a letter after it, as in `12d`, makes it a code.
NUMBER_SHAPE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

# Shapes of date text and the layouts tried for each, month first as in US text.
ISO_SHAPE = "^[0-9]{4}(-[0-9]{1,2}){0,2}([ T].*)?$"
TIME_LAYOUTS = {
    "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}( .*)?$": ["M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss"],
    "^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}( .*)?$": ["yyyy/M/d", "yyyy/M/d H:mm:ss"],
    "^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}$": ["d-MMM-yyyy"],
    "^[A-Za-z]{3,9} [0-9]{1,2}, [0-9]{4}$": ["MMM d, yyyy", "MMMM d, yyyy"],
}


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def quoted(name: str) -> Column:
    """Column by exact name, dots included."""
    return F.col(sql_name(name))


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def finite(c: Column) -> Column:
    """Double with NaN and both infinities turned into null."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def as_number(c: Column, dtype: T.DataType) -> Column:
    """Double value of a cell; text that is no number, NaN and infinities become null."""
    if isinstance(dtype, TIME_TYPES):
        return F.lit(None).cast("double")
    if isinstance(dtype, INTEGER_TYPES + (T.BooleanType, T.DecimalType)):
        return c.cast("double")
    if isinstance(dtype, T.StringType):
        s = stripped(c)
        return finite(F.when(s.rlike(NUMBER_SHAPE), s.try_cast("double")))
    return finite(c.cast("double"))


def text_as_double(s: str) -> str:
    """SQL text for the double in a column of stripped text, infinities and NaN included, else null."""
    return (f"CASE WHEN {s} RLIKE {sql_text(NUMBER_SHAPE)} OR lower({s}) RLIKE '^([+-]?inf(inity)?|nan)$'"
            f" THEN try_cast({s} AS DOUBLE) END")


def number(df: DataFrame, name: str) -> Column:
    return as_number(quoted(name), type_of(df, name))


def without_nan(c: Column, dtype: T.DataType) -> Column:
    """The cell itself, with NaN as null; infinities stay."""
    if is_floating(dtype):
        return F.when(F.isnan(c), None).otherwise(c)
    return c


def is_missing(df: DataFrame, name: str) -> Column:
    """Null or NaN; an infinity is a present value."""
    c = quoted(name)
    return (c.isNull() | F.isnan(c)) if is_floating(type_of(df, name)) else c.isNull()


def stripped(c: Column) -> Column:
    return F.trim(c.cast("string"), F.lit(WHITESPACE))


def category(df: DataFrame, name: str) -> Column:
    """Cell as stripped text; missing stays null."""
    return stripped(without_nan(quoted(name), type_of(df, name)))


def rounded(c: Column, places: int = 4) -> Column:
    return F.round(finite(c.cast("double")), places)


def percent(n: Column, d: Column, places: int = 2) -> Column:
    """n as a share of d in percent; a zero denominator counts as one."""
    return F.round(n.cast("double") / F.greatest(d, F.lit(1)).cast("double") * F.lit(100.0), places)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def date_orders(df: DataFrame, names: list[str]) -> dict[str, bool]:
    """Which text columns write `day/month/year`: more cells are readable only so than only month first.

    Decided over all rows, so that one column is never read in two ways; one aggregate for all columns. Native columns
    need no look.
    """
    texts = [c for c in names if isinstance(type_of(df, c), T.StringType)]
    shape, aggs = r"^([0-9]{1,2})/([0-9]{1,2})/[0-9]{4}( .*)?$", []
    for i, c in enumerate(texts):
        first, second = (F.regexp_extract(stripped(quoted(c)), shape, k).try_cast("int") for k in (1, 2))
        aggs += [F.count_if((first > 12) & (second <= 12)).alias(f"day_{i}"), F.count_if((second > 12) & (first <= 12)).alias(f"month_{i}")]
    seen = df.agg(*aggs).first() if texts else {}
    return {**dict.fromkeys(names, False), **{c: seen[f"day_{i}"] > seen[f"month_{i}"] for i, c in enumerate(texts)}}


def day_first(df: DataFrame, name: str) -> bool:
    """Whether one column leads with the day (see `date_orders`)."""
    return date_orders(df, [name])[name]


def time(df: DataFrame, name: str, days_lead: bool | None = None) -> Column:
    """Timestamp without time zone; unreadable text becomes null. days_lead: the column's `day_first`, if it is known."""
    dtype = type_of(df, name)
    if isinstance(dtype, TIME_TYPES):
        return quoted(name).cast("timestamp_ntz")
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("timestamp_ntz")
    blanks = sql_text(WHITESPACE)
    return text_as_time(f"trim(BOTH {blanks} FROM {sql_name(name)})", day_first(df, name) if days_lead is None else days_lead)


def text_as_time(s: str, days_lead: bool = False) -> Column:
    """Timestamp from a column of stripped text, by the first layout that fits; slashed dates lead with the day or the month.

    Text is offered only to the layouts of its shape; every layout has a four-digit year. Wide plans are written as SQL text: one
    call to the JVM per expression instead of one per operator.
    """
    cases = [f"WHEN {s} RLIKE {sql_text(ISO_SHAPE)} THEN try_cast({s} AS timestamp_ntz)"]
    for shape, layouts in TIME_LAYOUTS.items():
        layouts = [p.replace("M/d/yyyy", "d/M/yyyy") if days_lead and p.startswith("M/d/") else p for p in layouts]
        tries = ", ".join(f"CAST(try_to_timestamp({s}, {sql_text(p)}) AS timestamp_ntz)" for p in layouts)
        cases.append(f"WHEN {s} RLIKE {sql_text(shape)} THEN coalesce({tries})")
    return F.expr(f"CASE WHEN length({s}) NOT BETWEEN 4 AND 40 OR NOT {s} RLIKE '[0-9]{{4}}' THEN NULL {' '.join(cases)} END")


def sql_text(value: str) -> str:
    """A string literal in SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_name(name: str) -> str:
    """A column name in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def distinct_key(c: Column, dtype: T.DataType) -> Column:
    """Stand-in for a cell in distinct counts: long text is replaced by its digest to keep shuffles narrow."""
    c = without_nan(c, dtype)
    if isinstance(dtype, T.StringType):
        return F.when(F.length(c) <= 48, c).otherwise(F.md5(c))
    return c


def same_cell(df: DataFrame, a: str, b: str) -> Column:
    """Equality where two missing cells are equal."""
    ca = without_nan(quoted(a), type_of(df, a))
    cb = without_nan(quoted(b), type_of(df, b))
    return ca.eqNullSafe(cb)


def complete_rows(df: DataFrame, *names: str) -> DataFrame:
    """Rows in which every named column is present."""
    keep = F.lit(True)
    for name in names:
        keep = keep & ~is_missing(df, name)
    return df.filter(keep)


def row_text(columns: list[Column]) -> Column:
    """Text that differs for different rows of cells: each cell with its length, `n` for null."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("n")) for c in columns]
    return F.concat(*parts) if parts else F.lit("")


def hash_order(keys: list[str], salt) -> Column:
    """Reproducible random order of rows: md5 of the row key and a salt, as lower-case hex text."""
    return F.md5(F.concat(row_text([quoted(k) for k in keys]), F.lit(f"|{salt}")))


def label_order(labels: list[str]) -> list[str]:
    """Ascending: by number where all labels are numbers, else by text."""
    if labels and all(re.fullmatch(NUMBER_SHAPE[1:-1], x.strip(WHITESPACE)) for x in labels):
        return sorted(labels, key=lambda x: (float(x), x))
    return sorted(labels)


def join_by(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on the grouping columns; a null group meets the null group."""
    named = {b: f"__right_{b}" for b in by}
    same = [quoted(b).eqNullSafe(quoted(r)) for b, r in named.items()]
    return left.join(right.withColumnsRenamed(named), same, how).drop(*named.values())


def numbers(df: DataFrame, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """Only the numeric values of the named columns, as v_0, v_1, ..; computed once per row for all uses."""
    return df.select(*(keep or []), *[number(df, c).alias(f"v_{i}") for i, c in enumerate(names)])


def inline_rows(agg: DataFrame, rows: list[dict[str, str]]) -> DataFrame:
    """One output row per dictionary of `name: SQL expression`, from a one-row aggregate."""
    structs = ", ".join(
        "named_struct(" + ", ".join(f"{sql_text(name)}, {value}" for name, value in row.items()) + ")" for row in rows
    )
    return agg.select(F.expr(f"inline(array({structs}))"))


def aggregate(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """One-row aggregate from `name: SQL expression`."""
    return df.agg(*[F.expr(f"{value} AS {sql_name(name)}") for name, value in expressions.items()])


def sql_double(value: float | None) -> str:
    """A double literal in SQL text."""
    if value is None:
        return "CAST(NULL AS DOUBLE)"
    return f"CAST('{value!r}' AS DOUBLE)" if math.isinf(value) else f"{float(value)!r}D"

"""Preparation stages fitted on training rows: date parts, imputation, scaling, one-hot, assembly.

Every stage is an MLlib estimator/model pair, so a fitted preparation is a `PipelineModel`
that can be saved, loaded and applied to any table, a streaming one included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colonnade.functions import cells
from colonnade.operators import catalog, statistics
from colonnade.settings import DEFAULTS, Settings

DATE_PARTS = ("year", "month", "day", "dayofweek")
# Parts used when no training row has a readable date.
DATE_DEFAULTS = {"year": 2020, "month": 1, "day": 1, "dayofweek": 0}
MISSING_LEVEL = "__MISSING__"


def date_part(t: Column, part: str) -> Column:
    """Calendar part; Monday is day 0 of the week."""
    return {"year": F.year, "month": F.month, "day": F.dayofmonth, "dayofweek": F.weekday}[part](t)


class _Stage(DefaultParamsReadable, DefaultParamsWritable):
    """Shared parameter handling; values are plain JSON, so stages persist with their pipeline."""

    def _take(self, **given):
        for name, value in given.items():
            if value is not None:
                self._set(**{name: value})
        return self

    def value(self, name):
        return self.getOrDefault(self.getParam(name))


def _param(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc)


class DateParts(Estimator, _Stage):
    """Learns the median of each calendar part, used where a date is unreadable."""

    columns = _param("columns", "datetime columns")

    @keyword_only
    def __init__(self, *, columns=None):
        super().__init__()
        self._take(columns=columns)

    def _fit(self, df):
        names = self.value("columns")
        parts = [(c, p) for c in names for p in DATE_PARTS]
        lead = cells.date_orders(df, names)
        # A calendar part has few distinct values, so the exact aggregate holds few of them.
        aggs = [
            F.percentile(date_part(cells.time(df, c, lead[c]), p), F.lit(0.5)).alias(f"m_{i}") for i, (c, p) in enumerate(parts)
        ]
        row = df.agg(*aggs).first() if aggs else {}
        medians: dict[str, dict[str, int]] = {c: {} for c in names}
        for i, (c, p) in enumerate(parts):
            m = row[f"m_{i}"]
            medians[c][p] = DATE_DEFAULTS[p] if m is None else int(m)
        return DatePartsModel(columns=names, medians=medians, days_lead=[c for c in names if lead[c]])


class DatePartsModel(Model, _Stage):
    columns = _param("columns", "datetime columns")
    medians = _param("medians", "column -> part -> fallback")
    days_lead = _param("days_lead", "columns that write the day before the month")

    @keyword_only
    def __init__(self, *, columns=None, medians=None, days_lead=None):
        super().__init__()
        self._take(columns=columns, medians=medians, days_lead=days_lead)

    def _transform(self, df):
        names, medians, lead = self.value("columns"), self.value("medians"), self.value("days_lead")
        new = {
            f"{c}_{p}": F.coalesce(date_part(cells.time(df, c, c in lead), p), F.lit(medians[c][p])).cast("int")
            for c in names for p in DATE_PARTS
        }
        return df.withColumns(new).drop(*names) if names else df


def _most_frequent(df: DataFrame, values: dict[str, Column]) -> dict[str, object]:
    """Most frequent present value per name, the smallest on a tie. Counts are combined before the shuffle."""
    if not values:
        return {}
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in values.items()])
    counts = (
        df.select(F.inline(pairs)).filter(F.col("value").isNotNull())
        .groupBy("name", "value").agg(F.count("*").alias("n"))
    )
    w = Window.partitionBy("name").orderBy(F.desc("n"), F.asc("value"))
    top = counts.withColumn("rank", F.row_number().over(w)).filter("rank = 1").collect()
    return {r["name"]: r["value"] for r in top}


class NumberPrep(Estimator, _Stage):
    """Learns fill values and, for standard scaling, mean and population deviation of the filled column."""

    columns = _param("columns", "numeric columns")
    imputation = _param("imputation", "median, mean or most_frequent")
    scaling = _param("scaling", "standard or none")

    @keyword_only
    def __init__(self, *, columns=None, imputation="median", scaling="standard"):
        super().__init__()
        self._take(columns=columns, imputation=imputation, scaling=scaling)

    def _fit(self, df):
        names, how = self.value("columns"), self.value("imputation")
        values = {c: cells.number(df, c) for c in names}
        if how == "most_frequent":
            fills = _most_frequent(df, values)
        elif how in ("median", "mean"):
            ranges = statistics.column_ranges(df, names)
            if how == "mean":
                fills = {c: r["mean"] for c, r in ranges.items()}
            else:
                fills = {c: q[0] for c, q in statistics.quantiles_of(df, names, ranges, [0.5]).items()}
        else:
            raise ValueError(f"unknown imputation {how!r}")
        fills = {c: float(fills[c]) if fills.get(c) is not None else 0.0 for c in names}
        shift, scale = {c: 0.0 for c in names}, {c: 1.0 for c in names}
        if self.value("scaling") == "standard" and names:
            for k in range(0, len(names), DEFAULTS.columns_per_aggregate):
                chunk = names[k:k + DEFAULTS.columns_per_aggregate]
                full = df.select(*[F.coalesce(values[c], F.lit(fills[c])).alias(f"v_{i}") for i, c in enumerate(chunk)])
                aggs = {}
                for i in range(len(chunk)):
                    aggs |= {f"a_{i}": f"avg(v_{i})", f"s_{i}": f"stddev_pop(v_{i})", f"c_{i}": f"min(v_{i}) = max(v_{i})"}
                row = cells.aggregate(full, aggs).first()
                shift |= {c: row[f"a_{i}"] or 0.0 for i, c in enumerate(chunk)}
                scale |= {c: 1.0 if row[f"c_{i}"] else (row[f"s_{i}"] or 1.0) for i, c in enumerate(chunk)}
        return NumberPrepModel(columns=names, fills=fills, shift=shift, scale=scale)


class NumberPrepModel(Model, _Stage):
    columns = _param("columns", "numeric columns")
    fills = _param("fills", "column -> value for missing cells")
    shift = _param("shift", "column -> subtracted value")
    scale = _param("scale", "column -> divisor")

    @keyword_only
    def __init__(self, *, columns=None, fills=None, shift=None, scale=None):
        super().__init__()
        self._take(columns=columns, fills=fills, shift=shift, scale=scale)

    def _transform(self, df):
        fills, shift, scale = self.value("fills"), self.value("shift"), self.value("scale")
        return df.withColumns({
            c: (F.coalesce(cells.number(df, c), F.lit(fills[c])) - F.lit(shift[c])) / F.lit(scale[c])
            for c in self.value("columns")
        })

    def table(self, spark) -> DataFrame:
        rows = [
            (c, self.value("fills")[c], self.value("shift")[c], self.value("scale")[c]) for c in self.value("columns")
        ]
        return spark.createDataFrame(rows, "`column` string, fill double, mean double, scale double")


def _level(df: DataFrame, c: str) -> Column:
    return cells.without_nan(cells.quoted(c), cells.type_of(df, c)).cast("string")


class CategoryFill(Estimator, _Stage):
    """Learns the level that replaces missing categories: the most frequent one, or a constant."""

    columns = _param("columns", "categorical columns")
    imputation = _param("imputation", "most_frequent or constant")

    @keyword_only
    def __init__(self, *, columns=None, imputation="most_frequent"):
        super().__init__()
        self._take(columns=columns, imputation=imputation)

    def _fit(self, df):
        names, how = self.value("columns"), self.value("imputation")
        if how not in ("most_frequent", "constant"):
            raise ValueError(f"unknown imputation {how!r}")
        found = _most_frequent(df, {c: _level(df, c) for c in names}) if how == "most_frequent" else {}
        return CategoryFillModel(columns=names, fills={c: found.get(c, MISSING_LEVEL) for c in names})


class CategoryFillModel(Model, _Stage):
    columns = _param("columns", "categorical columns")
    fills = _param("fills", "column -> level for missing cells")

    @keyword_only
    def __init__(self, *, columns=None, fills=None):
        super().__init__()
        self._take(columns=columns, fills=fills)

    def _transform(self, df):
        fills = self.value("fills")
        return df.withColumns({c: F.coalesce(_level(df, c), F.lit(fills[c])) for c in self.value("columns")})


@dataclass(frozen=True)
class Routing:
    """Which preparation path each feature takes."""

    dates: list[str]
    numeric: list[str]
    categorical: list[str]

    def numeric_inputs(self) -> list[str]:
        return self.numeric + [f"{c}_{p}" for c in self.dates for p in DATE_PARTS]


def route(types: dict[str, str], features: list[str], extract_dates: bool = True) -> Routing:
    """Dates to calendar parts, numbers to the numeric path, everything else (0/1 included) to one-hot."""
    dates = [c for c in features if types[c] == "datetime-like"] if extract_dates else []
    numeric = [c for c in features if types[c] in catalog.NUMERIC]
    return Routing(dates, numeric, [c for c in features if c not in dates and c not in numeric])


def routing_table(spark, routing: Routing) -> DataFrame:
    rows = [(c, k) for k in ("dates", "numeric", "categorical") for c in getattr(routing, k)]
    return spark.createDataFrame(rows, "`column` string, path string")


def preparation(
    routing: Routing,
    numeric_imputation: str = "median",
    categorical_imputation: str = "most_frequent",
    scaling: str = "standard",
    output: str = "features",
) -> Pipeline:
    """Unfitted pipeline: numeric features first, then one-hot levels; other columns stay outside the vector."""
    numeric, cats = routing.numeric_inputs(), routing.categorical
    if not numeric and not cats:
        raise ValueError("no numeric or categorical features to prepare")
    stages: list = []
    if routing.dates:
        stages.append(DateParts(columns=routing.dates))
    if numeric:
        stages.append(NumberPrep(columns=numeric, imputation=numeric_imputation, scaling=scaling))
    if cats:
        indexed, hot = [f"{c}__index" for c in cats], [f"{c}__levels" for c in cats]
        stages += [
            CategoryFill(columns=cats, imputation=categorical_imputation),
            StringIndexer(inputCols=cats, outputCols=indexed, stringOrderType="alphabetAsc", handleInvalid="keep"),
            # The indexer's extra slot for unseen levels is the one the encoder drops: unseen becomes all zeros.
            OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True),
        ]
    else:
        hot = []
    stages.append(VectorAssembler(inputCols=numeric + hot, outputCol=output))
    return Pipeline(stages=stages)


def feature_lineage(fitted: PipelineModel, routing: Routing) -> list[tuple[str, str]]:
    """(transformed feature, original column) in vector order."""
    out = [(c, c) for c in routing.numeric]
    out += [(f"{c}_{p}", c) for c in routing.dates for p in DATE_PARTS]
    indexers = [s for s in fitted.stages if isinstance(s, StringIndexerModel)]
    if indexers:
        for c, levels in zip(routing.categorical, indexers[0].labelsArray):
            out += [(f"{c}_{level}", c) for level in levels]
    return out


def lineage_table(spark, lineage: list[tuple[str, str]]) -> DataFrame:
    rows = [(i, f, o) for i, (f, o) in enumerate(lineage)]
    return spark.createDataFrame(rows, "position long, feature string, original_feature string")


def one_hot_table(df: DataFrame, column: str, levels: list[str], keep: list[str]) -> DataFrame:
    """Table form of the encoding: one 0/1 column per level, all zeros for an unseen level."""
    v = _level(df, column)
    return df.select(*keep, *[F.coalesce((v == level).cast("long"), F.lit(0)).alias(f"{column}_{level}")
                              for level in levels])


def feature_preview(prepared: DataFrame, names: list[str], keys: list[str], limit: int = 20,
                    vector: str = "features") -> DataFrame:
    """First rows in key order with one rounded column per feature."""
    from pyspark.ml.functions import vector_to_array

    first = prepared.orderBy(*keys).limit(limit).withColumn("__values", vector_to_array(vector))
    return first.select(*keys, *[cells.rounded(F.col("__values")[i]).alias(n) for i, n in enumerate(names)])

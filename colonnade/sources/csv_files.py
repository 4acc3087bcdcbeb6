"""CSV files: encoding and delimiter checks, tolerant reading, header repair, ingestion report."""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.functions import cells
from colonnade.sources import records

# Delimiters in order of preference.
DELIMITERS = [",", ";", "\t", "|"]

# Texts read as a missing cell.
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

SURPLUS = "__surplus"
HEADER_LINES = 200  # lines among which the header is looked for


class EmptyDatasetError(ValueError):
    pass


@dataclass
class IngestionReport:
    files: list[str]
    encoding: str
    delimiter: str
    raw_rows: int = 0
    raw_columns: int = 0
    skipped_rows: int = 0
    actions: list[tuple[str, str, dict[str, str]]] = field(default_factory=list)

    def add(self, kind: str, description: str, **details) -> None:
        self.actions.append((kind, description, {k: str(v) for k, v in details.items()}))

    def to_df(self, spark: SparkSession) -> DataFrame:
        schema = "position long, action_type string, description string, details map<string,string>"
        return spark.createDataFrame([(i, *a) for i, a in enumerate(self.actions)], schema)

    def facts(self, spark: SparkSession) -> DataFrame:
        row = (len(self.files), self.encoding, self.delimiter, self.raw_rows, self.raw_columns, self.skipped_rows)
        return spark.createDataFrame(
            [row], "files long, encoding string, delimiter string, raw_rows long, raw_columns long, skipped_rows long"
        )


def file_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, block, at, line): raw lines, in file order by (block, at) within a file."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"),
    )


def detect_encodings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, encoding): utf-8 when every line is valid, latin-1 otherwise.

    The text reader hands lines over as raw bytes, so validity is checked per line in parallel,
    over whole files, and no character is cut at a sample's edge.
    """
    valid = F.bool_and(F.is_valid_utf8("line"))
    return file_lines(spark, paths).groupBy("file").agg(F.when(valid, "utf-8").otherwise("latin-1").alias("encoding"))


def delimiter_votes(lines: DataFrame) -> DataFrame:
    """(file, delimiter) from `(file, at, line)`: the most frequent one in the first five non-blank lines.

    Ties go to the earlier one of the list; without any, the comma.
    """
    filled = lines.filter(F.trim("line", F.lit(cells.WHITESPACE)) != "")
    first = Window.partitionBy("file").orderBy("at")
    head = filled.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= 5)
    counts = [F.sum(F.length("line") - F.length(F.replace("line", F.lit(d)))).alias(f"n_{i}") for i, d in enumerate(DELIMITERS)]
    sums = head.groupBy("file").agg(*counts)
    best = F.greatest(*[F.col(f"n_{i}") for i in range(len(DELIMITERS))])
    pick = F.lit(DELIMITERS[0])
    for i in reversed(range(len(DELIMITERS))):
        pick = F.when((F.col(f"n_{i}") == best) & (best > 0), DELIMITERS[i]).otherwise(pick)
    return sums.select("file", pick.alias("delimiter"))


def detect_delimiters(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, delimiter); only lines of each file's first block are ranked."""
    return delimiter_votes(file_lines(spark, paths).filter(F.col("block") == 0))


def repair_header(names: list[str]) -> tuple[list[str], dict[str, str]]:
    """Unique, trimmed column names and what was renamed.

    An empty header is `Unnamed: i`; a repeated one gets a numbered suffix; `x.1` becomes `x_1`;
    inner whitespace is collapsed; a blank one becomes `column_i`.
    """
    seen: dict[str, int] = {}
    raw = []
    for i, name in enumerate(names):
        name = name if name else f"Unnamed: {i}"
        raw.append(f"{name}.{seen[name]}" if name in seen else name)
        seen[name] = seen.get(name, 0) + 1
    out: list[str] = []
    taken: dict[str, int] = {}
    renamed: dict[str, str] = {}
    for i, name in enumerate(raw):
        clean = name.strip() or f"column_{i + 1}"
        numbered = re.fullmatch(r"(.*)\.(\d+)", clean)
        if numbered:
            clean = "_".join(numbered.groups())
        clean = " ".join(clean.split())
        while clean in taken:
            taken[clean] += 1
            clean = f"{clean}_{taken[clean]}"
        taken[clean] = 0
        if clean != name:
            renamed[name] = clean
        out.append(clean)
    return out, renamed


def _physical_types(df: DataFrame, names: list[str]) -> dict[str, str]:
    """Narrowest of boolean, bigint, double and string that every present cell fits. One map-side aggregate."""
    aggs = []
    for i, c in enumerate(names):
        v = cells.stripped(cells.quoted(c))
        aggs += [
            F.count(v).alias(f"n_{i}"),
            F.bool_and(F.when(v.isNotNull(), v.isin("True", "False", "TRUE", "FALSE", "true", "false"))).alias(f"b_{i}"),
            F.bool_and(F.when(v.isNotNull(), v.rlike(r"^[+-]?\d{1,19}$") & v.try_cast("bigint").isNotNull())).alias(f"i_{i}"),
            F.bool_and(F.when(v.isNotNull(), v.try_cast("double").isNotNull() & ~v.rlike("(?i)[df]$"))).alias(f"d_{i}"),
        ]
    row = df.agg(*aggs).first()
    kinds = {}
    for i, c in enumerate(names):
        options = [(f"b_{i}", "boolean"), (f"i_{i}", "bigint"), (f"d_{i}", "double")]
        kinds[c] = next((kind for flag, kind in options if row[flag]), "string" if row[f"n_{i}"] else "double")
    return kinds


def is_row_index(df: DataFrame, name: str) -> bool:
    """Whether the present values are whole numbers that step by one: as many distinct ones as their range holds."""
    if not isinstance(cells.type_of(df, name), cells.INTEGER_TYPES + cells.FRACTION_TYPES):
        return False
    v = cells.quoted(name)
    row = df.agg(F.count(v).alias("n"), F.count_distinct(v).alias("d"), F.min(v).alias("lo"), F.max(v).alias("hi"),
                 F.bool_and(v == F.floor(v)).alias("whole")).first()
    return bool(row["n"] and row["whole"]) and row["n"] == row["d"] == row["hi"] - row["lo"] + 1


def may_have_torn_records(lines: DataFrame, delimiter: str) -> bool:
    """Whether some line holds an odd number of quotes, or one inside an unquoted field; without, no record is torn."""
    text = F.col("line").cast("string")
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"')))
    d = records.escaped(delimiter)
    inner = text.rlike(f'[^"{d}]"[^"\\r{d}]')
    return bool(lines.agg(F.bool_or((quotes % 2 == 1) | inner)).first()[0])


def read_csv(
    spark: SparkSession, paths: str | list[str], delimiter: str | None = None, encoding: str | None = None
) -> tuple[DataFrame, IngestionReport]:
    """Read and repair CSV files with a common header.

    Rows with too many fields are skipped and counted, shorter ones are padded with nulls. The
    schema has one column more than the header, so a surplus field shows up there; a row whose
    surplus fields are all empty is kept.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    top = spark.read.text(paths).filter(F.trim("value", F.lit(cells.WHITESPACE)) != "").take(1)
    if not top:
        raise EmptyDatasetError(f"no rows in {paths}")
    if encoding is None:
        found = {r["encoding"] for r in detect_encodings(spark, paths).select("encoding").distinct().collect()}
        encoding = "latin-1" if "latin-1" in found else "utf-8"
    if delimiter is None:
        votes = detect_delimiters(spark, paths).groupBy("delimiter").count().orderBy(F.desc("count"), "delimiter")
        delimiter = votes.first()["delimiter"]
    report = IngestionReport(paths, encoding, delimiter)
    report.add("encoding_detection", f"file encoding {encoding}", encoding=encoding)
    report.add("delimiter_detection", f"column delimiter {delimiter!r}", delimiter=delimiter)

    lines = records.lines_of(spark, paths)
    begin = [r["line"] for r in lines.filter("block = 0").select("line").take(HEADER_LINES)]
    first = records.first_record([x.removeprefix(b"\xef\xbb\xbf") for x in begin], delimiter).removesuffix(b"\r")
    fields = next(csv.reader([*first.decode(encoding, "replace").splitlines(keepends=True)], delimiter=delimiter))
    names, renamed = repair_header(fields)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, SURPLUS]])
    # Spark's reader is given the JVM's name of the charset.
    options = {"header": True, "sep": delimiter, "encoding": "ISO-8859-1" if encoding == "latin-1" else "UTF-8",
               "mode": "PERMISSIVE", "escape": '"'}
    torn = 0
    if may_have_torn_records(lines, delimiter):
        crossing, torn, stray = records.borders(records.summaries(lines, delimiter, len(names)), len(names))
        if stray:
            report.add("stray_quotes", f"{stray} lines open a quoted field that no quote closes; each is read as a row", rows=stray)
    if torn:
        report.add("multi_line_records", f"{torn} records hold line breaks in quoted fields", rows=torn)
        cut = records.records(lines, delimiter, len(names), crossing, encoding).filter("NOT header").filter(F.trim("record") != "")
        parsed = F.from_csv("record", ", ".join(f"{cells.sql_name(n)} string" for n in [*names, SURPLUS]), {"sep": delimiter, "escape": '"', "mode": "PERMISSIVE"})
        raw = cut.select(parsed.alias("row")).select("row.*")
    else:
        raw = spark.read.options(**options).schema(schema).csv(paths)
    too_long = F.col(SURPLUS).isNotNull()
    kept = raw.filter(~too_long).select(*[
        F.when(~cells.quoted(n).isin(MISSING_WORDS), cells.quoted(n)).alias(n) for n in names
    ])
    counted = raw.agg(F.count(F.lit(1)).alias("rows"), F.count_if(too_long).alias("skipped")).first()
    report.skipped_rows = counted["skipped"]
    report.raw_rows = counted["rows"] - counted["skipped"]
    report.raw_columns = len(names)

    kinds = _physical_types(kept, names)
    typed = kept.select(*[
        cells.quoted(n) if kinds[n] == "string" else cells.stripped(cells.quoted(n)).cast(kinds[n]).alias(n) for n in names
    ])
    for n in names:
        if n.lower() in ("unnamed: 0", "index") and is_row_index(typed, n):
            typed = typed.drop(n)
            report.add("unnamed_index", f"dropped sequential index column {n!r}", column=n)
    if renamed:
        report.add("duplicate_or_empty_columns", f"renamed {len(renamed)} column headers", **renamed)
    return typed, report

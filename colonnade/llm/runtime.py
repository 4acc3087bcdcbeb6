"""What the operators share: code on the executors, intermediate tables, null-safe inputs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from colonnade.functions.storage import scratch_path

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, as `--py-files` would."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), f"colonnade-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: later jobs read it, a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column has it or begins with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def without(df: DataFrame, names) -> list[StructField]:
    """The fields whose name, whatever its case, is none of the given ones."""
    gone = {n.lower() for n in names}
    return [f for f in df.schema.fields if f.name.lower() not in gone]


def beside(df: DataFrame, added: list[tuple[str, str]], start, using: tuple[str, ...] = ("text",)) -> DataFrame:
    """The rows of df with new columns that Python computes from the columns `using`.

    start() runs once per partition and gives a function from Arrow arrays, one per used column, to arrays for the new
    ones. Columns named as a new one are replaced; all others pass, whatever their names, by position.
    """
    ship(df.sparkSession)
    kept = without(df, [n for n, _ in added])
    place = {f.name.lower(): i for i, f in enumerate(kept)}
    at = [place[u.lower()] for u in using]
    plain = df.select(*[F.col(quoted(f.name)).alias(f"_{i}") for i, f in enumerate(kept)])
    names = [f"_{i}" for i in range(len(kept) + len(added))]
    new = [StructField(n, StructType.fromDDL(f"x {kind}").fields[0].dataType) for n, (_, kind) in zip(names[len(kept):], added, strict=True)]
    schema = StructType([*plain.schema.fields, *new])

    def run(batches):
        work = start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *work(*[batch.column(i) for i in at])], names)

    return plain.mapInArrow(run, schema).toDF(*[f.name for f in kept], *[n for n, _ in added])

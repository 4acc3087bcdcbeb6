"""Where intermediate tables live: the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """The folder named by the session in `spark.checkpoint.dir`, if any."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; a local one only where the session names none and runs on one machine."""
    base = shared_folder(spark)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="colonnade-")
    return f"{base.rstrip('/')}/colonnade-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table that later jobs read many times.

    Written once to the shared folder, so a lost executor costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)

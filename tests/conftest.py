import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Table with a `row_id` key from a schema and column lists."""
    def build(schema, **columns):
        names = [part.strip().split()[0].strip("`") for part in schema.split(",")]
        n = len(columns[names[0]])
        rows = [(i, *[columns[c][i] for c in names]) for i in range(n)]
        return spark.createDataFrame(rows, "row_id long, " + schema)
    return build


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def by(df, *keys):
    return {(r[keys[0]] if len(keys) == 1 else tuple(r[k] for k in keys)): r.asDict() for r in df.collect()}

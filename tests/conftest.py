import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("fieldstats-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """A table from a pandas frame, with times as TIMESTAMP_NTZ and NaN as NULL."""

    def build(pdf, partitions=3):
        df = spark.createDataFrame(pdf)
        casts = [
            f"cast(`{c}` as timestamp_ntz) as `{c}`" if t == "timestamp" else f"`{c}`" for c, t in df.dtypes
        ]
        return df.selectExpr(*casts).repartition(partitions)

    return build


def rows(df, key=None):
    out = [r.asDict() for r in df.collect()]
    return sorted(out, key=lambda r: r[key]) if key else out

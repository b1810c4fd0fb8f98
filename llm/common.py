"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldstats.session import ensure_checkpoint_dir

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ref(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer if the table has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def saved(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read from there: the plan behind them is cut, and a lost
    executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes, a null text as an empty one: Python then sees exact bytes, without decoding."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def values(batch: pa.Array) -> list:
    return batch.to_pylist()

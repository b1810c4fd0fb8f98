"""Files to tables."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstats import fixed
from fieldstats.functions.coerce import ref
from fieldstats.sources.records import csv_records

#: The folders of years in partitioned output; not a column of the table.
YEAR_FOLDER = "fieldstats_year"

_ARRAY_FORMATS = {
    "netcdf": "flatten_grid",
    "grib": "flatten_grid",
    "geotiff": "flatten_raster",
}


def detect_format(path: str) -> str:
    suffix = posixpath.splitext(str(path).rstrip("/"))[1].lower()
    if suffix not in fixed.FILE_FORMATS:
        raise ValueError(f"Unknown file type '{suffix}'. Known: {', '.join(sorted(fixed.FILE_FORMATS))}")
    return fixed.FILE_FORMATS[suffix]


def read_table(
    spark: SparkSession, path: str, format: str | None = None, schema: T.StructType | str | None = None
) -> DataFrame:
    """CSV or parquet. Other formats hold encoded arrays or sheets that Spark has no reader for; once their arrays
    are in a table, ``flatten_grid`` and ``flatten_raster`` take over."""
    kind = format or detect_format(path)
    if kind == "parquet":
        return spark.read.parquet(path).drop(YEAR_FOLDER)
    if kind == "csv":
        return read_csv(spark, path, schema)
    hint = f" Load its arrays into a table and use {_ARRAY_FORMATS[kind]}." if kind in _ARRAY_FORMATS else ""
    raise ValueError(f"'{kind}' files are not read directly.{hint}")


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True
) -> DataFrame:
    """CSV with a header row. Quoted cells may hold line breaks, and files are split all the same, see ``records.csv_records``. Where no
    cell holds one, ``multi_line=False`` saves the pass that looks for them; a line that is not a whole record then raises.

    Without a ``schema`` the types are inferred over the whole file in one scan, with every missing-value token as
    NULL: all-integer columns are bigint (double when cells are missing), numeric ones double, True/False boolean,
    the rest text.
    """
    options = {"header": True, "quote": '"', "escape": '"'}
    if not multi_line:
        lines = spark.read.options(**options, mode="FAILFAST")
        table = (lines.schema(schema) if schema is not None else lines).csv(path)
    else:
        kinds = schema
        if kinds is None:
            kinds = spark.read.options(**options, multiLine=True).csv(path).schema
        if isinstance(kinds, T.StructType):
            kinds = kinds.toDDL()
        cells = F.from_csv("record", kinds, {"quote": '"', "escape": '"'}).alias("cells")
        table = csv_records(spark, path).select(cells).select("cells.*")
    text = null_tokens(table)
    if schema is not None:
        return text
    kinds = _infer(text)
    return text.select(*[_as_kind(ref(c), kinds[c]).alias(c) for c in text.columns])


def null_tokens(df: DataFrame) -> DataFrame:
    """Missing-value tokens in text columns become NULL."""
    columns: list[Column] = []
    for f in df.schema.fields:
        column = ref(f.name)
        if isinstance(f.dataType, T.StringType):
            column = F.when(~column.isin(*fixed.MISSING_TOKENS), column)
        columns.append(column.alias(f.name))
    return df.select(*columns)


def _number(text: Column) -> Column:
    return F.when(~F.trim(text).rlike(r"[0-9.][dDfF]$"), F.trim(text).try_cast("double"))


def _infer(df: DataFrame) -> dict[str, str]:
    parts: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(df.columns):
        c = ref(name)
        parts += [
            F.count(c).alias(f"n{i}"),
            F.count(F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), c.try_cast("bigint"))).alias(f"i{i}"),
            F.count(_number(c)).alias(f"d{i}"),
            F.count_if(F.lower(c).isin("true", "false")).alias(f"b{i}"),
        ]
    row = df.agg(*parts).head()
    kinds: dict[str, str] = {}
    for i, name in enumerate(df.columns):
        n = row[f"n{i}"]
        if n == 0 or row[f"d{i}"] == n:
            whole = n and row[f"i{i}"] == n and n == row["rows"]
            kinds[name] = "bigint" if whole else "double"
        elif row[f"b{i}"] == n and n == row["rows"]:
            kinds[name] = "boolean"
        else:
            kinds[name] = "string"
    return kinds


def _as_kind(text: Column, kind: str) -> Column:
    if kind == "double":
        return _number(text)
    return text if kind == "string" else F.trim(text).try_cast(kind)

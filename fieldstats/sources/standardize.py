"""Plain column names and plain cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstats.functions.coerce import ref
from fieldstats.plans.ranks import systematic_sample

_REPLACEMENT = "�"


def utf8_text(binary: Column) -> Column:
    """Bytes as text; bytes that are not UTF-8 are left out."""
    text = binary.cast("string")
    repaired = F.replace(F.make_valid_utf8(text), F.lit(_REPLACEMENT), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(repaired)


def plain_cell(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.BinaryType):
        return utf8_text(column)
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column


def standardize(
    df: DataFrame, max_rows: int | None = None, order_by: Sequence[str] = ()
) -> DataFrame:
    """Names without surrounding blanks, bytes and containers as text. ``max_rows`` (off by default) keeps that many
    rows, evenly spaced."""
    cells = [
        plain_cell(ref(f.name), f.dataType).alias(f.name.strip(), metadata=f.metadata or {}) for f in df.schema.fields
    ]
    plain = df.select(*cells)
    return systematic_sample(plain, max_rows, order_by) if max_rows else plain

"""Tables as long cells, and the column kinds the rules distinguish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwarden.functions.text import value_key

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def observed_type(data_type: T.DataType) -> str:
    if isinstance(data_type, _INTEGERS):
        return "integer"
    if isinstance(data_type, _FLOATS):
        return "float"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, _TIMES):
        return "datetime"
    if isinstance(data_type, T.StringType):
        return "string"
    return data_type.simpleString()


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_string(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.StringType)


def data_columns(df: DataFrame, key: str, columns=None) -> list[str]:
    """The checked columns, in table order. The key and the added row id are checked only if asked for by name."""
    wanted = [c for c in df.columns if c != key] if columns is None else columns
    return [c for c in df.columns if c in set(wanted) and c != "row_id"]


def with_row_id(df: DataFrame, key: str) -> DataFrame:
    """Add the ``row_id`` column from a unique numeric key column."""
    return df if key == "row_id" else df.withColumn("row_id", F.col(key).try_cast("bigint"))


def text_of(c: str, data_type: T.DataType) -> Column:
    """Display text of a cell."""
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return F.col(c).cast("string")


def identity_of(c: str, data_type: T.DataType) -> Column:
    """A value's grouping key: a BIGINT for fixed-width types, else text.

    ``xxhash64`` of one value of at most eight bytes maps distinct values to
    distinct hashes, so the short key is exact for numbers, booleans and
    times. Strings and nested values keep their (digested) text.
    """
    narrow_decimal = isinstance(data_type, T.DecimalType) and data_type.precision <= 18
    if narrow_decimal or isinstance(data_type, _INTEGERS + _FLOATS + _TIMES + (T.BooleanType,)):
        return F.when(F.col(c).isNotNull(), F.xxhash64(c))
    return value_key(text_of(c, data_type))


def fixed_width(data_type: T.DataType) -> bool:
    narrow_decimal = isinstance(data_type, T.DecimalType) and data_type.precision <= 18
    return narrow_decimal or isinstance(data_type, _INTEGERS + _FLOATS + _TIMES + (T.BooleanType,))


def unpivot(df: DataFrame, columns: list[str], value, keep: list[str] = ()) -> DataFrame:
    """One row per cell: the ``keep`` columns, ``column`` and ``value``.

    ``value(name)`` gives the cell's expression; only the named columns are
    read, so unread ones are pruned at the scan.
    """
    entries = [F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns]
    return df.select(*keep, F.inline(F.array(*entries)))

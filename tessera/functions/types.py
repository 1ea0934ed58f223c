"""Type resolution and schemas."""

from __future__ import annotations

import datetime as dt
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema, to_arrow_type

_PYTHON = {
    bool: T.BooleanType(),
    int: T.LongType(),
    float: T.DoubleType(),
    str: T.StringType(),
    bytes: T.BinaryType(),
    dt.date: T.DateType(),
    dt.datetime: T.TimestampNTZType(),
}
_NAMES = {
    "str": "string", "long": "bigint", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "bool": "boolean",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double",
    "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "bytes": "binary", "object": "string",
}
_UNSIGNED = {pa.uint8(): T.ShortType(), pa.uint16(): T.IntegerType(), pa.uint32(): T.LongType(), pa.uint64(): T.DecimalType(20, 0)}


def to_spark_type(kind: Any) -> T.DataType:
    """The Spark type of a Python type, a name or schema expression, an Arrow, numpy or Spark type.

    Timestamps have no zone, the name ``int`` has 32 bits and the Python type 64, unsigned types are
    widened, and the object dtype is text.
    """
    if isinstance(kind, T.DataType):
        return kind
    if isinstance(kind, type) and kind in _PYTHON:
        return _PYTHON[kind]
    if isinstance(kind, pa.DataType):
        if kind in _UNSIGNED:
            return _UNSIGNED[kind]
        return T.TimestampNTZType() if pa.types.is_timestamp(kind) else from_arrow_type(kind)
    name = (kind if isinstance(kind, str) else str(getattr(kind, "name", kind))).lower()
    if name.startswith("datetime64"):
        return T.TimestampNTZType()
    try:
        return T._parse_datatype_string(_NAMES.get(name, name))
    except Exception as e:
        raise TypeError(f"{kind!r} is no known type") from e


def to_spark_schema(schema: Any) -> T.StructType:
    """A schema from a StructType, an Arrow schema, a frame, or text such as ``a:str,b:long``."""
    if isinstance(schema, T.StructType):
        return schema
    if isinstance(schema, DataFrame):
        return schema.schema
    if isinstance(schema, pa.Schema):
        return T.StructType([T.StructField(f.name, to_spark_type(f.type)) for f in schema])
    parts = [p.strip().split(":", 1) for p in schema.split(",")]
    return T.StructType([T.StructField(n.strip(), to_spark_type(t.strip())) for n, t in parts])


def column_type(df: DataFrame, value: Any) -> T.DataType:
    """Type of a column of ``df`` or of a constant; analysis only, no job."""
    if isinstance(value, Column):
        return df.select(value).schema[0].dataType
    if value is None:
        return T.NullType()
    return df.select(F.lit(value)).schema[0].dataType


def arrow_type(df: DataFrame, value: Any) -> pa.DataType:
    return to_arrow_type(column_type(df, value))


def schema_of(df: DataFrame) -> pa.Schema:
    """The Arrow schema of a frame."""
    ensure_compatible(df)
    return to_arrow_schema(df.schema)


def ensure_compatible(df: DataFrame) -> None:
    """Raise unless all column names are different non-empty texts."""
    from tessera.errors import IncompatibleFrameError

    if any(not isinstance(c, str) or not c for c in df.columns) or len(set(df.columns)) < len(df.columns):
        raise IncompatibleFrameError(f"column names must be different and not empty: {df.columns}")


def is_compatible_index(df: DataFrame) -> bool:
    """Frames have no index, so none is in the way."""
    return True



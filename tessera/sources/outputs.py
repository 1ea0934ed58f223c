"""Frames to local data, and local data to frames."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import CastError
from tessera.functions.casting import cast_column
from tessera.functions.types import ensure_compatible, to_spark_schema, to_spark_type
from tessera.functions.values import clean, is_missing

_CASTS = ("CAST_OVERFLOW", "CAST_INVALID_INPUT", "CAST_OVERFLOW_IN_TABLE_INSERT")


@contextmanager
def cast_errors() -> Iterator[None]:
    """Raise ``CastError`` for values that a cast in the plan couldn't convert."""
    try:
        yield
    except PySparkException as e:
        if e.getCondition() in _CASTS or any(c in str(e) for c in _CASTS):
            raise CastError(str(e)) from e
        raise


def read_local(spark: SparkSession, data: pd.DataFrame | pa.Table | list, schema: Any = None) -> DataFrame:
    """A frame of local data; NaN becomes NULL, and unsigned and zoned columns are adapted."""
    kind = to_spark_schema(schema) if schema is not None else None
    if isinstance(data, pa.Table):
        fields = [(f, to_spark_type(f.type)) for f in data.schema]
        widths = {T.ShortType(): pa.int16(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64()}
        fixed = [pa.field(f.name, widths.get(t, f.type) if pa.types.is_unsigned_integer(f.type) else f.type) for f, t in fields]
        return clean(spark.createDataFrame(data.cast(pa.schema(fixed))))
    if isinstance(data, pd.DataFrame):
        if any(not isinstance(c, str) for c in data.columns):
            raise ValueError("columns must have names")
        rows = [[None if is_missing(v) or v is pd.NaT or v is pd.NA else v for v in r] for r in data.itertuples(index=False)]
        if kind is None:
            return clean(spark.createDataFrame(pa.Table.from_pandas(data, preserve_index=False)))
        return clean(spark.createDataFrame(rows, kind))
    return clean(spark.createDataFrame(data, kind))


def to_series(spark: SparkSession, values: Any, name: str, kind: Any = None) -> DataFrame:
    """A list, array or pandas series as a frame with its positions: ``position, name``."""
    items = [None if is_missing(v) else v for v in (values.tolist() if hasattr(values, "tolist") else list(values))]
    field = to_spark_type(kind) if kind is not None else to_spark_type(type(next((v for v in items if v is not None), "")))
    schema = T.StructType([T.StructField("position", T.LongType()), T.StructField(name, field)])
    return spark.createDataFrame(list(enumerate(items)), schema)


def series_to_array(df: DataFrame, column: Column | str) -> list:
    """All values of one column."""
    with cast_errors():
        return df.select(column).toArrow()[0].to_pylist()


def as_pandas(df: DataFrame) -> pd.DataFrame:
    with cast_errors():
        return df.toPandas()


def as_arrow(df: DataFrame, schema: pa.Schema | None = None, type_safe: bool = True) -> pa.Table:
    """An Arrow table of the schema's types; ``type_safe``: no value may lose anything."""
    with cast_errors():
        table = df.toArrow()
    return table if schema is None else table.select(schema.names).cast(schema, safe=type_safe)


def _leaves_as_text(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_leaves_as_text(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _leaves_as_text(f.dataType)) for f in kind])
    return T.StringType()


def _nested(c: Column, source: T.DataType, target: T.DataType) -> Column:
    """JSON text, at any depth, as the nested type: read with text leaves, then cast."""
    if isinstance(target, T.ArrayType | T.StructType) and isinstance(source, T.StringType):
        read = _leaves_as_text(target)
        return _nested(F.from_json(c, read), read, target)
    if isinstance(target, T.ArrayType) and isinstance(source, T.ArrayType):
        return F.transform(c, lambda x: _nested(x, source.elementType, target.elementType))
    if isinstance(target, T.StructType) and isinstance(source, T.StructType):
        have = {f.name: f.dataType for f in source}
        parts = [(_nested(c[f.name], have[f.name], f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in target]
        return F.when(c.isNotNull(), F.struct(*parts))
    return c if source == target else c.cast(target)


def shaped(df: DataFrame, schema: Any, columns: list[str] | None = None) -> DataFrame:
    """``df`` as the schema's types: nested columns may come as JSON text."""
    wanted = {f.name: f.dataType for f in to_spark_schema(schema)}
    have = {f.name: f.dataType for f in df.schema}
    names = columns or list(wanted)
    nested = T.ArrayType | T.StructType
    return df.select(
        *[
            (_nested(df[f"`{n}`"], have[n], wanted[n]) if isinstance(wanted[n], nested) else cast_column(df, df[f"`{n}`"], wanted[n])).alias(n)
            for n in names
        ]
    )


def _plain(value: Any) -> Any:
    if isinstance(value, T.Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return None if is_missing(value) else value


def as_array_iterable(df: DataFrame, schema: Any = None, columns: list[str] | None = None, type_safe: bool = False) -> Iterator[list]:
    """Rows as lists, a partition at a time. ``type_safe``: of the schema's types (the frame's own, without one), and a
    value that isn't raises ``CastError``; else integers and floats stand for each other as they come."""
    ensure_compatible(df)
    rows = shaped(df, schema, columns) if schema is not None else df.select(*(columns or df.columns))
    kinds = [f.dataType for f in rows.schema]
    with cast_errors():
        for row in rows.toLocalIterator():
            yield [_checked(_plain(v), k) if type_safe else _plain(v) for v, k in zip(row, kinds, strict=True)]


def _checked(value: Any, kind: T.DataType) -> Any:
    """The value if it is of the type's Python class; bytes for binary, whatever the client holds them in."""
    if value is None:
        return None
    if isinstance(kind, T.BinaryType):
        return bytes(value)
    if isinstance(kind, T.ArrayType):
        return [_checked(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType):
        return {f.name: _checked(value[f.name], f.dataType) for f in kind}
    wanted = {T.BooleanType: bool, T.StringType: str, T.FloatType: float, T.DoubleType: float}.get(type(kind), int if isinstance(kind, T.IntegralType) else None)
    if wanted and type(value) is not wanted:
        raise CastError(f"{value!r} is no {kind.simpleString()}")
    return value


def as_array(df: DataFrame, schema: Any = None, columns: list[str] | None = None, type_safe: bool = False) -> list[list]:
    return list(as_array_iterable(df, schema, columns, type_safe))


def empty(df: DataFrame) -> bool:
    return df.isEmpty()


def table(spark: SparkSession, folder: str, name: str, likely: Column | None = None) -> DataFrame:
    """The Parquet table ``folder/name.parquet``; NaN becomes NULL.

    A comparison of a float column that may be NaN doesn't reach the scan. ``likely`` does: it is a condition on the columns
    as they are stored, true for every row that is wanted (NaN counts as the greatest number there).
    """
    raw = spark.read.parquet(f"{folder}/{name}.parquet")
    return clean(raw if likely is None else raw.where(likely))


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    """Parquet tables ``folder/name.parquet``; see ``table``."""
    return [table(spark, folder, n) for n in names]

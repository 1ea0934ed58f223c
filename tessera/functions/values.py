"""Constants, truth and NaN: the glue that gives every operand SQL meaning."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import InvalidOperationError
from tessera.functions.types import column_type, to_spark_type


def is_column(value: Any) -> bool:
    return isinstance(value, Column)


def is_missing(value: Any) -> bool:
    """None and NaN are both NULL."""
    return value is None or isinstance(value, float) and math.isnan(value)


def as_column(value: Any, kind: Any = None) -> Column:
    """A column as it is; a constant as a literal, of type ``kind`` if given."""
    c = value if is_column(value) else F.lit(None if is_missing(value) else value)
    return c if kind is None else c.cast(to_spark_type(kind))


def constant(value: Any, kind: Any = None, name: str | None = None) -> Column:
    c = as_column(value, kind)
    return c.alias(name) if name else c


def nan_to_null(c: Column) -> Column:
    """NULL for NaN, of the same type. For numbers only."""
    return F.when(~F.isnan(c), c)


def clean(df: DataFrame) -> DataFrame:
    """``df`` with NULL for NaN in its float columns: do this once where data comes in."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)}
    if not floats:
        return df
    return df.select(*[nan_to_null(df[f"`{c}`"]).alias(c) if c in floats else df[f"`{c}`"] for c in df.columns])


def truthy(df: DataFrame, value: Any) -> Column:
    """A condition from a boolean, a number (not 0) or NULL; other types can't be conditions."""
    null = F.lit(None).cast("boolean")
    if not is_column(value):
        if is_missing(value):
            return null
        if isinstance(value, bool | int | float):
            return F.lit(value != 0)
        raise InvalidOperationError(f"{value!r} can't be a condition")
    kind = column_type(df, value)
    if isinstance(kind, T.BooleanType):
        return value
    if isinstance(kind, T.NullType):
        return null
    if isinstance(kind, T.FloatType | T.DoubleType):
        return nan_to_null(value) != 0
    if isinstance(kind, T.NumericType):
        return value != 0
    raise InvalidOperationError(f"{kind.simpleString()} can't be a condition")


def evaluate(expression: Column, spark: SparkSession | None = None) -> Any:
    """The value of an expression of constants; NaN as None."""
    spark = spark or SparkSession.getActiveSession()
    value = spark.range(1).select(expression.alias("x")).first()[0]
    return None if is_missing(value) else value


def result(expression: Column, *operands: Any) -> Any:
    """The expression, or its value if no operand is a column: constants in, a constant out."""
    return expression if any(is_column(x) for x in operands) else evaluate(expression)

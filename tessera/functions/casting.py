"""Casts between types with one meaning for text, numbers, truth and time."""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import CastError
from tessera.functions.types import column_type, to_spark_schema, to_spark_type
from tessera.functions.values import as_column, evaluate, is_column, nan_to_null

_TIMES = T.TimestampType | T.TimestampNTZType | T.DateType
_FLOATS = T.FloatType | T.DoubleType
_TEXTS_FOR_NULL = ("nat", "nan", "")


def _to_boolean(c: Column, source: T.DataType) -> Column:
    if isinstance(source, T.StringType):
        text = F.lower(c)
        return F.when(text.isin("true", "1", "1.0"), True).when(text.isin("false", "0", "0.0"), False)
    return (nan_to_null(c) if isinstance(source, _FLOATS) else c) != 0


def _to_integer(c: Column, source: T.DataType, target: T.DataType) -> Column:
    if isinstance(source, T.StringType):
        return F.coalesce(c.try_cast("bigint"), nan_to_null(c.cast("double")).cast("bigint")).cast(target)
    if isinstance(source, _FLOATS):
        return nan_to_null(c).cast(target)
    return c.cast(target)


def _float_text(c: Column) -> Column:
    """Digits as Python prints them: plain from 1e-4 up to 1e16, else with a signed exponent of two digits."""
    x = c.cast("double")
    plain, size = x.cast("string"), F.abs(x)
    decimal = F.when(size >= 1, x.try_cast("decimal(38,18)").cast("string")).otherwise(x.try_cast("decimal(38,30)").cast("string"))
    long = F.regexp_replace(F.regexp_replace(decimal, "0+$", ""), r"\.$", ".0")
    mantissa = F.regexp_replace(F.regexp_extract(plain, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(plain, r"E(-?)([0-9]+)$", 2)
    sign = F.when(plain.contains("E-"), "-").otherwise("+")
    short = F.concat(mantissa, F.lit("e"), sign, F.lpad(power, F.greatest(F.lit(2), F.length(power)), F.lit("0")))
    return (
        F.when(F.isnan(x), None)
        .when(x == float("inf"), "inf")
        .when(x == float("-inf"), "-inf")
        .when((size == 0) | (size >= 1e-3) & (size < 1e7), plain)
        .when((size >= 1e-4) & (size < 1e16), long)
        .otherwise(short)
    )


def _to_time(c: Column, source: T.DataType, target: T.DataType) -> Column:
    if isinstance(source, T.StringType):
        real = F.when(~F.lower(F.trim(c)).isin(*_TEXTS_FOR_NULL), c)
        moment = real.cast("timestamp_ntz")
        return moment if isinstance(target, T.TimestampNTZType) else moment.cast(target)
    return c.cast(target)


def cast_column(df: DataFrame | None, value: Any, target: Any, hint: Any = None) -> Column:
    """``value`` as ``target``; ``hint`` is the type it is first read as.

    Pairs of types that don't convert raise ``CastError`` at once; values that don't convert fail when the
    result is computed (see ``outputs``).
    """
    target = to_spark_type(target)
    c = as_column(value)
    if hint is not None:
        c = cast_column(df, value, hint)
        source = to_spark_type(hint)
    elif is_column(value):
        source = column_type(df, value)
    else:
        source = evaluate_type(value)
    if source == target:
        return c
    if isinstance(source, T.NullType):
        return c.cast(target)
    if isinstance(source, _TIMES) and isinstance(target, T.BooleanType | T.NumericType):
        raise CastError(f"{source.simpleString()} can't become {target.simpleString()}")
    if isinstance(target, _TIMES) and isinstance(source, T.BooleanType | T.NumericType):
        raise CastError(f"{source.simpleString()} can't become {target.simpleString()}")
    if isinstance(target, T.BooleanType) and isinstance(source, T.StringType | T.NumericType):
        out = _to_boolean(c, source)
    elif isinstance(target, T.IntegralType) and isinstance(source, T.StringType | T.NumericType | T.BooleanType):
        out = _to_integer(c, source, target)
    elif isinstance(target, _FLOATS) and isinstance(source, T.StringType | T.NumericType | T.BooleanType):
        out = nan_to_null(c.cast(target))
    elif isinstance(target, T.StringType) and isinstance(source, _FLOATS):
        out = _float_text(c)
    elif isinstance(target, _TIMES):
        out = _to_time(c, source, target)
    else:
        out = c.cast(target)
        if df is not None:
            try:
                df.select(out)
            except AnalysisException as e:
                raise CastError(str(e)) from e
    return out


def evaluate_type(value: Any) -> T.DataType:
    """The type of a constant."""
    if value is None:
        return T.NullType()
    return to_spark_type(type(value))


def cast(df: DataFrame | None, value: Any, target: Any, hint: Any = None) -> Any:
    """``cast_column``, or the value itself if ``value`` is a constant."""
    c = cast_column(df, value, target, hint)
    if is_column(value):
        return c
    from tessera.sources.outputs import cast_errors

    with cast_errors():
        return evaluate(c)


def cast_df(df: DataFrame, schema: Any, hints: Any = None) -> DataFrame:
    """``df`` projected on the schema's names, each column cast. ``hints`` is a schema of as many fields, taken by position."""
    fields = to_spark_schema(schema).fields
    read = [f.dataType for f in to_spark_schema(hints).fields] if hints is not None else [None] * len(fields)
    return df.select(*[cast_column(df, df[f"`{f.name}`"], f.dataType, h).alias(f.name) for f, h in zip(fields, read, strict=True)])

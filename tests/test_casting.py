import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tessera.errors import CastError
from tessera.functions.casting import cast, cast_df
from tessera.functions.types import arrow_type, column_type, ensure_compatible, schema_of, to_spark_schema, to_spark_type
from tessera.errors import IncompatibleFrameError
from tessera.sources.outputs import series_to_array
from tessera.testing import assert_rows

col = F.col


def run(spark, values, source, target):
    df = spark.createDataFrame([(v,) for v in values], f"x {source}")
    return series_to_array(df.select(cast(df, col("x"), target).alias("x")), "x")


@pytest.mark.parametrize(
    "values,source,target,want",
    [
        ([2.0, 0.0, math.nan, None, math.inf], "double", bool, [True, False, None, None, True]),
        ([0, -1, None], "bigint", bool, [False, True, None]),
        (["TRUE", "0", "1.0", "yes", "", None, "0.0"], "string", bool, [True, False, True, None, None, None, False]),
        ([True, False, None], "boolean", int, [1, 0, None]),
        ([1.9, -1.9, math.nan, None], "double", int, [1, -1, None, None]),
        (["1.1", "-2.2", "nan", "9007199254740993", None], "string", int, [1, -2, None, 9007199254740993, None]),
        (["1.5", "naN", "inf", "-inf", None], "string", float, [1.5, None, math.inf, -math.inf, None]),
        ([True, None], "boolean", float, [1.0, None]),
        ([True, False, None], "boolean", str, ["true", "false", None]),
        ([10, None, -3], "bigint", str, ["10", None, "-3"]),
        (
            [10.0, 1.5, math.inf, -math.inf, math.nan, None, 1e10, 1e16, 1.5e-5, 0.00012, 123456789.25, 0.0, 1e300, -2.5e7],
            "double", str,
            ["10.0", "1.5", "inf", "-inf", None, None, "10000000000.0", "1e+16", "1.5e-05", "0.00012", "123456789.25", "0.0", "1e+300", "-25000000.0"],
        ),
        (["2020-01-02", "nat", "NaN", "", None], "string", "date", [dt.date(2020, 1, 2), None, None, None, None]),
        (["2020-01-02 03:04:05", "2020-01-02", "NaT"], "string", dt.datetime, [dt.datetime(2020, 1, 2, 3, 4, 5), dt.datetime(2020, 1, 2), None]),
        ([dt.datetime(2020, 1, 2), None], "timestamp_ntz", str, ["2020-01-02 00:00:00", None]),
        ([dt.datetime(2020, 1, 2, 3)], "timestamp_ntz", dt.date, [dt.date(2020, 1, 2)]),
        ([dt.date(2020, 1, 2)], "date", str, ["2020-01-02"]),
        ([1, 2], "int", "int", [1, 2]),
        ([1], "bigint", "float32", [1.0]),
    ],
)
def test_matrix(spark, values, source, target, want):
    assert run(spark, values, source, target) == want


@pytest.mark.parametrize(
    "value,source,target",
    [
        (dt.datetime(2020, 1, 1), "timestamp_ntz", bool), (dt.date(2020, 1, 1), "date", int), (1, "int", "date"), (True, "boolean", dt.datetime),
        (math.inf, "double", int), ("x", "string", int), ("x", "string", float), (300, "bigint", "int8"), ([1], "array<int>", int),
    ],
)
def test_errors(spark, value, source, target):
    with pytest.raises(CastError):
        run(spark, [value], source, target)


def test_constants_and_hints(spark):
    assert cast(None, -10, bool) is True and cast(None, None, int) is None and cast(None, "1.1", int) == 1
    assert cast(None, -10, bool, str) is None and cast(None, 1.0, str, int) == "1"
    with pytest.raises(CastError):
        cast(None, "x", int)


def test_cast_df(spark):
    df = spark.createDataFrame([(1, "2", 3.0)], "a int, b string, c double")
    out = cast_df(df, "c:str,b:long")
    assert_rows(out, [("3.0", 2)], ["c", "b"])
    assert_rows(cast_df(df, "c:str", "c:long"), [("3",)])


def test_types(spark):
    import numpy as np
    import pyarrow as pa

    for kind, want in ((int, "bigint"), ("int", "int"), ("long", "bigint"), (str, "string"), ("float32", "float"), (np.dtype("float64"), "double"), (pa.uint8(), "smallint"), (pa.uint64(), "decimal(20,0)"), (np.dtype("datetime64[ns]"), "timestamp_ntz"), (np.dtype(object), "string"), (pa.timestamp("ns", "UTC"), "timestamp_ntz"), ("array<int>", "array<int>")):
        assert to_spark_type(kind).simpleString() == want
    with pytest.raises(TypeError):
        to_spark_type("no type at all")
    df = spark.createDataFrame([(1, "a")], "a int, b string")
    assert column_type(df, col("a") + 1).simpleString() == "int" and column_type(df, 1.5).simpleString() == "double" and column_type(df, None).simpleString() == "void"
    assert arrow_type(df, col("b")) == pa.string() and schema_of(df).names == ["a", "b"] and to_spark_schema("a:str,b:datetime").names == ["a", "b"]
    with pytest.raises(IncompatibleFrameError):
        ensure_compatible(df.select("a", col("b").alias("a")))

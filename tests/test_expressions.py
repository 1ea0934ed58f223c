import math

import pytest
from pyspark.sql import functions as F

from tessera.errors import InvalidOperationError
from tessera.functions import expressions as e
from tessera.functions.patterns import like, normal_pattern, pattern_tokens
from tessera.functions.values import clean, constant, evaluate, is_column, truthy
from tessera.testing import assert_duck_eq, assert_rows, make_rand_df

col = F.col
NULL = None


@pytest.fixture(scope="module")
def bools(spark):
    v = [True, False, None]
    return spark.createDataFrame([(a, b) for a in v for b in v], "a boolean, b boolean")


def test_kleene_tables(bools):
    got = bools.select("a", "b", e.logical(bools, col("a"), col("b"), "and"), e.logical(bools, col("a"), col("b"), "or"), e.logical_not(bools, col("a")))

    def both(a, b):
        return False if a is False or b is False else None if a is None or b is None else True

    def either(a, b):
        return True if a or b else None if a is None or b is None else False

    rows = [(a, b, both(a, b), either(a, b), None if a is None else not a) for a in (True, False, None) for b in (True, False, None)]
    assert_rows(got, rows)


@pytest.mark.parametrize("a", [True, False, None])
@pytest.mark.parametrize("b", [True, False, None])
def test_constants_in_constant_out(spark, a, b):
    assert e.logical(None, a, b, "and") == (False if a is False or b is False else None if None in (a, b) else True)
    assert e.logical(None, a, b, "or") == (True if a or b else None if None in (a, b) else False)


def test_scalar_results(spark):
    assert e.binary_arithmetic(1, 2, "/") == 0.5 and e.binary_arithmetic(1, None, "+") is None and e.binary_arithmetic(1.0, 0.0, "/") is None
    assert e.unary_arithmetic(3, "-") == -3 and e.unary_arithmetic(3, "+") == 3
    assert e.compare(1, None, "==") is None and e.compare(2, 1, ">") is True and e.compare(None, None, "==") is None
    assert e.coalesce(None, float("nan"), 3.0) == 3.0 and e.coalesce(None, None) is None
    assert e.case_when(None, (None, 1), (0, 2), (5, 3), default=4) == 3 and e.case_when(None, (False, 1)) is None
    assert e.is_in(1, [1, None]) is True and e.is_in(2, [1, None]) is None and e.is_in(2, []) is False and e.is_in(2, [], False) is True and e.is_in(None, []) is None
    assert e.is_between(5, None, 3) is False and e.is_between(1, None, 3) is None and e.is_between(2, 1, 3) is True and e.is_between(2, 1, 3, False) is False
    assert e.is_value(None, None, None) is True and e.is_value(None, 1, True) is True and e.is_value(None, 0, False) is True and e.is_value(None, None, False, False) is True
    assert like("abc", "a%") is True and like("abc", "a%", positive=False) is False and like(None, "a") is None and like("a", None) is None
    for bad in (lambda: e.compare(1, 2, "~"), lambda: e.binary_arithmetic(1, 2, "%"), lambda: e.unary_arithmetic(1, "~"), lambda: e.logical(None, True, True, "xor"), lambda: e.is_value(None, 1, 5), lambda: like("a", 3)):
        with pytest.raises(NotImplementedError):
            bad()


def test_nan_is_null(spark):
    df = clean(spark.createDataFrame([(1.0, 1), (math.nan, 2), (None, None)], "x double, n int"))
    assert_rows(df, [(1.0, 1), (None, 2), (None, None)])
    assert_rows(df.select(e.compare(col("x"), col("x"), "=="), e.is_value(df, col("x"), None)), [(True, False), (None, True), (None, True)])
    inf = spark.createDataFrame([(math.inf,)], "x double")
    assert_rows(inf.select(e.binary_arithmetic(col("x"), col("x"), "-")), [(None,)])


def test_truth_of_numbers(spark):
    df = spark.createDataFrame([(0, 0.0, "a"), (2, math.nan, "b"), (None, 0.5, None)], "i int, d double, s string")
    assert_rows(df.select(truthy(df, col("i")), truthy(df, col("d"))), [(False, False), (True, None), (None, True)])
    with pytest.raises(InvalidOperationError):
        truthy(df, col("s"))
    with pytest.raises(InvalidOperationError):
        truthy(df, "x")
    assert evaluate(truthy(df, math.nan)) is None and is_column(constant(1, "long", "x"))


def test_pattern_tokens():
    assert pattern_tokens("") == [] and pattern_tokens("a%%b_") == ["=a", "%", "=b", "_"] and pattern_tokens("%_%") == ["%", "_", "%"]
    assert pattern_tokens(r"\%a\_\\") == ["=%a_\\"] and pattern_tokens("a\\") == ["=a\\"] and pattern_tokens(r"\a%") == ["=a", "%"]
    assert normal_pattern(r"\a\%b\\") == r"a\%b\\" and normal_pattern("x\\") == "x\\\\"


def test_like(spark):
    df = spark.createDataFrame([("abc",), ("a.c",), ("a%c",), ("",), (None,), ("A\nC",)], "s string")
    assert_rows(df.where(like(col("s"), "%a.c%")), [("a.c",)])
    assert_rows(df.where(like(col("s"), r"a\%c")), [("a%c",)])
    assert_rows(df.where(like(col("s"), "a_c", ignore_case=True)), [("abc",), ("a.c",), ("a%c",), ("A\nC",)])
    assert_rows(df.where(like(col("s"), "a%", positive=False)), [("",), ("A\nC",)])
    assert_rows(df.where(like(col("s"), "_%")), [("abc",), ("a.c",), ("a%c",), ("A\nC",)])


@pytest.mark.parametrize("kind", ["float", "bool", "int", "str", "datetime"])
def test_coalesce_and_in_against_duckdb(spark, kind):
    df = make_rand_df(spark, 100, a=(kind, 50), b=(kind, 50), c=(kind, 50)).cache()
    got = df.select(e.coalesce(col("a"), col("b"), col("c")).alias("x"), e.is_in(col("a"), [col("b"), col("c")]).alias("y"), e.is_in(col("a"), [col("b"), None], False).alias("z"))
    assert_duck_eq(got, "SELECT coalesce(a,b,c) AS x, a IN (b,c) AS y, a NOT IN (b,NULL) AS z FROM t", t=df)


def test_between_and_case_against_duckdb(spark):
    df = make_rand_df(spark, 100, a=("float", 20), b=("float", 20), c=("float", 20), p=("bool", 30), q=("bool", 30)).cache()
    got = df.select(
        e.is_between(col("a"), col("b"), col("c")).alias("x"), e.is_between(col("a"), 0.2, 0.7, False).alias("y"),
        e.case_when(df, (col("p"), col("a")), (col("q"), col("b")), default=col("c")).alias("z"),
    )
    assert_duck_eq(got, "SELECT a BETWEEN b AND c AS x, a NOT BETWEEN 0.2 AND 0.7 AS y, CASE WHEN p THEN a WHEN q THEN b ELSE c END AS z FROM t", t=df)

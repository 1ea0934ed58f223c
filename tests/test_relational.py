import datetime as dt
import math

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import testing
from tessera.errors import InvalidOperationError
from tessera.functions.expressions import compare
from tessera.operators.grouped import sql_groupby_apply
from tessera.operators import grouped
from tessera.operators import relational as r
from tessera.operators.relational import cols_to_df, drop_duplicates, except_df, filter_df, intersect, join, parse_join_type, union
from tessera.sources.outputs import as_array, as_arrow, as_pandas, empty, read_local, series_to_array, to_series
from tessera.testing import assert_duck_eq, assert_rows, make_rand_df

col = F.col


def test_filter(spark):
    df = spark.createDataFrame([(1, 0.5), (0, None), (None, math.nan)], "i int, d double")
    assert_rows(filter_df(df, col("i")), [(1, 0.5)])
    assert_rows(filter_df(df, col("d")), [(1, 0.5)])
    assert filter_df(df, True).count() == 3 and filter_df(df, None).count() == 0 and filter_df(df, False).count() == 0


def test_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = filter_df(df, compare(col("l_quantity"), 5, ">")).select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity" in plan and "Python" not in plan


def test_distinct_and_sets(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 1.0), (None, math.nan), (None, None)], "a int, b double")
    assert_rows(drop_duplicates(a), [(1, 1.0), (None, None)])
    b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "x int, y double")
    assert_rows(union(a, b, True), [(1, 1.0), (2, 2.0), (None, None)], ["a", "b"])
    assert union(a, b, False).count() == 6
    assert_rows(intersect(a, b, True), [(1, 1.0)])
    assert_rows(intersect(a, b, False), [(1, 1.0), (1, 1.0)])
    assert_rows(except_df(a, b, True), [(None, None)])
    assert_rows(except_df(a, b, False), [(None, None), (None, None)])
    assert "NestedLoop" not in except_df(a, b, False)._jdf.queryExecution().executedPlan().toString()
    for f in (union, intersect, except_df):
        with pytest.raises(ValueError):
            f(a, b.select("x"), True)


@pytest.mark.parametrize("kind", ["inner", "left_outer", "right_outer", "full_outer", "left_semi", "left_anti"])
def test_joins_against_duckdb(spark, kind):
    a = make_rand_df(spark, 100, a=("int", 40), b=("datetime", 40), c=("float", 40)).cache()
    b = make_rand_df(spark, 80, seed=1, d=("float", 10), a=("int", 10), b=("datetime", 10)).cache()
    got = join(a, b, kind, ["a", "b"])
    if kind == "left_semi" or kind == "left_anti":
        sql = f"SELECT * FROM x WHERE {'NOT' * (kind == 'left_anti')} EXISTS (SELECT 1 FROM y WHERE x.a = y.a AND x.b = y.b)"
    else:
        sql = f"SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, c, d FROM x {kind.replace('_outer', '')} JOIN y ON x.a = y.a AND x.b = y.b"
    assert_duck_eq(got, sql, x=a, y=b)


def test_join_layout(spark):
    a = spark.createDataFrame([(1, 2, 3)], "v int, k int, w int")
    b = spark.createDataFrame([(2, 5, 6)], "k int, v int, z int")
    assert_rows(join(a, b, "inner", ["k"]), [(1, 2, 3, 5, 6)], ["v_x", "k", "w", "v_y", "z"])
    assert_rows(join(a, b, "outer", ["k"]), [(1, 2, 3, 5, 6)])
    assert_rows(join(a.select("v"), b.select("z"), "cross", []), [(1, 6)])
    with pytest.raises(ValueError):
        join(a, b, "cross", ["k"])
    with pytest.raises(ValueError):
        join(a, b, "inner", [])
    c = spark.createDataFrame([(2, 7)], "k int, q int")
    assert_rows(join(join(a, b, "inner", ["k"]), c, "left", ["k"]), [(1, 2, 3, 5, 6, 7)])


def test_join_names():
    for raw, want in (("INNER", "inner"), ("Left Semi", "left_semi"), ("semi", "left_semi"), ("left_anti", "left_anti"), ("LEFT", "left_outer"), ("rightOuter", "right_outer"), ("full", "full_outer"), ("outer", "full_outer"), ("cross", "cross")):
        assert parse_join_type(raw) == want
    with pytest.raises(NotImplementedError):
        parse_join_type("right semi")


def test_cols_to_df(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert_rows(cols_to_df(df, [col("a"), 2, "x"], ["p", "q", "r"]), [(1, 2, "x")], ["p", "q", "r"])
    with pytest.raises(InvalidOperationError):
        cols_to_df(df, [1, 2], ["a", "b"])


def test_group_apply(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", None)], "k string, v int")
    seen = lambda g: g.assign(n=len(g), i=g.index)[["k", "n", "i"]]
    got = sql_groupby_apply(df, ["k"], seen, "k:str,n:long,i:long")
    assert_rows(got, [("a", 2, 0), ("a", 2, 1), (None, 2, 0), (None, 2, 1), ("b", 1, 0)])
    assert_rows(sql_groupby_apply(df, [], lambda g: pd.DataFrame({"n": [len(g)]}), "n:long"), [(5,)])
    with pytest.raises(ValueError):
        sql_groupby_apply(df, ["k"], seen, None)


def test_outputs(spark):
    df = spark.createDataFrame([(1, "a", dt.datetime(2020, 1, 2)), (None, None, None)], "a int, b string, c timestamp_ntz")
    assert as_array(df) == [[1, "a", dt.datetime(2020, 1, 2)], [None, None, None]]
    assert as_array(df, "b:str,a:long") == [["a", 1], [None, None]] and as_array(df, columns=["a"]) == [[1], [None]]
    assert as_arrow(df, pa.schema([("a", pa.int64())])).to_pydict() == {"a": [1, None]} and len(as_pandas(df)) == 2
    assert not empty(df) and empty(df.limit(0)) and series_to_array(df, "b") == ["a", None]
    with pytest.raises(pa.ArrowInvalid):
        as_arrow(spark.createDataFrame([(1.5,)], "a double"), pa.schema([("a", pa.int64())]))


def test_nested_json(spark):
    df = spark.createDataFrame([(['{"a": 1, "b": ["1", 2]}'],), (None,)], "x array<string>")
    from pyspark.sql import types as T

    want = T.StructType([T.StructField("x", T._parse_datatype_string("array<struct<a:string,b:array<int>,c:int>>"))])
    assert as_array(df, want) == [[[{"a": "1", "b": [1, 2], "c": None}]], [None]]


def test_local_data(spark):
    assert_rows(read_local(spark, pd.DataFrame({"a": [1.0, math.nan], "b": ["x", None]})), [(1.0, "x"), (None, None)])
    assert_rows(read_local(spark, pa.table({"a": pa.array([1, 255], pa.uint8())})), [(1,), (255,)])
    assert_rows(read_local(spark, [(1, math.nan)], "a:long,b:double"), [(1, None)])
    assert_rows(to_series(spark, [1, None, 3], "x", int), [(0, 1), (1, None), (2, 3)], ["position", "x"])
    with pytest.raises(ValueError):
        read_local(spark, pd.DataFrame([[1, 2]]))


def test_expressions_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, 5.0), (2, None), (3, 0.5)], "a int, b double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a int, b double").parquet(str(tmp_path / "in"))
    out = filter_df(stream, compare(col("b"), 1, ">"))
    q = out.writeStream.format("memory").queryName("kept").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert_rows(spark.table("kept"), [(1, 5.0)])


def test_constants_that_are_no_conditions(spark):

    df = spark.range(3)
    assert r.filter_df(df, 1).count() == 3 and r.filter_df(df, 0).count() == r.filter_df(df, None).count() == 0
    with pytest.raises(InvalidOperationError):
        r.filter_df(df, "false")
    with pytest.raises(InvalidOperationError):
        r.filter_df(df, F.lit("x"))


def test_series_and_foreign_columns(spark):
    from tessera.sources import outputs as out

    a, b = out.to_series(spark, [1, None, 3], "a", int), out.to_series(spark, ["x", "y"], "b")
    assert_rows(r.series_to_df(a, b), [(1, "x"), (None, "y"), (3, None)], ["a", "b"])
    with pytest.raises(InvalidOperationError):
        r.cols_to_df(spark.range(1), [F.col("other")])
    with pytest.raises(InvalidOperationError):
        r.series_to_df(spark.range(1))


def test_hints_of_another_length(spark):
    from tessera.functions.casting import cast_df

    df = spark.createDataFrame([("1", "2")], "a string, b string")
    with pytest.raises(ValueError):
        cast_df(df, "a:int,b:int", "a:str")


def test_type_safe_arrays(spark):
    from tessera.sources import outputs as out

    rows = [[1, b"\x00\xff", 1.5, True, ["a", None]], [None, None, None, None, None]]
    df = spark.createDataFrame([tuple(x) for x in rows], "a bigint, b binary, c double, d boolean, e array<string>")
    assert out.as_array(df, type_safe=True) == rows
    assert out.as_array(out.read_local(spark, out.as_arrow(df)), type_safe=True) == rows


def test_groups_of_special_types(spark):
    import datetime as dt

    rows = [(dt.datetime(2021, 5, 1), b"x", None), (dt.datetime(2021, 5, 1), b"y", float("nan")), (None, b"z", 1.0)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, b binary, x double")
    got = grouped.sql_groupby_apply(df, ["t"], lambda g: g.head(1).assign(n=len(g))[["t", "n"]], "t:datetime,n:long")
    assert_rows(got, [(dt.datetime(2021, 5, 1), 2), (None, 1)])
    got = grouped.sql_groupby_apply(df, ["x"], lambda g: g.head(1).assign(n=len(g))[["x", "n"]], "x:double,n:long")
    assert_rows(got, [(None, 2), (1.0, 1)])


def test_frame_comparison(spark):
    a = spark.createDataFrame([(1, 0.12344), (2, None)], "a int, b double")
    b = spark.createDataFrame([(0.12341, 1), (float("nan"), 2)], "b double, a int")
    testing.assert_frame_eq(a, b, digits=4, check_columns=False, check_order=True, check_types=True)
    for wrong in ({"digits": 5}, {"check_columns": True}):
        with pytest.raises(AssertionError):
            testing.assert_frame_eq(a, b, **{"digits": 4, "check_columns": False, **wrong})


def test_scan_of_likely_rows(spark, tmp_path):
    from tessera.sources import outputs as out

    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1.0,), (7.0,), (float("nan"),)], "x double").write.parquet(path)
    got = r.filter_df(out.table(spark, str(tmp_path), "t", F.col("x") > 5), F.col("x") > 5)
    assert_rows(got, [(7.0,)])
    assert "GreaterThan(x,5.0)" in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("kind", ["inner", "left_outer", "right_outer", "full_outer"])
def test_crowded_joins(spark, kind, monkeypatch):
    """Tiles of a few rows give each pair once, and the rows without a match once; keys of two columns, NULLs and repeated rows too."""
    monkeypatch.setattr(r, "_TILE", 3)
    a = make_rand_df(spark, 120, a=("int", 40), b=("datetime", 40), c=("float", 40)).withColumn("a", F.col("a") % 3)
    a = a.withColumn("b", F.when(F.col("b").isNotNull(), F.lit("x"))).unionAll(spark.createDataFrame([(7, "y", 0.5)] * 9, "a int, b string, c double")).cache()
    b = make_rand_df(spark, 80, seed=1, d=("float", 10), a=("int", 10)).selectExpr("d", "a % 4 + 1 AS a", "'x' AS b").cache()
    sql = f"SELECT coalesce(x.a, y.a) AS a, coalesce(x.b, y.b) AS b, c, d FROM x {kind.replace('_outer', '')} JOIN y ON x.a = y.a AND x.b = y.b"
    assert_duck_eq(join(a, b, kind, ["a", "b"], crowded=True), sql, x=a, y=b)


def test_pairs_of_a_crowded_key_go_to_many_tasks(spark):
    """One key of two large groups: no partition of an inner join has all pairs."""
    a, b = (spark.range(9000).select(F.lit(1).alias("k"), F.col("id").alias(c)) for c in "xy")
    got = join(a, b.limit(5), "inner", ["k"], crowded=True).groupBy(F.spark_partition_id()).count().collect()
    assert sum(n for _, n in got) == 45_000 and len(got) > 1


def test_full_outer_join_holds_no_pairs(spark):
    """Spark's own full outer join puts all pairs of a key in a list before it hands on the first."""
    a = spark.createDataFrame([(1, 2)], "k int, v int")
    assert "FullOuter" not in join(a, a.toDF("k", "w"), "full", ["k"])._jdf.queryExecution().optimizedPlan().toString()


def test_large_groups_come_in_pieces(spark, monkeypatch):
    """No call has more rows than a piece, NULL and NaN are one group, and every row counts once."""
    monkeypatch.setattr(grouped, "_PIECE", 100)
    df = spark.range(0, 5000, 1, 3).select(F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).when(F.col("id") % 3 == 1, 2.5).alias("x"), (F.col("id") + 2**53).alias("_piece"))

    def part(g):
        assert len(g) <= 100 and list(g.columns) == ["x", "_piece"] and list(g.index) == list(range(len(g)))
        return g.head(1).assign(n=len(g), most=g["_piece"].max())[["x", "n", "most"]]

    def merge(g):
        return g.head(1).assign(n=g["n"].sum(), most=g["most"].max())

    got = grouped.sql_groupby_fold(df, ["x"], part, merge, "x:double,n:long,most:long")
    assert_rows(got, [(None, 3333, 2**53 + 4998), (2.5, 1667, 2**53 + 4999)])
    assert grouped.sql_groupby_fold(df.limit(0), ["x"], part, merge, "x:double,n:long,most:long").isEmpty()
    with pytest.raises(ValueError):
        grouped.sql_groupby_fold(df, [], part, merge, "n:long")


@pytest.mark.parametrize("name", ["group_apply", "nan_group_apply"])
def test_group_queries_never_hold_a_group(spark, name):
    """All of a group's rows go to Python in pieces."""
    from tessera.plans import queries

    plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "_piece" in plan

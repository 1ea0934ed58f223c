"""The registered queries, one or more for each operator, and the same in DuckDB SQL.

The tables have no NULLs, so the fixtures put some in: ``L`` from lineitem, ``C`` and ``S`` from customer and
supplier.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import casting as k
from tessera.functions import expressions as e
from tessera.functions import types as t_
from tessera.functions.patterns import like
from tessera.functions.values import constant, is_column
from tessera.operators import grouped
from tessera.operators import relational as r
from tessera.sources import outputs as out
from tessera.sources.outputs import tables
from tessera.testing import assert_duck_eq, assert_frame_eq, make_rand_df

col = F.col


def lines(spark, d: str) -> DataFrame:
    (t,) = tables(spark, d, "lineitem")
    null = lambda c, when: F.when(~when, col(c))
    a = null("l_quantity", col("l_linenumber") == 3).cast("double")
    b = null("l_discount", col("l_orderkey") % 5 == 0).cast("double")
    return t.select(
        col("l_orderkey").cast("bigint").alias("k"), col("l_linenumber").cast("bigint").alias("ln"), a.alias("a"), b.alias("b"),
        null("l_tax", col("l_partkey") % 7 == 0).cast("double").alias("c"), (a > 25).alias("p"),
        F.when(b.isNotNull(), col("l_returnflag") == "R").alias("q"), F.when(b.isNotNull(), col("l_returnflag")).alias("s"),
    )


def customers(spark, d: str) -> DataFrame:
    (t,) = tables(spark, d, "customer")
    return t.select(col("c_custkey").cast("bigint").alias("ck"), F.when(col("c_custkey") % 10 != 0, col("c_nationkey")).cast("bigint").alias("nk"))


def suppliers(spark, d: str) -> DataFrame:
    (t,) = tables(spark, d, "supplier")
    return t.select(col("s_suppkey").cast("bigint").alias("sk"), F.when(col("s_suppkey") % 10 != 0, col("s_nationkey")).cast("bigint").alias("nk"))


_L = """WITH l AS (SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(l_linenumber AS BIGINT) AS ln,
  CASE WHEN l_linenumber <> 3 THEN CAST(l_quantity AS DOUBLE) END AS a, CASE WHEN l_orderkey % 5 <> 0 THEN CAST(l_discount AS DOUBLE) END AS b,
  CASE WHEN l_partkey % 7 <> 0 THEN CAST(l_tax AS DOUBLE) END AS c, CASE WHEN l_linenumber <> 3 THEN l_quantity > 25 END AS p,
  CASE WHEN l_orderkey % 5 <> 0 THEN l_returnflag = 'R' END AS q, CASE WHEN l_orderkey % 5 <> 0 THEN l_returnflag END AS s FROM lineitem) """
_CS = """WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS ck, CAST(CASE WHEN c_custkey % 10 <> 0 THEN c_nationkey END AS BIGINT) AS nk FROM customer),
  s AS (SELECT CAST(s_suppkey AS BIGINT) AS sk, CAST(CASE WHEN s_suppkey % 10 <> 0 THEN s_nationkey END AS BIGINT) AS nk FROM supplier) """

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _wide(spark, d: str, **cols) -> DataFrame:
    return lines(spark, d).select("k", "ln", *[v.alias(n) for n, v in cols.items()])


@query(
    """SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(l_linenumber AS BIGINT) AS ln, CASE WHEN l_quantity > 25 THEN 'large' WHEN l_quantity > 10 THEN 'medium' ELSE 'small' END AS size
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 5 AND o_orderpriority IN ('1-URGENT', '2-HIGH')"""
)
def flagship(spark, d):
    """Filter, join and CASE end to end: both filters reach the scans."""
    li, o = out.table(spark, d, "lineitem", col("l_quantity") > 5), out.table(spark, d, "orders")
    o = r.filter_df(o, e.is_in(col("o_orderpriority"), ["1-URGENT", "2-HIGH"])).select(col("o_orderkey").alias("k"))
    li = r.filter_df(li, e.compare(col("l_quantity"), 5, ">")).select(col("l_orderkey").alias("k"), col("l_linenumber").alias("ln"), "l_quantity")
    both = r.join(li, o, "inner", ["k"])
    q = col("l_quantity")
    size = e.case_when(both, (e.compare(q, 25, ">"), "large"), (e.compare(q, 10, ">"), "medium"), default="small")
    return both.select(col("k").cast("bigint").alias("k"), col("ln").cast("bigint").alias("ln"), size.alias("size"))


@query(_L + "SELECT k, ln, a + b AS v1, a - 1.5e0 AS v2, 2e0 * b AS v3, a / (b + 1e0) AS v4, 0 - a AS v5, a AS v6 FROM l")
def arithmetic(spark, d):
    a, b, x = col("a"), col("b"), e.binary_arithmetic
    return _wide(
        spark, d, v1=x(a, b, "+"), v2=x(a, 1.5, "-"), v3=x(2.0, b, "*"), v4=x(a, x(b, 1.0, "+"), "/"),
        v5=e.unary_arithmetic(a, "-"), v6=e.unary_arithmetic(a, "+"),
    )


@query(_L + "SELECT k, ln, a < b AS v1, a <= 20e0 AS v2, a = b AS v3, a <> b AS v4, s >= 'N' AS v5, a > 20e0 AS v6 FROM l")
def comparison(spark, d):
    a, b = col("a"), col("b")
    pairs = [(a, b, "<"), (a, 20.0, "<="), (a, b, "=="), (a, b, "!="), (col("s"), "N", ">="), (a, 20.0, ">")]
    return _wide(spark, d, **{f"v{i}": e.compare(*p) for i, p in enumerate(pairs, 1)})


@query(_L + "SELECT k, ln, p AND q AS v1, p OR q AS v2, NOT p AS v3, p AND CAST(NULL AS BOOLEAN) AS v4, p OR FALSE AS v5, (ln <> 0) AND (b <> 0) AS v6 FROM l")
def logic(spark, d):
    df, p, q = lines(spark, d), col("p"), col("q")
    v = [e.logical(df, p, q, "and"), e.logical(df, p, q, "or"), e.logical_not(df, p), e.logical(df, p, None, "and"), e.logical(df, p, False, "or"), e.logical(df, col("ln"), col("b"), "and")]
    return df.select("k", "ln", *[x.alias(f"v{i}") for i, x in enumerate(v, 1)])


@query(_L + "SELECT k, ln, a FROM l WHERE p")
def filter_rows(spark, d):
    return r.filter_df(lines(spark, d), col("p")).select("k", "ln", "a")


@query(_L + "SELECT k, ln, a IS NULL AS v1, a IS NOT NULL AS v2, p IS TRUE AS v3, p IS NOT TRUE AS v4, p IS FALSE AS v5, p IS NOT FALSE AS v6 FROM l")
def is_value(spark, d):
    df = lines(spark, d)
    v = [(col("a"), None), (col("a"), None, False), (col("p"), True), (col("p"), True, False), (col("p"), False), (col("p"), False, False)]
    return df.select("k", "ln", *[e.is_value(df, *x).alias(f"v{i}") for i, x in enumerate(v, 1)])


@query(_L + "SELECT k, ln, s IN ('N', 'R') AS v1, s NOT IN ('N', NULL) AS v2, a IN (b, c) AS v3, a NOT IN (b, c, NULL) AS v4, CASE WHEN s IS NOT NULL THEN FALSE END AS v5 FROM l")
def is_in(spark, d):
    s, a, b, c = map(col, "sabc")
    v = [(s, ["N", "R"]), (s, ["N", None], False), (a, [b, c]), (a, [b, c, None], False), (s, [])]
    return _wide(spark, d, **{f"v{i}": e.is_in(*x) for i, x in enumerate(v, 1)})


@query(_L + "SELECT k, ln, a BETWEEN b AND c AS v1, c NOT BETWEEN b AND a AS v2, a BETWEEN NULL AND c AS v3, a BETWEEN 10e0 AND 20e0 AS v4 FROM l")
def is_between(spark, d):
    a, b, c = map(col, "abc")
    return _wide(spark, d, v1=e.is_between(a, b, c), v2=e.is_between(c, b, a, False), v3=e.is_between(a, None, c), v4=e.is_between(a, 10.0, 20.0))


@query(_L + "SELECT k, ln, coalesce(a, b, c) AS v1, coalesce(NULL, b, -1e0) AS v2 FROM l")
def coalesce(spark, d):
    return _wide(spark, d, v1=e.coalesce(col("a"), col("b"), col("c")), v2=e.coalesce(None, col("b"), -1.0))


@query(_L + "SELECT k, ln, CASE WHEN p THEN a WHEN q THEN b ELSE c END AS v1, CASE WHEN p THEN s END AS v2, CASE WHEN b <> 0 THEN 'x' WHEN NULL THEN 'y' ELSE s END AS v3 FROM l")
def case_when(spark, d):
    df, p, q = lines(spark, d), col("p"), col("q")
    v1 = e.case_when(df, (p, col("a")), (q, col("b")), default=col("c"))
    v3 = e.case_when(df, (col("b"), "x"), (None, "y"), default=col("s"))
    return df.select("k", "ln", v1.alias("v1"), e.case_when(df, (p, col("s"))).alias("v2"), v3.alias("v3"))


_PATTERNS = ["c%", "%WIDGET", "%l%", "_o%", "%", "", "_%", "c%t", r"\c%%"]


@query(
    "SELECT CAST(p_partkey AS BIGINT) AS pk, p_name LIKE 'c%' AS v1, p_name ILIKE '%WIDGET' AS v2, p_name NOT LIKE '%l%' AS v3, p_name LIKE '_o%' AS v4,"
    " p_name LIKE '%' AS v5, p_name LIKE '' AS v6, p_name LIKE '_%' AS v7, p_name LIKE 'c%t' AS v8, p_name LIKE 'c%' AS v9 FROM part"
)
def like_patterns(spark, d):
    (t,) = tables(spark, d, "part")
    v = [like(col("p_name"), x, ignore_case=i == 2, positive=i != 3).alias(f"v{i}") for i, x in enumerate(_PATTERNS, 1)]
    return t.select(col("p_partkey").cast("bigint").alias("pk"), *v)


@query(
    _L + """SELECT k, ln, CAST(p AS BIGINT) AS v1, CAST(p AS DOUBLE) AS v2, CAST(p AS VARCHAR) AS v3, CAST(ln AS DOUBLE) AS v4, CAST(ln AS VARCHAR) AS v5,
    (b * 100) <> 0 AS v6, CAST(trunc(a / 3e0) AS BIGINT) AS v7, CASE WHEN s = 'R' THEN TRUE WHEN s = 'N' THEN FALSE END AS v8, CAST(ln AS BIGINT) AS v9 FROM l"""
)
def cast_values(spark, d):
    df = lines(spark, d).withColumn("t", F.when(col("s") == "R", "TRUE").when(col("s") == "N", "0.0").otherwise(col("s")))
    df = df.withColumn("h", col("b") * 100).withColumn("f", col("a") / 3).withColumn("n", col("ln").cast("string"))
    to = [("p", int), ("p", float), ("p", str), ("ln", float), ("ln", str), ("h", bool), ("f", int), ("t", bool), ("n", int)]
    return df.select("k", "ln", *[k.cast(df, col(c), t).alias(f"v{i}") for i, (c, t) in enumerate(to, 1)])


@query(
    "SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_orderdate AS DATE) AS v1, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS v2,"
    " CAST(o_orderdate AS DATE) AS v3, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS v4 FROM orders"
)
def cast_times(spark, d):
    (t,) = tables(spark, d, "orders")
    t = t.withColumn("at", col("o_orderdate").cast("timestamp_ntz")).withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    to = [("at", "date"), ("at", str), ("day", "date"), ("day", "datetime")]
    return t.select(col("o_orderkey").cast("bigint").alias("k"), *[k.cast(t, col(c), x).alias(f"v{i}") for i, (c, x) in enumerate(to, 1)])


@query(_L + "SELECT CAST(ln AS VARCHAR) AS ln, CAST(trunc(a) AS BIGINT) AS a, CAST(p AS VARCHAR) AS p FROM l")
def cast_frame(spark, d):
    return k.cast_df(lines(spark, d), "ln:str,a:long,p:str")


@query(_L + "SELECT k, ln, a AS x, 1.5e0 AS y, 'z' AS z FROM l")
def cols_to_df(spark, d):
    return r.cols_to_df(lines(spark, d), [col("k"), col("ln"), col("a"), 1.5, "z"], ["k", "ln", "x", "y", "z"])


@query(_L + "SELECT DISTINCT s, p FROM l")
def distinct(spark, d):
    return r.drop_duplicates(lines(spark, d).select("s", "p"))


def _keys(spark, d, few=False):
    s = suppliers(spark, d).select("nk")
    return customers(spark, d).select("nk"), s.where("nk < 10") if few else s


@query(_CS + "SELECT nk FROM c UNION SELECT nk FROM s")
def union(spark, d):
    return r.union(*_keys(spark, d), unique=True)


@query(_CS + "SELECT nk FROM c UNION ALL SELECT nk FROM s")
def union_all(spark, d):
    return r.union(*_keys(spark, d), unique=False)


@query(_CS + "SELECT nk FROM c INTERSECT SELECT nk FROM s WHERE nk < 10")
def intersect(spark, d):
    return r.intersect(*_keys(spark, d, True), unique=True)


@query(_CS + "SELECT nk FROM c WHERE EXISTS (SELECT 1 FROM s WHERE s.nk < 10 AND s.nk IS NOT DISTINCT FROM c.nk)")
def intersect_keep(spark, d):
    return r.intersect(*_keys(spark, d, True), unique=False)


@query(_CS + "SELECT nk FROM c EXCEPT SELECT nk FROM s WHERE nk < 10")
def except_rows(spark, d):
    return r.except_df(*_keys(spark, d, True), unique=True)


@query(_CS + "SELECT nk FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.nk < 10 AND s.nk IS NOT DISTINCT FROM c.nk)")
def except_keep(spark, d):
    return r.except_df(*_keys(spark, d, True), unique=False)


def _join(name: str, sql: str) -> None:
    """25 keys: every customer of a nation meets every supplier of it, so the result grows with the square of the tables."""

    def run(spark, d):
        return r.join(customers(spark, d), suppliers(spark, d), name, ["nk"], crowded=True)

    QUERIES[f"join_{name}"] = run
    SQL[f"join_{name}"] = _CS + sql


_join("inner", "SELECT ck, c.nk AS nk, sk FROM c JOIN s ON c.nk = s.nk")
_join("left_outer", "SELECT ck, c.nk AS nk, sk FROM c LEFT JOIN s ON c.nk = s.nk")
_join("right_outer", "SELECT ck, s.nk AS nk, sk FROM c RIGHT JOIN s ON c.nk = s.nk")
_join("full_outer", "SELECT ck, coalesce(c.nk, s.nk) AS nk, sk FROM c FULL JOIN s ON c.nk = s.nk")
_join("left_semi", "SELECT ck, nk FROM c WHERE EXISTS (SELECT 1 FROM s WHERE s.nk = c.nk)")
_join("left_anti", "SELECT ck, nk FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.nk = c.nk)")


@query("SELECT CAST(r_regionkey AS BIGINT) AS r, CAST(n_nationkey AS BIGINT) AS n FROM region, nation")
def join_cross(spark, d):
    a, b = tables(spark, d, "region", "nation")
    return r.join(a.select(col("r_regionkey").cast("bigint").alias("r")), b.select(col("n_nationkey").cast("bigint").alias("n")), "cross", [])


@query(_L + "SELECT k, ln, s, count(*) OVER (PARTITION BY s) AS n FROM l")
def group_apply(spark, d):
    """The sizes of groups by pieces, as a group may be a third of the table; its rows get them by a join."""

    def size(g: pd.DataFrame) -> pd.DataFrame:
        return g.head(1).assign(n=len(g))[["s", "n"]]

    li = lines(spark, d).select("k", "ln", "s")
    sizes = grouped.sql_groupby_fold(li.select("s"), ["s"], size, _sum_n, "s:str,n:long").withColumnRenamed("s", "of")
    return li.join(sizes, col("s").eqNullSafe(col("of"))).drop("of")


def _sum_n(g: pd.DataFrame) -> pd.DataFrame:
    return g.head(1).assign(n=g["n"].sum())


def _with_nan(spark, d: str) -> DataFrame:
    """``L`` with NaN in place of some values, as a source would bring them in."""
    nan = lambda c, when: F.when(when, F.lit(float("nan"))).otherwise(col(c)).alias(c)
    raw = lines(spark, d).select("k", "ln", nan("a", col("ln") == 2), nan("b", col("k") % 3 == 0), "c")
    return out.clean(raw)


_N = _L[:-1] + """, n AS (SELECT k, ln, CASE WHEN ln <> 2 THEN a END AS a, CASE WHEN k % 3 <> 0 THEN b END AS b, c FROM l) """


@query(_N + "SELECT k, ln, a > 5 AS v1, a = b AS v2, a IN (b, 1e0) AS v3, a BETWEEN b AND 30e0 AS v4, a IS NULL AS v5, coalesce(a, b, -1e0) AS v6, CASE WHEN a > 5 THEN a ELSE b END AS v7 FROM n")
def nan_is_null(spark, d):
    df, a, b = _with_nan(spark, d), col("a"), col("b")
    v = [e.compare(a, 5, ">"), e.compare(a, b, "=="), e.is_in(a, [b, 1.0]), e.is_between(a, b, 30.0), e.is_value(df, a, None), e.coalesce(a, b, -1.0)]
    v.append(e.case_when(df, (e.compare(a, 5, ">"), a), default=b))
    return df.select("k", "ln", *[x.alias(f"v{i}") for i, x in enumerate(v, 1)])


@query(_N + "SELECT k, ln, a FROM n WHERE a > 5")
def nan_filter(spark, d):
    return r.filter_df(_with_nan(spark, d), e.compare(col("a"), 5, ">")).select("k", "ln", "a")


@query(_N + "SELECT x.k AS k, x.a AS a, x.ln AS ln_x, y.ln AS ln_y FROM n x JOIN n y ON x.k = y.k AND x.a = y.a")
def nan_join(spark, d):
    df = _with_nan(spark, d).select("k", "a", "ln")
    return r.join(df, df, "inner", ["k", "a"])


@query(_N + "SELECT b, count(*) AS n FROM n GROUP BY b")
def nan_group_apply(spark, d):
    def size(g: pd.DataFrame) -> pd.DataFrame:
        return g.head(1).assign(n=len(g))[["b", "n"]]

    return grouped.sql_groupby_fold(_with_nan(spark, d).select("b"), ["b"], size, _sum_n, "b:double,n:long")


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, 2.5e0 AS x, TRUE AS y, CAST(NULL AS BIGINT) AS z FROM nation")
def constant_columns(spark, d):
    """to_constant_series and cols_to_df: constants of a type beside columns."""
    (n,) = tables(spark, d, "nation")
    cols = [col("n_nationkey").cast("bigint"), col("n_name"), constant(2.5), constant(True), constant(None, int)]
    return r.cols_to_df(n, cols, ["k", "name", "x", "y", "z"])


@query("SELECT CAST(s_suppkey AS BIGINT) AS k, CAST(s_nationkey AS BIGINT) AS n FROM supplier")
def series_by_position(spark, d):
    """to_series and series_to_array: columns to local arrays, and back to one frame by position."""
    (s,) = tables(spark, d, "supplier")
    s = s.select(col("s_suppkey").cast("bigint").alias("k"), col("s_nationkey").cast("bigint").alias("n")).orderBy("k")
    return r.series_to_df(out.to_series(spark, out.series_to_array(s, "k"), "k", int), out.to_series(spark, out.series_to_array(s, "n"), "n", int))


@query("SELECT * FROM (VALUES ('a', FALSE), ('column', TRUE)) AS v(value, is_series)")
def is_series(spark, d):
    return spark.createDataFrame([("a", is_column("a")), ("column", is_column(col("a")))], "value string, is_series boolean")


_ROUND = "SELECT CAST(s_suppkey AS BIGINT) AS k, s_name AS name, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_acctbal AS DOUBLE) END AS x, s_suppkey % 2 = 0 AS even FROM supplier"


def _round(spark, d: str) -> DataFrame:
    (s,) = tables(spark, d, "supplier")
    return s.select(
        col("s_suppkey").cast("bigint").alias("k"), col("s_name").alias("name"),
        F.when(col("s_suppkey") % 3 != 0, col("s_acctbal").cast("double")).alias("x"), (col("s_suppkey") % 2 == 0).alias("even"),
    )


@query(_ROUND)
def pandas_round_trip(spark, d):
    """as_pandas, and local pandas data as a frame."""
    return out.read_local(spark, out.as_pandas(_round(spark, d)))


@query(_ROUND)
def arrow_round_trip(spark, d):
    """to_schema and as_arrow of exactly these types, and an Arrow table as a frame."""
    df = _round(spark, d)
    return out.read_local(spark, out.as_arrow(df, t_.schema_of(df)))


@query(_ROUND)
def array_round_trip(spark, d):
    """as_array with type checks, and rows as a frame of a schema."""
    df = _round(spark, d)
    return out.read_local(spark, out.as_array(df, df.schema, type_safe=True), df.schema)


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, CAST(n_regionkey AS BIGINT) AS r1, CAST(n_regionkey + 1 AS BIGINT) AS r2 FROM nation")
def nested_arrays(spark, d):
    """as_array_iterable with nested columns out of JSON text."""
    (n,) = tables(spark, d, "nation")
    key = col("n_regionkey").cast("int")
    text = F.to_json(F.struct(col("n_name").alias("name"), F.array(key, key + 1).alias("r")))
    df = n.select(col("n_nationkey").cast("bigint").alias("k"), text.alias("j"))
    schema = t_.T.StructType([t_.T.StructField("k", t_.T.LongType()), t_.T.StructField("j", t_.T._parse_datatype_string("struct<name:string,r:array<bigint>>"))])
    rows = [(k, j["name"], *j["r"]) for k, j in out.as_array_iterable(df, schema, type_safe=True)]
    return spark.createDataFrame(rows, "k bigint, name string, r1 bigint, r2 bigint")


@query("SELECT count(*) = 0 AS all_empty, TRUE AS none_empty FROM lineitem")
def is_empty(spark, d):
    li = lines(spark, d)
    return spark.createDataFrame([(out.empty(li), out.empty(li.where("k is null")))], "all_empty boolean, none_empty boolean")


@query(
    "SELECT * FROM (VALUES ('k', 'int64', 'bigint'), ('name', 'string', 'string'), ('x', 'double', 'double'), ('even', 'bool', 'boolean')) AS v(name, arrow, spark)"
)
def schemas(spark, d):
    """to_schema, the types of columns and of the library's names, and the checks that a frame is compatible."""
    df = _round(spark, d)
    t_.ensure_compatible(df)
    assert t_.is_compatible_index(df)
    kinds = {f.name: str(f.type) for f in t_.schema_of(df)}
    assert all(str(t_.arrow_type(df, col(n))) == k for n, k in kinds.items())
    rows = [(n, k, t_.to_spark_type("str" if k == "string" else k).simpleString()) for n, k in kinds.items()]
    return spark.createDataFrame(rows, "name string, arrow string, spark string")


@query("SELECT CAST(500 AS BIGINT) AS n, CAST(40 AS BIGINT) AS nulls, TRUE AS equal")
def random_frames(spark, d):
    """make_rand_df with exact NULL counts, and the comparisons with frames and DuckDB."""
    a, b = (make_rand_df(spark, 500, seed=3, i=("int", 40), s="str", f="float", t="datetime") for _ in range(2))
    assert_frame_eq(a, b, digits=6, check_types=True)
    assert_duck_eq(a.groupBy("s").agg(F.count("*").alias("n")), "SELECT s, count(*) AS n FROM t GROUP BY s", t=a)
    return a.agg(F.count("*").alias("n"), F.count(F.when(col("i").isNull(), 1)).alias("nulls")).withColumn("equal", F.lit(True))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

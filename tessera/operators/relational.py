"""Filters, projections, set operations and joins."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidOperationError
from tessera.functions.values import as_column, clean, is_column, is_missing, truthy

_JOINS = {
    "inner": "inner", "join": "inner", "cross": "cross", "semi": "left_semi", "leftsemi": "left_semi", "anti": "left_anti",
    "leftanti": "left_anti", "left": "left_outer", "leftouter": "left_outer", "right": "right_outer", "rightouter": "right_outer",
    "outer": "full_outer", "full": "full_outer", "fullouter": "full_outer",
}


def filter_df(df: DataFrame, condition: Any) -> DataFrame:
    """Rows where the condition is true; a constant keeps all or none, one that is no condition raises. Filters reach the scan."""
    if not is_column(condition):
        truthy(df, condition)
        return df if not is_missing(condition) and bool(condition) else df.where(F.lit(False))
    return df.where(truthy(df, condition))


def cols_to_df(df: DataFrame, cols: list, names: list[str] | None = None) -> DataFrame:
    """A frame of columns of ``df`` and constants; at least one must be a column, and none of another frame."""
    if not any(is_column(c) for c in cols):
        raise InvalidOperationError("at least one must be a column")
    made = [as_column(c) for c in cols]
    if names is not None:
        made = [c.alias(n) for c, n in zip(made, names, strict=True)]
    try:
        return df.select(*made)
    except AnalysisException as e:
        raise InvalidOperationError(f"a column that the frame doesn't have: {e}") from e


def series_to_df(*series: DataFrame) -> DataFrame:
    """A frame of series (``to_series``) by position, in their order; a shorter one has NULLs at its end."""
    if not series:
        raise InvalidOperationError("at least one must be a series")
    if any(len(s.columns) != 2 or s.columns[0] != "position" for s in series):
        raise InvalidOperationError("a series has a position and a value")
    out = series[0]
    for s in series[1:]:
        out = out.join(s, "position", "full")
    return out.drop("position")


def drop_duplicates(df: DataFrame) -> DataFrame:
    """``SELECT DISTINCT``: NULLs, and NaN, are equal."""
    return clean(df).distinct()


def _aligned(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    if len(a.columns) != len(b.columns):
        raise ValueError(f"{len(a.columns)} columns on one side and {len(b.columns)} on the other")
    return clean(a), clean(b).toDF(*a.columns)


def union(a: DataFrame, b: DataFrame, unique: bool) -> DataFrame:
    """Rows of both, by position, under the names of the first; ``unique``: without repeats."""
    x, y = _aligned(a, b)
    out = x.union(y)
    return out.distinct() if unique else out


def _matched(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Null-safe semi or anti join on all columns; equality keys, so no nested loop and no dedupe of ``b``."""
    b = b.toDF(*[f"__other_{i}" for i in range(len(b.columns))])
    same = F.lit(True)
    for i, c in enumerate(a.columns):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"__other_{i}"))
    return a.join(b, same, how)


def intersect(a: DataFrame, b: DataFrame, unique: bool) -> DataFrame:
    """``INTERSECT``; not ``unique``: every row of ``a`` that occurs in ``b``, as often as it is in ``a``."""
    x, y = _aligned(a, b)
    return x.intersect(y) if unique else _matched(x, y, "left_semi")


def except_df(a: DataFrame, b: DataFrame, unique: bool) -> DataFrame:
    """``EXCEPT``; not ``unique``: every row of ``a`` that doesn't occur in ``b``, repeats included."""
    x, y = _aligned(a, b)
    return x.subtract(y) if unique else _matched(x, y, "left_anti")


def parse_join_type(name: str) -> str:
    """One of inner, cross, left_semi, left_anti, left_outer, right_outer, full_outer."""
    key = name.replace(" ", "").replace("_", "").lower()
    if key not in _JOINS:
        raise NotImplementedError(name)
    return _JOINS[key]


#: Rows of a key on either side that one task of a crowded join holds against each other.
_TILE = 4096


def _tiles(df: DataFrame, names: tuple[str, str], own: str, other: str) -> DataFrame:
    """``df`` dealt to the ``own`` parts of its key, and repeated for the ``other`` parts that the other side's rows are dealt to."""
    plain = [F.col(f"`{f.name}`") for f in df.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    # a hash, not a random number: a task that runs again must deal its rows as before
    mine = F.when(F.col(own) > 1, F.pmod(F.xxhash64(*plain), F.col(own))).otherwise(F.lit(0)).cast("bigint")
    return df.select("*", mine.alias(names[0])).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias(names[1])).drop(own, other)


def _crowded(a: DataFrame, b: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with two more keys, by which an inner join on all keys meets each pair of rows once, and no task more than a tile.

    The rows of a key are counted on both sides; each side is cut in parts of about ``_TILE`` rows of the key, and a row goes to
    all parts of the other side. The rows sent grow with the pairs divided by ``_TILE``.
    """
    i, j, p, q = (_fresh([*a.columns, *b.columns], x) for x in ("_i", "_j", "_p", "_q"))
    keys = [F.col(f"`{c}`") for c in on]
    part = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / _TILE).alias(name))
    parts = part(a, p).join(part(b, q), on)
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x, y = _tiles(a.join(parts, on), (i, j), p, q), _tiles(b.join(parts, on), (j, i), q, p)
    # a number of its own, as partitions that are merged by their bytes would not be even in pairs
    deal = lambda df: df.repartition(n, *keys, i, j)
    return deal(x), deal(y), [i, j]


def _fresh(taken: list[str], name: str) -> str:
    """``name``, longer until no column is called so."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _alone(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``a`` whose keys ``b`` doesn't have."""
    return a.join(b.select(*[F.col(f"`{c}`") for c in on]), on, "left_anti")


def join(a: DataFrame, b: DataFrame, how: str, on: list[str], crowded: bool = False) -> DataFrame:
    """Equality join on columns of both. NULL keys match nothing; the planner picks the strategy.

    The columns of ``a`` come first, in order, with the keys of both sides as one; then those of ``b`` that are
    no keys. Other names that both have get the endings ``_x`` and ``_y``.

    A full outer join is a left outer join and the rows of ``b`` without a match, as Spark's own holds all pairs of a key
    in memory. ``crowded``: few keys with many rows on both sides. Then the rows of each key are counted first, and its pairs are
    made in tiles by many tasks. Pairs grow with the square of the input for a fixed number of keys, so time and rows do.
    """
    kind = parse_join_type(how)
    if kind == "cross":
        if on:
            raise ValueError("a cross join has no keys")
    elif not on:
        raise ValueError(f"a {kind} join needs keys")
    if kind in ("left_semi", "left_anti"):
        return a.join(b, on, kind)
    rest_a, rest_b = [c for c in a.columns if c not in on], [c for c in b.columns if c not in on]
    both = set(rest_a) & set(rest_b)
    left = {c: f"{c}_x" if c in both else c for c in a.columns}
    right = {c: f"{c}_y" if c in both else c for c in rest_b}

    def paired(x: DataFrame, y: DataFrame, kind: str, keys: list[str]) -> DataFrame:
        x, y = x.alias("__a"), y.alias("__b")
        joined = x.crossJoin(y) if kind == "cross" else x.join(y, keys, kind)
        cols = [F.col(f"`{c}`") if c in on else F.col(f"__a.`{c}`").alias(n) for c, n in left.items()]
        return joined.select(*cols, *[F.col(f"__b.`{c}`").alias(n) for c, n in right.items()])

    if kind == "cross" or kind != "full_outer" and not crowded:
        return paired(a, b, kind, on)
    if crowded:
        x, y, more = _crowded(a, b, on)
        parts = [paired(x, y, "inner", [*on, *more])]
    else:
        parts = [paired(a, b, "left_outer", on)]
    if crowded and kind in ("left_outer", "full_outer"):
        parts.append(_alone(a, b, on).select(*[F.col(f"`{c}`").alias(n) for c, n in left.items()]))
    if kind in ("right_outer", "full_outer"):
        parts.append(_alone(b, a, on).select(*[F.col(f"`{c}`") for c in on], *[F.col(f"`{c}`").alias(n) for c, n in right.items()]))
    return reduce(lambda s, t: s.unionByName(t, allowMissingColumns=True), parts)

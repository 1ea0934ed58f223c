"""Applying a pandas function to groups."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.types import ensure_compatible, to_spark_schema
from tessera.functions.values import clean


def sql_groupby_apply(df: DataFrame, cols: list[str], func: Callable[[pd.DataFrame], pd.DataFrame], schema: Any) -> DataFrame:
    """``func`` of every group's rows, with all columns and a fresh index. NULL keys, and NaN, form one group.

    No columns: one call with all rows, so on one executor. An integer column with NULLs arrives as float. An
    empty frame gives no rows and no call. A group is in one Python process as a whole; see ``sql_groupby_fold`` for
    functions that can do with pieces. Only these two operators run Python on the executors.
    """
    if schema is None:
        raise ValueError("the result's schema is required")
    ensure_compatible(df)
    run = lambda pdf: func(pdf.reset_index(drop=True))
    return clean(df).groupBy(*cols).applyInPandas(run, to_spark_schema(schema))


#: Rows in a row of a partition that one call of ``sql_groupby_fold`` may get.
_PIECE = 50_000


def sql_groupby_fold(
    df: DataFrame, cols: list[str], part: Callable[[pd.DataFrame], pd.DataFrame], merge: Callable[[pd.DataFrame], pd.DataFrame], schema: Any
) -> DataFrame:
    """``sql_groupby_apply`` in two steps, for groups of any size: ``part`` of pieces of every group, then ``merge`` of what it gave.

    ``merge`` gets all rows that ``part`` gave for a group, with its keys, in any order; ``schema`` is that of both results and
    has the keys. A piece has ``_PIECE`` rows at most, so ``part`` should give a few rows, whatever their number.
    """
    if not cols:
        raise ValueError("the keys are required")
    if schema is None:
        raise ValueError("the result's schema is required")
    ensure_compatible(df)
    # the number of a row has its partition in the upper bits, so a piece is of one partition
    piece = "_piece"
    while piece.lower() in {c.lower() for c in df.columns}:
        piece += "_"
    rows = clean(df).withColumn(piece, F.floor(F.monotonically_increasing_id() / _PIECE))
    # a number of its own, as partitions merged by their bytes hold many rows of a few values
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols, piece)
    run = lambda pdf: part(pdf.drop(columns=piece).reset_index(drop=True))
    return sql_groupby_apply(rows.groupBy(*cols, piece).applyInPandas(run, to_spark_schema(schema)), cols, merge, schema)

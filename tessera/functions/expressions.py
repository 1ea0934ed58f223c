"""Arithmetic, comparison, logic and predicates with SQL's three-valued meaning.

Operands are columns or constants; if all are constants, a Python value is returned. Functions that
depend on the types of their operands take the frame first (None for constants).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import as_column, is_missing, nan_to_null, result, truthy


def unary_arithmetic(value: Any, op: str) -> Any:
    """``+`` or ``-``; minus is a subtraction from 0, so there is no negative zero."""
    if op == "+":
        return value
    if op == "-":
        return result(F.lit(0) - as_column(value), value)
    raise NotImplementedError(op)


def binary_arithmetic(a: Any, b: Any, op: str) -> Any:
    """``+ - * /``; NULL if a side is. Division is true division, and NULL for a zero divisor."""
    x, y = as_column(a), as_column(b)
    if is_missing(a) or is_missing(b):
        out = F.lit(None).cast("double")
    elif op == "+":
        out = nan_to_null(x + y)
    elif op == "-":
        out = nan_to_null(x - y)
    elif op == "*":
        out = nan_to_null(x * y)
    elif op == "/":
        out = nan_to_null(F.try_divide(x.cast("double"), y.cast("double")))
    else:
        raise NotImplementedError(op)
    return result(out, a, b)


def compare(a: Any, b: Any, op: str) -> Any:
    """``== != < <= > >=``; NULL if a side is."""
    x, y = as_column(a), as_column(b)
    ops = {
        "==": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y,
        "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y,
    }
    if op not in ops:
        raise NotImplementedError(op)
    return result(ops[op]().cast("boolean"), a, b)


def logical(df: DataFrame | None, a: Any, b: Any, op: str) -> Any:
    """``and`` or ``or`` by Kleene's tables."""
    if op not in ("and", "or"):
        raise NotImplementedError(op)
    x, y = truthy(df, a), truthy(df, b)
    return result(x & y if op == "and" else x | y, a, b)


def logical_not(df: DataFrame | None, value: Any) -> Any:
    return result(~truthy(df, value), value)


def is_value(df: DataFrame | None, value: Any, target: bool | None, positive: bool = True) -> Any:
    """``IS [NOT] NULL``, ``TRUE`` or ``FALSE``; never NULL."""
    if target is None:
        out = as_column(value).isNull()
    elif target is True:
        out = F.coalesce(truthy(df, value), F.lit(False))
    elif target is False:
        out = F.coalesce(~truthy(df, value), F.lit(False))
    else:
        raise NotImplementedError(f"IS {target!r}")
    return result(out if positive else ~out, value)


def is_in(value: Any, values: list, positive: bool = True) -> Any:
    """``[NOT] IN`` over constants and columns. An empty list holds nothing; NULL stays NULL."""
    c = as_column(value)
    if not values:
        out = F.when(c.isNotNull(), F.lit(not positive))
        return result(out, value)
    found = c.isin(*[as_column(v) for v in values])
    return result(found if positive else ~found, value, *values)


def is_between(value: Any, low: Any, high: Any, positive: bool = True) -> Any:
    """``[NOT] BETWEEN``; false if one bound says so, though the other is NULL."""
    found = (as_column(value) >= as_column(low)) & (as_column(value) <= as_column(high))
    return result(found if positive else ~found, value, low, high)


def coalesce(*values: Any) -> Any:
    """The first operand that isn't NULL."""
    return result(F.coalesce(*[as_column(v) for v in values]), *values)


def case_when(df: DataFrame | None, *pairs: tuple[Any, Any], default: Any = None) -> Any:
    """``CASE``: the value of the first condition that is true. NULL and 0 aren't."""
    out: Column | None = None
    for condition, value in pairs:
        test, then = truthy(df, condition), as_column(value)
        out = F.when(test, then) if out is None else out.when(test, then)
    out = as_column(default) if out is None else out.otherwise(as_column(default))
    return result(out, default, *[x for p in pairs for x in p])

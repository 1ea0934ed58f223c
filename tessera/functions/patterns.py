"""LIKE patterns."""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F

from tessera.functions.values import as_column, is_missing, result


def pattern_tokens(pattern: str) -> list[str]:
    """The pattern's wildcards ``%`` and ``_`` and its literal runs, these with a leading ``=``.

    A backslash makes the next character literal, whichever it is; at the end it stands for itself.
    Repeated ``%`` count once.
    """
    tokens: list[str] = []
    literal, escaped = "", False

    def close() -> None:
        nonlocal literal
        if literal:
            tokens.append(f"={literal}")
            literal = ""

    for c in pattern:
        if escaped or c not in "%_\\":
            literal, escaped = literal + c, False
        elif c == "\\":
            escaped = True
        else:
            close()
            if c == "_" or tokens[-1:] != ["%"]:
                tokens.append(c)
    if escaped:
        literal += "\\"
    close()
    return tokens


def normal_pattern(pattern: str) -> str:
    """The same pattern with only ``%``, ``_`` and backslash escaped, as Spark requires."""
    out = ""
    for t in pattern_tokens(pattern):
        out += t if t[0] != "=" else "".join(f"\\{c}" if c in "%_\\" else c for c in t[1:])
    return out


def like(value: Any, pattern: str | None, ignore_case: bool = False, positive: bool = True) -> Any:
    """``[NOT] LIKE`` or ``ILIKE`` a constant pattern; NULL for a NULL pattern or value."""
    if is_missing(pattern):
        return result(F.lit(None).cast("boolean"), value)
    if not isinstance(pattern, str):
        raise NotImplementedError("the pattern must be a constant text")
    c = as_column(value, "string") if is_missing(value) else as_column(value)
    found = c.ilike(normal_pattern(pattern)) if ignore_case else c.like(normal_pattern(pattern))
    return result(found if positive else ~found, value)

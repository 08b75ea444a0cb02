"""Null rules of the engine, as Spark SQL text.

A value is a finite double, a boolean or null.  Arithmetic on a null or a
non-finite value gives null, and so does a result that is not finite.  Logic is
strict: a null operand gives null, unlike SQL's three-valued AND and OR.
"""

from __future__ import annotations

import math


def literal(value: float | bool) -> str:
    """A number or boolean as SQL text of its type."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if not math.isfinite(value):
        return "CAST(NULL AS DOUBLE)"
    text = f"{float(value)!r}D"
    return f"({text})" if text.startswith("-") else text


NULL = "CAST(NULL AS DOUBLE)"


def finite(x: str) -> str:
    """x, a column or literal, or null where it is NaN or infinite (NaN sorts above infinity in Spark)."""
    return f"if(abs({x}) < double('Infinity'), {x}, NULL)"


def both(left: str, right: str, value: str) -> str:
    """value where neither side is null."""
    return f"CASE WHEN {left} IS NOT NULL AND {right} IS NOT NULL THEN {value} END"

"""Comparisons, strict logic, selection and filling."""

from __future__ import annotations

from panelfactor.functions.nullsafe import both
from panelfactor.plans.builder import Builder


def compare(b: Builder, operator: str, left: str, right: str) -> str:
    """A boolean node; null where an operand is; booleans compare as 1 and 0."""
    return b.element(f"{b.number(left)} {operator} {b.number(right)}", boolean=True)


def connect(b: Builder, word: str, left: str, right: str) -> str:
    """AND or OR that is null where either side is."""
    left, right = b.truth(left), b.truth(right)
    return b.element(both(left, right, f"({left} {word} {right})"), boolean=True)


def negation(b: Builder, condition: str) -> str:
    return b.element(f"NOT {b.truth(condition)}", boolean=True)


def where(b: Builder, condition: str, when_true: str, when_false: str) -> str:
    """Null where the condition is."""
    if b.type(when_true) != b.type(when_false):
        when_true, when_false = b.number(when_true), b.number(when_false)
    c = b.truth(condition)
    return b.element(f"CASE WHEN {c} THEN {when_true} WHEN NOT {c} THEN {when_false} END", boolean=b.type(when_true) == "boolean")


def fill_missing(b: Builder, x: str, value: str) -> str:
    return b.element(f"coalesce({b.number(x)}, {b.number(value)})")

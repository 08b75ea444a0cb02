"""Statistics over the rows of one timestamp; nulls take no part and stay null."""

from __future__ import annotations

from panelfactor.plans.builder import Builder


def rank(b: Builder, x: str) -> str:
    """Ascending percentile, ties averaged."""
    x = b.number(x)
    below, ties = b.section_rank(x)
    n = b.section(f"count({x})")
    return b.element(f"CASE WHEN {x} IS NOT NULL THEN ({below} + ({ties} + 1) / 2D) / {n} END")


def _spread(call: str):
    def op(b: Builder, x: str) -> str:
        x = b.number(x)
        return b.element(f"CASE WHEN {x} IS NOT NULL THEN {b.section(f'{call}({x})')} END")

    return op


mean, std, low, high = (_spread(c) for c in ("avg", "stddev_pop", "min", "max"))


def zscore(b: Builder, x: str) -> str:
    x = b.number(x)
    return b.finite(f"try_divide({x} - {b.section(f'avg({x})')}, {b.section(f'stddev_pop({x})')})")


def center(b: Builder, x: str) -> str:
    x = b.number(x)
    return b.finite(f"{x} - {b.section(f'avg({x})')}")


def scale(b: Builder, x: str) -> str:
    x = b.number(x)
    return b.finite(f"try_divide({x}, {b.section(f'sum(abs({x}))')})")


def neutralize(b: Builder, y: str, x: str) -> str:
    """Residual of y on x by least squares with intercept, over the rows that have both."""
    y, x = b.number(y), b.number(x)
    a, s = b.section(f"regr_intercept({y}, {x})"), b.section(f"regr_slope({y}, {x})")
    return b.finite(f"CASE WHEN {y} IS NOT NULL AND {x} IS NOT NULL THEN {y} - ({a} + {s} * {x}) END")

"""Element-wise arithmetic: a null or non-finite operand or result gives null."""

from __future__ import annotations

from collections.abc import Callable

from panelfactor.functions.nullsafe import both
from panelfactor.plans.builder import Builder


def _binary(template: str) -> Callable[[Builder, str, str], str]:
    def op(b: Builder, left: str, right: str) -> str:
        return b.finite(template.format(l=b.number(left), r=b.number(right)))

    return op


def _unary(template: str) -> Callable[[Builder, str], str]:
    def op(b: Builder, x: str) -> str:
        return b.finite(template.format(x=b.number(x)))

    return op


add = _binary("{l} + {r}")
subtract = _binary("{l} - {r}")
multiply = _binary("{l} * {r}")
divide = _binary("try_divide({l}, {r})")
power = _binary("power({l}, {r})")
modulo = _binary("try_mod({l}, {r})")
absolute = _unary("abs({x})")
negate = _unary("-{x}")
log = _unary("ln({x})")
log1p = _unary("log1p({x})")
exp = _unary("exp({x})")
sqrt = _unary("sqrt({x})")
sign = _unary("signum({x})")


def maximum(b: Builder, left: str, right: str) -> str:
    left, right = b.number(left), b.number(right)
    return b.element(both(left, right, f"greatest({left}, {right})"))


def minimum(b: Builder, left: str, right: str) -> str:
    left, right = b.number(left), b.number(right)
    return b.element(both(left, right, f"least({left}, {right})"))


def clip(b: Builder, x: str, low: str, high: str) -> str:
    """min(high, max(low, x)): with low above high the result is high."""
    return minimum(b, maximum(b, x, low), high)

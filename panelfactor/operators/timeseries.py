"""Trailing windows over the rows of one asset.

A frame is the last `window` observations by time; nulls occupy places in it.
A result is null where the frame has fewer than `least` finite values.

Frames of more than NARROW rows are made of two halves (`Builder.halves`).
Moments are taken about a value of their half, the first of the row's own block
and the last of the block before, and joined by moving one origin to the other:
the origin lies inside the frame, so sums stay as small as the frame's spread,
and those of a constant frame are exactly 0.
"""

from __future__ import annotations

from math import comb

from panelfactor.functions.nullsafe import literal
from panelfactor.plans.builder import NARROW, Builder


class Moments:
    """Sums over the frame of products of columns and of the position.

    Columns count from an origin in the frame, `origin` of each; positions from
    the first row of the row's own block.  Rows without any of the columns take
    no part.
    """

    def __init__(self, b: Builder, window: int, *columns: str):
        self.b, self.window, self.columns = b, window, columns
        there = " AND ".join(f"{c} IS NOT NULL" for c in columns)
        self.values = [c if len(columns) == 1 else b.element(f"CASE WHEN {there} THEN {c} END") for c in columns]
        self.first = [b.forward(f"first({v}, true)", window) for v in self.values]
        self.last = [b.backward(f"first({v}, true)", window) for v in self.values]
        self.last_before = [b.before(v, window) for v in self.last]
        self.origin = [b.element(f"coalesce({f}, {g})") for f, g in zip(self.first, self.last_before)]
        self.move = [b.element(f"coalesce({g} - {f}, 0D)") for f, g in zip(self.first, self.last_before)]
        self.n = self.sum(*(0 for _ in columns))

    def _halves(self, powers: tuple[int, ...], place: int) -> tuple[str, str]:
        """The sum of the columns' powers times that of the position, over each half about its own origin."""
        b, w = self.b, self.window
        sides = []
        for origin, shift in ((self.first, 0), (self.last, w)):
            factors = [f"({v} - {o})" for v, o, k in zip(self.values, origin, powers) for _ in range(k)]
            factors += [f"({b.position()} - 1D - {b.block(w)} * {w}D - {shift}D)"] * place
            if not any(powers):
                factors.append(f"if({self.values[0]} IS NULL, NULL, 1D)")
            sides.append(f"sum({' * '.join(factors)})")
        return b.forward(sides[0], w), b.before(b.backward(sides[1], w), w)

    def sum(self, *powers: int, place: int = 0) -> str:
        """Over the frame: the sum of (column - origin) ** power of all columns, times position ** place."""
        here, _ = self._halves(powers, place)
        terms = [f"coalesce({here}, 0D)"]
        shifts = [(1, (), ())]  # coefficient, powers of the other half, powers of the move
        for k in powers:
            shifts = [(c * comb(k, j), (*p, j), (*m, k - j)) for c, p, m in shifts for j in range(k + 1)]
        for c, p, m in shifts:
            _, before = self._halves(p, place)
            factors = [f"{c}D"] * (c != 1) + [f"coalesce({before}, 0D)"] + [x for x, k in zip(self.move, m) for _ in range(k)]
            terms.append(" * ".join(factors))
        return self.b.element(" + ".join(terms))

    def mean(self) -> str:
        """Of the only column, about its origin."""
        return self.b.element(f"try_divide({self.sum(1)}, {self.n})")

    def central(self, power: int) -> str:
        """The sum of the only column's powers about its mean; a constant frame has exactly 0."""
        b, m = self.b, self.mean()
        if power == 2:
            return b.element(f"greatest({self.sum(2)} - {self.sum(1)} * {m}, 0D)")
        if power == 3:
            return b.element(f"{self.sum(3)} - 3D * {m} * {self.sum(2)} + 2D * {self.n} * {m} * {m} * {m}")
        return b.element(f"{self.sum(4)} - 4D * {m} * {self.sum(3)} + 6D * {m} * {m} * {self.sum(2)} - 3D * {self.n} * {m} * {m} * {m} * {m}")

    def deviation(self) -> str:
        """Of the only column, with one degree of freedom less; null below two values."""
        return self.b.element(f"CASE WHEN {self.n} > 1 THEN sqrt({self.central(2)} / ({self.n} - 1D)) END")

    def product(self) -> str:
        """The sum of products of the two columns about their means."""
        return self.b.element(f"{self.sum(1, 1)} - {self.sum(1, 0)} * try_divide({self.sum(0, 1)}, {self.n})")

    def square(self, which: int) -> str:
        """The sum of squares of one of two columns about its mean."""
        one, two = ((1, 0), (2, 0)) if which == 0 else ((0, 1), (0, 2))
        return self.b.element(f"greatest({self.sum(*two)} - {self.sum(*one)} * try_divide({self.sum(*one)}, {self.n}), 0D)")

    def line(self) -> tuple[str, str, str]:
        """Slope of the only column against the position; spread of the positions and joint one, each times the number of values."""
        b, n = self.b, self.n
        u, uu, uy, y = self.sum(0, place=1), self.sum(0, place=2), self.sum(1, place=1), self.sum(1)
        spread, joint = b.element(f"{n} * {uu} - {u} * {u}"), b.element(f"{n} * {uy} - {u} * {y}")
        return b.element(f"try_divide({joint}, {spread})"), spread, joint


def _wide(window: int) -> bool:
    return window > NARROW


def ref(b: Builder, x: str, lag: int = 1) -> str:
    return b.lag(x, lag)


def delta(b: Builder, x: str, lag: int = 1) -> str:
    x = b.number(x)
    return b.finite(f"{x} - {b.lag(x, lag)}")


def pct_change(b: Builder, x: str, lag: int = 1) -> str:
    x = b.number(x)
    return b.finite(f"try_divide({x}, {b.lag(x, lag)}) - 1D")


def count(b: Builder, x: str, window: int) -> str:
    """The frame's values."""
    if not _wide(window):
        return b.rolling(f"count({x})", window)
    here, before = b.halves(f"count({x})", window)
    return b.element(f"{here} + coalesce({before}, 0L)")


def _gate(b: Builder, x: str, window: int, least: int, value: str) -> str:
    return b.finite(f"CASE WHEN {count(b, x, window)} >= {least} THEN {value} END")


def _simple(call: str, wide):
    def op(b: Builder, x: str, window: int, least: int) -> str:
        x = b.number(x)
        return _gate(b, x, window, least, wide(b, x, window) if _wide(window) else b.rolling(f"{call}({x})", window))

    return op


def _mean(b: Builder, x: str, window: int) -> str:
    m = Moments(b, window, x)
    return f"{m.origin[0]} + {m.mean()}"


def _total(b: Builder, x: str, window: int) -> str:
    here, before = b.halves(f"sum({x})", window)
    return f"coalesce({here}, 0D) + coalesce({before}, 0D)"


def _deviation(b: Builder, x: str, window: int) -> str:
    return Moments(b, window, x).deviation() if _wide(window) else b.rolling(f"stddev_samp({x})", window)


def _extreme_value(call: str, pick: str):
    def op(b: Builder, x: str, window: int) -> str:
        here, before = b.halves(f"{call}({x})", window)
        return f"{pick}({here}, {before})"

    return op


mean, total, std = _simple("avg", _mean), _simple("sum", _total), _simple("stddev_samp", _deviation)
low, high = _simple("min", _extreme_value("min", "least")), _simple("max", _extreme_value("max", "greatest"))


def _sorted(b: Builder, x: str, window: int) -> str:
    """The frame's values in order, once for all ranks and quantiles of it."""
    return b.element(f"sort_array({b.rolling(f'collect_list({x})', window)})")  # drops nulls


def rank(b: Builder, x: str, window: int, least: int, descending: bool = True) -> str:
    """Share of the frame's values below the current one (above it if not descending), ties counting half."""
    x = b.number(x)
    values = _sorted(b, x, window)
    # places of the first and the last of the values that equal x
    first = b.element(f"array_position({values}, {x})")
    ties = b.element(f"size({values}) - array_position(reverse({values}), {x}) + 2 - {first}")
    below = f"({first} - 1)" if descending else f"(size({values}) - {first} + 1 - {ties})"
    return b.finite(f"CASE WHEN size({values}) >= {least} AND {x} IS NOT NULL THEN ({below} + ({ties} + 1) / 2D) / size({values}) END")


def quantile(b: Builder, x: str, window: int, least: int, q: float = 0.8) -> str:
    """Linear interpolation between the frame's sorted values."""
    x = b.number(x)
    values, q = _sorted(b, x, window), literal(min(1.0, max(0.0, q)))
    place = b.element(f"(size({values}) - 1) * {q}")
    low_, high_ = (b.element(f"try_element_at({values}, greatest(CAST({f}({place}) AS INT), 0) + 1)") for f in ("floor", "ceil"))
    value = f"if({low_} = {high_}, {low_}, ({place} - floor({place})) * {high_} + (ceil({place}) - {place}) * {low_})"
    return b.finite(f"CASE WHEN size({values}) >= {least} THEN {value} END")


def _pair(b: Builder, x: str, y: str, window: int) -> tuple[str, str, str]:
    px = b.element(f"CASE WHEN {y} IS NOT NULL THEN {x} END")
    py = b.element(f"CASE WHEN {x} IS NOT NULL THEN {y} END")
    return px, py, b.rolling(f"count({px})", window)


def corr(b: Builder, x: str, y: str, window: int, least: int, tolerance: float = 0.0) -> str:
    """Pearson over pairs; null where either side hardly varies in its own frame."""
    x, y = b.number(x), b.number(y)
    wide = " AND ".join(f"{_deviation(b, v, window)} > {literal(tolerance)}" for v in (x, y))
    if _wide(window):
        m = Moments(b, window, x, y)
        sx, sy = m.square(0), m.square(1)
        return b.finite(f"CASE WHEN {m.n} >= {max(2, least)} AND {wide} AND {sx} > 0 AND {sy} > 0 THEN try_divide({m.product()}, sqrt({sx}) * sqrt({sy})) END")
    px, py, n = _pair(b, x, y, window)
    cov = b.rolling(f"covar_pop({px}, {py})", window)
    sx, sy = (b.rolling(f"stddev_pop({p})", window) for p in (px, py))
    return b.finite(f"CASE WHEN {n} >= {max(2, least)} AND {wide} AND {sx} > 0 AND {sy} > 0 THEN try_divide({cov}, {sx} * {sy}) END")


def cov(b: Builder, x: str, y: str, window: int, least: int) -> str:
    """Population covariance over pairs."""
    x, y = b.number(x), b.number(y)
    if _wide(window):
        m = Moments(b, window, x, y)
        return b.finite(f"CASE WHEN {m.n} >= {least} THEN try_divide({m.product()}, {m.n}) END")
    px, py, n = _pair(b, x, y, window)
    return b.finite(f"CASE WHEN {n} >= {least} THEN {b.rolling(f'covar_pop({px}, {py})', window)} END")


def slope(b: Builder, x: str, window: int, least: int) -> str:
    """Least squares against the position in the frame, holes keeping theirs."""
    x = b.number(x)
    value = Moments(b, window, x).line()[0] if _wide(window) else b.rolling(f"regr_slope({x}, {b.position()})", window)
    return _gate(b, x, window, least, value)


def rsquare(b: Builder, x: str, window: int, least: int, tolerance: float = 0.0) -> str:
    x = b.number(x)
    if _wide(window):
        m = Moments(b, window, x)
        _, spread, joint = m.line()
        r2 = f"try_divide({joint} * {joint}, {spread} * {m.n} * {m.central(2)})"
    else:
        r2 = b.rolling(f"regr_r2({x}, {b.position()})", window)
    return _gate(b, x, window, least, f"CASE WHEN {_deviation(b, x, window)} > {literal(tolerance)} THEN {r2} END")


def residual(b: Builder, x: str, window: int, least: int) -> str:
    x = b.number(x)
    p = b.position()
    if _wide(window):
        m = Moments(b, window, x)
        place = f"({p} - 1D - {b.block(window)} * {window}D - try_divide({m.sum(0, place=1)}, {m.n}))"
        return _gate(b, x, window, least, f"{x} - {m.origin[0]} - ({m.mean()} + {m.line()[0]} * {place})")
    my, mp, s = (b.rolling(f"{call}({x}, {p})", window) for call in ("regr_avgy", "regr_avgx", "regr_slope"))
    return _gate(b, x, window, least, f"{x} - ({my} + {s} * ({p} - {mp}))")  # about the means, as the intercept may be far away


def _extreme(b: Builder, x: str, window: int, least: int, highest: bool) -> str:
    """Place of the first extreme value, from 1 at the frame's oldest row; of the first hole if there is one."""
    x = b.number(x)
    p = b.position()
    call, place = ("max", f"-{p}") if highest else ("min", p)
    best = f"{call}(CASE WHEN {x} IS NOT NULL THEN struct({x} AS v, {place} AS p) END)"
    hole = f"min(CASE WHEN {x} IS NULL THEN {p} END)"
    if _wide(window):
        best, hole = (b.element(f"{pick}({', '.join(b.halves(c, window))})") for pick, c in (("greatest" if highest else "least", best), ("least", hole)))
    else:
        best, hole = b.rolling(best, window, f"first_{call}", x, p), b.rolling(hole, window, "first_hole", x, p)
    found = f"-{best}.p" if highest else f"{best}.p"
    oldest = f"greatest(1D, {p} - {window - 1})"
    return _gate(b, x, window, least, f"coalesce({hole}, {found}) - {oldest} + 1D")


def argmax(b: Builder, x: str, window: int, least: int) -> str:
    return _extreme(b, x, window, least, True)


def argmin(b: Builder, x: str, window: int, least: int) -> str:
    return _extreme(b, x, window, least, False)


def skew(b: Builder, x: str, window: int, least: int) -> str:
    """Adjusted skewness G1; the `runtime` estimator is G1 / n."""
    x = b.number(x)
    n = count(b, x, window)
    if _wide(window):
        m = Moments(b, window, x)
        g = b.element(f"try_divide(sqrt({n}) * {m.central(3)}, {m.central(2)} * sqrt({m.central(2)}))")
    else:
        g = b.rolling(f"skewness({x})", window)
    adjusted = f"sqrt({n} * ({n} - 1D)) / ({n} - 2D) * {g}"
    return _gate(b, x, window, least, f"CASE WHEN {n} >= 3 THEN {adjusted if b.skew_estimator != 'runtime' else f'{adjusted} / {n}'} END")


def kurt(b: Builder, x: str, window: int, least: int) -> str:
    """Adjusted excess kurtosis G2; the `runtime` estimator is (G2 + B) / n - B with B = 3 (n-1)^2 / ((n-2)(n-3))."""
    x = b.number(x)
    n = count(b, x, window)
    if _wide(window):
        m = Moments(b, window, x)
        g = b.element(f"try_divide({n} * {m.central(4)}, {m.central(2)} * {m.central(2)}) - 3D")
    else:
        g = b.rolling(f"kurtosis({x})", window)
    adjusted = f"({n} - 1D) / (({n} - 2D) * ({n} - 3D)) * (({n} + 1D) * {g} + 6D)"
    shift = f"(3D * ({n} - 1D) * ({n} - 1D) / (({n} - 2D) * ({n} - 3D)))"
    return _gate(b, x, window, least, f"CASE WHEN {n} >= 4 THEN {adjusted if b.skew_estimator != 'runtime' else f'({adjusted} + {shift}) / {n} - {shift}'} END")

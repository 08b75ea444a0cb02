"""Many narrow frames at once: rows sorted by asset are read in tasks as Arrow columns.

A window function of a sliding frame is a loop over the frame's rows for each
row, in which all aggregates take their turn; with tens of them that is most of
a query's time.  Here the loop is over the places in the frame, each a slice of
a column, so a step serves thousands of rows.  Steps go from the oldest row to
the current one by the formulas of Spark's aggregates, so results are theirs:
running means and sums of squares about them, of which those of a constant
frame are exactly 0.  A task holds a slice and the rows that its frames reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelfactor.plans.session import findable

#: rows of a slice: some columns of them fit a processor's cache
ROWS = 4096
NUMBER = "_frame_row"
_BEST = T.StructType([T.StructField("v", T.DoubleType()), T.StructField("p", T.DoubleType())])
TYPES = {"count": T.LongType(), "collect_list": T.ArrayType(T.DoubleType(), False), "first_max": _BEST, "first_min": _BEST}
PLAIN = (T.NumericType, T.BooleanType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)


def plain(df: DataFrame, names: set[str]) -> bool:
    """Whether these columns go through Arrow as they are."""
    return all(isinstance(f.dataType, PLAIN) or f.dataType == T.StringType() for f in df.schema.fields if f.name in names)


class Slice:
    """Rows of a slice after the `before` rows that precede them; null is NaN."""

    def __init__(self, columns: dict[str, np.ndarray], number: np.ndarray, before: int):
        self.columns, self.number, self.before, self.n = columns, number, before, len(number)
        self.there = {k: ~np.isnan(v) for k, v in columns.items()}
        self.done: dict[tuple, object] = {}

    @cached_property
    def inside(self) -> list[np.ndarray]:
        """For each distance whether the row so far back is the same asset's."""
        return [self.number > j for j in range(self.before + 1)]

    def steps(self, window: int, *names: str) -> Iterator[tuple]:
        """From the oldest place to the current one: which rows have all values there, and the values."""
        for j in range(window - 1, -1, -1):
            at = slice(self.before - j, self.before - j + self.n)
            ok = self.inside[j]
            for name in names:
                ok = ok & self.there[name][at]
            yield ok, *(self.columns[name][at] for name in names)

    def once(self, kind: str, window: int, *names: str):
        key = (kind, window, *names)
        if key not in self.done:
            self.done[key] = getattr(self, kind)(window, *names)
        return self.done[key]

    def count(self, window: int, x: str) -> np.ndarray:
        """Number of values."""
        ends = np.concatenate([[0], np.cumsum(self.there[x])])
        after = np.arange(self.before + 1, self.before + 1 + self.n)
        return ends[after] - ends[after - np.minimum(self.number, window)]

    def total(self, window: int, x: str) -> np.ndarray:
        """Sum of the values."""
        total = np.zeros(self.n)
        for ok, v in self.steps(window, x):
            total += np.where(ok, v, 0.0)
        return total

    def averages(self, window: int, x: str, y: str) -> tuple:
        """Number of pairs and both means."""
        n, sx, sy = np.zeros(self.n, np.int64), np.zeros(self.n), np.zeros(self.n)
        for ok, v, u in self.steps(window, x, y):
            n += ok
            sx += np.where(ok, v, 0.0)
            sy += np.where(ok, u, 0.0)
        return n, sx / n, sy / n

    def moments(self, window: int, x: str) -> tuple:
        """Number of values, mean, and sum of squares about it."""
        n, mean, m2 = np.zeros(self.n, np.int64), np.zeros(self.n), np.zeros(self.n)
        for ok, v in self.steps(window, x):
            n += ok
            delta = np.where(ok, v - mean, 0.0)
            step = delta / np.maximum(n, 1)
            mean += step
            m2 += delta * (delta - step)
        return n, mean, m2

    def pairs(self, window: int, x: str, y: str) -> tuple:
        """Number of pairs, both means, the sum of products about them and those of squares."""
        n, mx, my, xy, xx, yy = np.zeros(self.n, np.int64), *(np.zeros(self.n) for _ in range(5))
        for ok, v, u in self.steps(window, x, y):
            n += ok
            count = np.maximum(n, 1)
            dx, dy = np.where(ok, v - mx, 0.0), np.where(ok, u - my, 0.0)
            mx += dx / count
            my += dy / count
            rest = np.where(ok, u - my, 0.0)
            xy += dx * rest
            xx += dx * np.where(ok, v - mx, 0.0)
            yy += dy * rest
        return n, mx, my, xy, xx, yy

    def extreme(self, window: int, x: str, pick) -> pa.Array:
        best = np.full(self.n, np.nan)
        for ok, v in self.steps(window, x):
            best = pick(best, np.where(ok, v, np.nan))
        return known(best, ~np.isnan(best))

    def first(self, window: int, x: str, p: str, highest: bool) -> pa.Array:
        """The extreme value and the place of its first row, negative for the highest."""
        best, place = np.full(self.n, np.nan), np.full(self.n, np.nan)
        position = self.columns[p]
        for j, (ok, v) in zip(range(window - 1, -1, -1), self.steps(window, x)):
            better = ok & ~(v <= best if highest else v >= best)
            best = np.where(better, v, best)
            place = np.where(better, position[self.before - j : self.before - j + self.n], place)
        return pa.StructArray.from_arrays([pa.array(best), pa.array(-place if highest else place)], ["v", "p"], mask=pa.array(np.isnan(best)))

    def collected(self, window: int, x: str) -> pa.Array:
        """The frame's values in order."""
        frames = np.lib.stride_tricks.sliding_window_view(self.columns[x][self.before - window + 1 :], window)
        far = np.arange(window - 1, -1, -1)
        frames = np.where(self.number[:, None] > far, frames, np.nan)
        frames.sort(axis=1)  # NaN comes last
        there = ~np.isnan(frames)
        ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(frames[there]))

    def result(self, call: str, window: int, *names: str) -> pa.Array:
        """What the aggregate gives over the last `window` rows."""
        if call == "count":
            return pa.array(self.once("count", window, *names))
        if call in ("sum", "avg"):
            n, total = self.once("count", window, *names), self.once("total", window, *names)
            return known(total if call == "sum" else total / n, n > 0)
        if call in ("stddev_samp", "stddev_pop"):
            n, _, m2 = self.once("moments", window, *names)
            less = call == "stddev_samp"
            return known(np.sqrt(m2 / (n - less)), n > less)
        if call in ("min", "max"):
            return self.extreme(window, names[0], np.fmin if call == "min" else np.fmax)
        if call in ("first_max", "first_min"):
            return self.first(window, *names, call == "first_max")
        if call == "first_hole":
            place, position = np.full(self.n, np.nan), self.columns[names[1]]
            for j in range(window):
                at = slice(self.before - j, self.before - j + self.n)
                place = np.where(self.inside[j] & ~self.there[names[0]][at], position[at], place)
            return known(place, ~np.isnan(place))
        if call == "collect_list":
            return self.collected(window, *names)
        if call == "covar_pop":
            n, _, _, xy, _, _ = self.once("pairs", window, *names)
            return known(xy / n, n > 0)
        if call in ("regr_avgx", "regr_avgy"):
            n, y, x = self.once("averages", window, *names)
            return known(x if call == "regr_avgx" else y, n > 0)
        _, _, _, xy, xx, yy = self.once("pairs", window, *reversed(names))  # regressions of the first on the second
        return known(xy / xx if call == "regr_slope" else np.where(yy == 0, 1.0, xy * xy / (xx * yy)), xx > 0)


CALLS = frozenset("count sum avg stddev_samp stddev_pop min max first_max first_min first_hole collect_list covar_pop regr_r2 regr_slope regr_avgx regr_avgy".split())


def known(values: np.ndarray, there: np.ndarray) -> pa.Array:
    return pa.array(values, mask=~there)


def _work(passed: list[str], wanted: list[tuple[str, str, tuple[str, ...], int]]):
    inputs = sorted({x for _, _, names, _ in wanted for x in names})
    before = max(window for *_, window in wanted) - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old = {x: np.full(before, np.nan) for x in inputs}
        with np.errstate(all="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    columns = {x: np.concatenate([old[x], part.column(x).to_numpy(zero_copy_only=False)]) for x in inputs}
                    rows = Slice(columns, part.column(NUMBER).to_numpy(zero_copy_only=False), before)
                    made = [rows.result(call, window, *names) for _, call, names, window in wanted]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), *made], [*passed, *(w[0] for w in wanted)])
                    old = {x: v[len(v) - before :].copy() for x, v in columns.items()}

    return work


def read(df: DataFrame, frames: list[tuple[str, str, tuple[str, ...], int]], keys: list[str], order: list[str], keep: set[str]) -> DataFrame:
    """df's columns `keep` with one more for each of (name, call, arguments, window), over the rows of `keys` by `order`."""
    findable(df.sparkSession)
    inputs = {x for _, _, names, _ in frames for x in names}
    passed = [c for c in df.columns if c in keep]
    numbered = f"CAST(row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)}) AS BIGINT) AS {NUMBER}"
    used = [c for c in df.columns if c in keep or c in inputs or c in keys or c in order]
    ready = df.selectExpr(*(f"`{c}`" for c in used), numbered).sortWithinPartitions(*keys, *order)
    ready = ready.select(*(c for c in used if c in keep or c in inputs), NUMBER)
    schema = T.StructType([*(df.schema[c] for c in passed), *(T.StructField(name, TYPES.get(call, T.DoubleType())) for name, call, _, _ in frames)])
    return ready.mapInArrow(_work(passed, frames), schema)

"""Statistics over timestamps with more rows than a task can hold.

A window by timestamp brings all its rows to one task.  Here an aggregate that
combines in the tasks gives one row for each timestamp, which is joined back; a
join by timestamp may be split by AQE, and a window may not.

Ranks need order.  Equal values are counted first, so that each value is one
row; quantiles of a timestamp's values, a sketch of bounded size, cut them into
RANGES ranges; counts of whole ranges and a running count inside a range give how
many values are below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ranges into which the values of one timestamp are cut
RANGES = 256


def _back(df: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """df with found's columns, by keys that may be null."""
    renamed = found.withColumnsRenamed({k: f"_key_{j}" for j, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{j}")) for j, k in enumerate(keys)]
    return df.join(renamed, same, "left").drop(*(f"_key_{j}" for j in range(len(keys))))


def joined(df: DataFrame, calls: dict[str, str], time: str = "timestamp") -> DataFrame:
    """df with a column for each SQL aggregate of calls, over the rows of its timestamp."""
    return _back(df, df.groupBy(time).agg(*(F.expr(call).alias(name) for name, call in calls.items())), time)


def ranked(df: DataFrame, x: str, below: str, ties: str, time: str = "timestamp", ranges: int = RANGES) -> DataFrame:
    """df with `below`, the number of the timestamp's values less than x, and `ties`, that of values equal to x; null where x is."""
    values = df.where(F.col(x).isNotNull()).groupBy(time, x).agg(F.count("*").alias(ties))
    cuts = values.groupBy(time).agg(F.percentile_approx(x, [k / ranges for k in range(1, ranges)], 10 * ranges).alias("_cuts"))
    # the number of cuts below x; cuts are in order, so equal values fall into one range
    placed = _back(values, cuts, time).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(x)))).drop("_cuts")
    sizes = placed.groupBy(time, "_range").agg(F.sum(ties).alias("_n"))
    starts = sizes.selectExpr(time, "_range", f"coalesce(sum(_n) OVER (PARTITION BY {time} ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS _start")
    inside = f"coalesce(sum({ties}) OVER (PARTITION BY {time}, _range ORDER BY {x} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)"
    found = _back(placed, starts, time, "_range").selectExpr(time, x, ties, f"_start + {inside} AS {below}")
    return _back(df, found, time, x)

"""How many tasks share a shuffle: more of them, not larger ones, as the input grows.

A session has one number of shuffle partitions for tables of any size, and
adaptive execution merges those to some 64 MiB of packed bytes each, whatever
their number.  Rows that wide windows are added to grow tenfold in a task, so
what it sorts would grow with the input until it is spilled.  A shuffle with a
number of its own is not merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: bytes of input files for each task of a shuffle; ten times as many or more in memory
SHARE = 1 << 20
#: Spark's size of a table of which it knows none
UNKNOWN = 1 << 60


def partitions(df: DataFrame) -> int:
    """Tasks for a shuffle of df: one for each SHARE bytes of what it reads; 0 if that is not known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    return -(-sum(s for s in sizes if s < UNKNOWN) // SHARE)


def spread(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df dealt by keys to n tasks; as it is where n is not above the number of cores, as Spark makes as many by itself."""
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df

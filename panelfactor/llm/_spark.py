"""Shared Spark plumbing of the corpus operators."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfactor.plans.session import findable

#: rows and bytes in an Arrow batch at most: texts may be long, and a batch is held in memory
ARROW_ROWS, ARROW_BYTES = 512, 16 << 20
ROWS_KEY, BYTES_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"

#: an id that is null sorts after every other one
NULL_ID = (1 << 63) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower Spark's rows and bytes per Arrow batch to ARROW_ROWS and ARROW_BYTES (never raise them).

    They hold for the session: Spark reads them when a plan runs, not when it is made.
    """
    for key, most in ((ROWS_KEY, ARROW_ROWS), (BYTES_KEY, ARROW_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    findable(df.sparkSession)
    return df.mapInArrow(work, schema)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the folder of spark.checkpoint.dir and drop its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def masked(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with its columns renamed to c0, c1, ... so that no name can clash, and the new names of `names`."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))), [f"c{df.columns.index(n)}" for n in names]


def null_id(name: str):
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


#: rows that `lookup` may broadcast, and rows of a key that are never too many for a task
HEAVY, FLOOR = 10_000, 1000


def lookup(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, how: str = "left") -> DataFrame:
    """left with right's columns but `weight`, by `key` (a column or several); how is left or inner.

    right has one row for each key, and as `weight` about how many rows of left
    have it.  Keys with more than FLOOR rows and 1 / HEAVY of all weight are
    HEAVY at most; they are broadcast, so their rows stay where they are and no
    task of the shuffle join that serves the others meets a hot key.  A right
    side of up to HEAVY rows is broadcast whole.  left and right should be
    materialised.
    """
    n, total, most = right.agg(F.count("*"), F.sum(weight), F.max(weight)).first()
    if n <= HEAVY:
        return left.join(F.broadcast(right.drop(weight)), key, how)
    limit = max(total / HEAVY, FLOOR)
    if most <= limit:
        return left.join(right.drop(weight), key, how)
    heavy = F.broadcast(right.where(F.col(weight) > limit).drop(weight))
    light = left.join(heavy.select(key) if isinstance(key, str) else heavy.select(*key), key, "left_anti").join(right.where(F.col(weight) <= limit).drop(weight), key, how)
    return left.join(heavy, key).unionByName(light)


class Bitmap:
    """A set of 64-bit hashes in a bit array of fixed size: no member is missed, a few others pass.

    Its size is the bound that makes it safe to broadcast.  More members than
    bits only let more rows through to the exact step that always follows.
    """

    BITS = 27  # 2**27 bits are 16 MB

    def __init__(self, bits: np.ndarray, log2: int):
        self.bits, self.log2 = bits, log2

    def __contains__(self, hashes) -> bool:
        return bool(self.has(np.asarray([hashes])).all())

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.astype(np.uint64) >> np.uint64(64 - self.log2)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    @classmethod
    def of(cls, df: DataFrame, column: str, log2: int = BITS) -> Bitmap:
        """From the long column of df; the driver gets one 64-bit word for each word in use, never the rows."""
        at = F.shiftrightunsigned(F.col(column), 64 - log2)
        filled = (
            df.select(F.shiftrightunsigned(at, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - log2}) & 63 as int))").alias("bit"))
            .groupBy("word")
            .agg(F.bit_or("bit").alias("bit"))
        )
        bits = np.zeros(1 << (log2 - 3), dtype=np.uint8)
        table = filled.toArrow()
        bits.view("<i8")[table.column("word").to_numpy()] = table.column("bit").to_numpy()
        del table
        gc.collect()
        pa.default_memory_pool().release_unused()  # many of these are made one after the other
        return cls(bits, log2)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where that is unset, a master on this machine alone gets a temporary
    folder; on a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="shared-")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder in whatever file system it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

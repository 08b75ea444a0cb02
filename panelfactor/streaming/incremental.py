"""Factors over a growing panel, with Structured Streaming.

Windows over rows are not streaming operators, so each micro-batch is computed
as a batch: the new rows, and of each of their assets the rows before them that
the formula can reach.  Those, at most `lookback` for each asset, are keyed state
of a stateful operator in Spark's state store: a batch reads and writes the
state of its own assets alone, so its cost depends neither on the length of the
history nor on assets that are idle.  Only the new rows' values are appended; a
restart repeats at most one batch from the state before it, which `batch_id` in
the paths makes idempotent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from panelfactor.plans.run import run_expression


def lookback(expression: str) -> int:
    """Rows of an asset before the current one that a formula can reach."""
    from panelfactor.plans import blocks
    from panelfactor.plans.dsl import parse_factor

    nodes, edges = parse_factor(expression)
    known = {n.id: n for n in nodes}

    def reach(name: str) -> int:
        node = known[name]
        p = blocks.Params(node.parameters)
        defaults = blocks.defaults(node.block)
        own = p.window - 1 if "window" in defaults else p.lag if "lag" in defaults else 0
        return own + max((reach(e.source) for e in edges if e.target == name), default=0)

    return max(reach(n.id) for n in nodes if n.is_output)


def elementwise_stream(panel: DataFrame, sql: str, name: str = "factor") -> DataFrame:
    """A stateless factor of a row's own fields, on a streaming panel."""
    return panel.withColumn(name, F.expr(sql))


def batch_values(history: DataFrame | None, fresh: DataFrame, expression: str) -> DataFrame:
    """The fresh rows with their factor, given earlier rows of the panel."""
    n = lookback(expression)
    new = fresh.withColumn("_new", F.lit(True))
    if history is not None and n:
        old = _last(history.join(fresh.select("asset").distinct(), "asset", "left_semi"), n)
        new = new.unionByName(old.withColumn("_new", F.lit(False)), allowMissingColumns=True)
    return run_expression(new, expression).points.where("_new").drop("_new", "ratio", "ts_rank")


def _last(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows of each asset."""
    turn = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("timestamp")))
    return rows.withColumn("_k", turn).where(F.col("_k") <= n).drop("_k")


class Reachable(StatefulProcessor):
    """Adds to an asset's new rows those before them that a formula can reach (NEW is false on these), and keeps the last `keep`."""

    def __init__(self, schema: StructType, keep: int):
        self.schema, self.keep, self.names = schema, keep, schema.names
        self.order = [self.names.index(c) for c in ("timestamp", "_row_id") if c in self.names]

    def init(self, handle) -> None:
        self.rows = handle.getListState("rows", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old, fresh = [tuple(r) for r in self.rows.get()], [tuple(r[c] for c in self.names) for r in rows]
        named = Row(*self.names, NEW)
        yield from (named(*r, False) for r in old)
        yield from (named(*r, True) for r in fresh)
        # a missing time comes first, as in the windows
        both = sorted(old + fresh, key=lambda r: [(r[k] is not None, r[k]) for k in self.order])
        self.rows.put(both[-self.keep :])

    def close(self) -> None:
        pass


NEW = "_new"
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """A state store that can hold lists, for queries that start inside; the session's own setting comes back."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def stream_factor(panel: DataFrame, expression: str, store: str, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that stores a streaming panel under `store` and its factor under `out` (Parquet).

    Rows of an asset must arrive in order of time.
    """
    n = lookback(expression)

    def on_batch(rows: DataFrame, batch_id: int) -> None:
        rows = rows.persist()
        run_expression(rows, expression).points.where(NEW).drop(NEW, "ratio", "ts_rank").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        rows.where(NEW).drop(NEW).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        rows.unpersist()

    if n:
        schema = StructType([*panel.schema.fields, StructField(NEW, BooleanType())])
        rows = panel.groupBy("asset").transformWithState(Reachable(panel.schema, n), schema, "Append", "None")
    else:
        rows = panel.withColumn(NEW, F.lit(True))
    with keyed_state(panel.sparkSession):
        return rows.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_panel(events: DataFrame, time_col: str, asset_col: str, value_col: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling-window bars from a stream of single values, with a watermark for late ones."""
    key: Callable[..., object] = F.struct
    return (
        events.withWatermark(time_col, late)
        .groupBy(F.window(time_col, width).alias("w"), F.col(asset_col).alias("asset"))
        .agg(F.min_by(value_col, key(time_col)).alias("open"), F.max(value_col).alias("high"), F.min(value_col).alias("low"), F.max_by(value_col, key(time_col)).alias("close"), F.count("*").cast("double").alias("volume"))
        .select(F.date_format("w.start", "yyyy-MM-dd'T'HH:mm").alias("timestamp"), "asset", "open", "high", "low", "close", "volume")
    )

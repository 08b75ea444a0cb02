"""Panels: rows of (timestamp, asset) with prices, from tables of other shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfactor.plans.partitions import partitions, spread


def read_parquet(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """A panel from Parquet; `columns` maps canonical names to the file's.  Only those columns are read."""
    df = spark.read.parquet(path)
    if not columns:
        return df
    return df.select(*(F.col(source).alias(name) for name, source in columns.items()))


def lineitem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as assets and ship dates as time: prices of a day's lines, with holes at fixed places.

    One aggregation; first and last price by the least and the greatest line.
    A small table is combined on the map side; lines of a large one are dealt
    by supplier and day first, to as many tasks as they need.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    key = F.struct("l_orderkey", "l_linenumber", "px")
    keyed = lines.withColumns({"s": F.col("l_suppkey"), "d": F.to_date("l_shipdate")})
    days = (
        spread(keyed, partitions(lines), "s", "d")
        .withColumn("px", px)
        .groupBy("s", "d")
        .agg(
            F.min(key)["px"].alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max(key)["px"].alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("amount"),
        )
    )
    hole = F.col("s") * 7 + F.datediff("d", F.lit("1992-01-01").cast("date"))

    def holed(name: str, every: int):
        return F.when(hole % every != 0, F.col(name)).alias(name)

    return days.select(
        F.date_format("d", "yyyy-MM-dd").alias("timestamp"),
        F.col("s").cast("string").alias("asset"),
        "open",
        holed("high", 29),
        holed("low", 31),
        holed("close", 23),
        holed("volume", 19),
        "amount",
        (F.col("amount") / F.col("volume")).alias("vwap"),
    )


#: the same in DuckDB SQL, as a view named panel
LINEITEM_SQL = """
days AS (
  SELECT l_suppkey AS s, CAST(l_shipdate AS DATE) AS d,
         arg_min(px, struct_pack(a := l_orderkey, b := l_linenumber, c := px)) AS open, max(px) AS high, min(px) AS low,
         arg_max(px, struct_pack(a := l_orderkey, b := l_linenumber, c := px)) AS close,
         sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
  FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem) GROUP BY ALL
),
holes AS (SELECT *, s * 7 + date_diff('day', DATE '1992-01-01', d) AS h FROM days),
panel AS (
  SELECT strftime(d, '%Y-%m-%d') AS timestamp, CAST(s AS VARCHAR) AS asset, open,
         CASE WHEN h % 29 <> 0 THEN high END AS high, CASE WHEN h % 31 <> 0 THEN low END AS low,
         CASE WHEN h % 23 <> 0 THEN close END AS close, CASE WHEN h % 19 <> 0 THEN volume END AS volume,
         amount, amount / volume AS vwap
  FROM holes
)"""


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as assets and hours as time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value")
    key = F.struct("ts", "event_id")
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd'T'HH").alias("timestamp"), F.col("event_type").alias("asset")).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.count("*").cast("double").alias("volume"), F.sum("value").alias("amount"), F.avg("value").alias("vwap")
    )


EVENTS_SQL = """
panel AS (
  SELECT strftime(ts, '%Y-%m-%dT%H') AS timestamp, event_type AS asset,
         arg_min(value, struct_pack(a := ts, b := event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, struct_pack(a := ts, b := event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(value) AS amount, avg(value) AS vwap
  FROM events GROUP BY ALL
)"""


def tail(panel: DataFrame, n: int = 8) -> DataFrame:
    """The panel's last n rows, in its order: a preview."""
    order = ["_row_id"] if "_row_id" in panel.columns else ["timestamp", "asset"]
    return panel.orderBy(*(F.desc(c) for c in order)).limit(n).orderBy(*order)


def demo_panel(spark: SparkSession) -> DataFrame:
    """A small panel for examples: four assets on seven days, from a rule."""
    rows = []
    for day in range(7):
        for k, asset in enumerate("ABCD"):
            base = 100.0 + 50 * k
            rows.append((f"2026-03-{day + 2:02d}", asset, base + day, base + day + ((day * 3 + k * 5) % 7) - 3.0, day * 4 + k))
    return spark.createDataFrame(rows, "timestamp string, asset string, open double, close double, _row_id long")

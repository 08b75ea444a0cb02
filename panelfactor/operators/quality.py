"""Quality report of a panel, in one aggregation by key and one over the keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("open", "high", "low", "close", "volume", "amount", "vwap")
PRICES = ("open", "high", "low", "close")


@dataclass
class Quality:
    rows: int = 0
    assets: int = 0
    dates: int = 0
    duplicate_keys: int = 0
    missing_values: int = 0
    invalid_numbers: int = 0
    zero_prices: int = 0
    out_of_order_rows: int = 0
    missing_by_field: dict[str, int] = field(default_factory=dict)

    @property
    def issues(self) -> list[str]:
        said = (
            (self.duplicate_keys, "duplicate keys of timestamp and asset"),
            (self.missing_values, "missing values"),
            (self.zero_prices, "rows with a price of zero"),
            (self.out_of_order_rows, "rows out of order of time"),
            (self.invalid_numbers, "invalid numbers"),
        )
        return [f"{n} {text}" for n, text in said if n]


def present_fields(panel: DataFrame, present: list[str] | None = None) -> list[str]:
    """Numeric fields to look at: those given or the panel's, open and close always."""
    return [c for c in FIELDS if c in ("open", "close") or c in (panel.columns if present is None else present)]


def quality_frame(panel: DataFrame, present: list[str] | None = None) -> DataFrame:
    """The report as a frame of one row.  Rows are in order of _row_id; without it no row counts as out of order."""
    fields = present_fields(panel, present)

    def invalid(c: str):
        return F.isnan(c) | (F.abs(F.col(c)) == float("inf"))

    zero = F.lit(False)
    for c in fields:
        if c in PRICES:
            zero = zero | F.coalesce(F.col(c) == 0, F.lit(False))
    if "_row_id" in panel.columns:
        before = F.lag("timestamp").over(Window.partitionBy("asset").orderBy("_row_id"))
        panel = panel.withColumn("_late", F.coalesce(F.col("timestamp") < before, F.lit(False)))
    else:
        panel = panel.withColumn("_late", F.lit(False))
    # by key first: the distinct counts then run over keys, and rows meet one combining aggregation
    keys = panel.groupBy("timestamp", "asset").agg(
        F.count("*").alias("n"),
        sum((F.count_if(F.coalesce(invalid(c), F.lit(False))) for c in fields), F.lit(0)).cast("long").alias("invalid"),
        F.count_if(zero).alias("zero"),
        F.count_if("_late").alias("late"),
        *(F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in fields),
    )

    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("long")

    one = {f"missing_{c}": total(F.col(f"missing_{c}")) for c in fields}
    return keys.agg(
        total(F.col("n")).alias("rows"),
        F.count_distinct("asset").alias("assets"),
        F.count_distinct("timestamp").alias("dates"),
        total(F.col("n") - 1).alias("duplicate_keys"),
        sum(one.values(), F.lit(0)).cast("long").alias("missing_values"),
        total(F.col("invalid")).alias("invalid_numbers"),
        total(F.col("zero")).alias("zero_prices"),
        total(F.col("late")).alias("out_of_order_rows"),
        *(v.alias(k) for k, v in one.items()),
    )


def quality(panel: DataFrame, present: list[str] | None = None) -> Quality:
    row = quality_frame(panel, present).first().asDict()
    by_field = {k.removeprefix("missing_"): row.pop(k) for k in list(row) if k.startswith("missing_") and k != "missing_values"}
    return Quality(**row, missing_by_field={k: v for k, v in by_field.items() if v})

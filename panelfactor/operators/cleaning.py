"""Cleaning of a panel: duplicates, order, missing values, in this order.

Windows stand in for loops: each rule is one pass with one exchange at most.
Sorting gives an order to read the rows in; nothing is sorted globally.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelfactor.operators.quality import Quality, present_fields, quality
from panelfactor.plans.builder import Split


@dataclass(frozen=True)
class Cleaning:
    duplicate: str = "keep-first"  # keep-first, keep-last or keep-all
    missing: str = "keep"  # keep, drop-row, forward-fill or fill-value
    fill_value: float = 0.0
    sort_by_asset_date: bool = True
    split: Split | None = None  # forward fill of assets with more rows than a task can hold


@dataclass
class Cleaned:
    rows: DataFrame
    order: tuple[str, ...]  # how to read the rows
    removed_rows: int
    changed_cells: int
    applied_rules: list[str]
    report: Quality


def _turn(keep: str):
    """The row's number among those of its key, from the one that stays."""
    by = F.col("_row_id").asc() if keep == "keep-first" else F.col("_row_id").desc()
    return F.row_number().over(Window.partitionBy("timestamp", "asset").orderBy(by))


def _before(by_time: bool):
    """An asset's rows up to the current one."""
    return Window.partitionBy("asset").orderBy(*(("timestamp", "_row_id") if by_time else ("_row_id",))).rowsBetween(Window.unboundedPreceding, 0)


def deduplicate(panel: DataFrame, keep: str = "keep-first") -> DataFrame:
    """One row for each (timestamp, asset): the first or last by _row_id."""
    if keep == "keep-all":
        return panel
    return panel.withColumn("_turn", _turn(keep)).where("_turn = 1").drop("_turn")


def drop_missing(panel: DataFrame, fields: list[str]) -> DataFrame:
    return panel.dropna(subset=[c for c in fields if c in panel.columns])


def fill_value(panel: DataFrame, fields: list[str], value: float = 0.0) -> DataFrame:
    value = float(value) if math.isfinite(value) else 0.0
    return panel.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(value)) for c in fields if c in panel.columns})


def forward_fill(panel: DataFrame, fields: list[str], by_time: bool = True, split: Split | None = None) -> DataFrame:
    """The asset's last value before a hole; leading holes stay.

    With `split` an asset's rows are filled slot by slot: each slot's last value
    comes from an aggregate, a scan over an asset's slots (one row each) carries
    it on, and holes are filled inside the slot and then by what was carried.
    split.slot must not fall with the order of the rows.
    """
    filled = [c for c in fields if c in panel.columns]
    if split is None:
        w = _before(by_time)
        return panel.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in filled})
    order = ["timestamp", "_row_id"] if by_time else ["_row_id"]
    slotted = panel.withColumn("_slot", F.expr(split.slot))
    ends = slotted.groupBy("asset", "_slot").agg(*(F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("_v"))))["_v"].alias(f"_last_{c}") for c in filled))
    earlier = Window.partitionBy("asset").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("asset").alias("_asset"), F.col("_slot").alias("_at"), *(F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_carried_{c}") for c in filled))
    joined = slotted.join(carried, F.col("asset").eqNullSafe(F.col("_asset")) & F.col("_slot").eqNullSafe(F.col("_at")))
    inside = Window.partitionBy("asset", "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_carried_{c}")) for c in filled}).select(*panel.columns)


def apply(panel: DataFrame, options: Cleaning = Cleaning(), present: list[str] | None = None) -> DataFrame:
    """The cleaned rows, lazily."""
    fields = present_fields(panel, present)
    df = deduplicate(panel, options.duplicate)
    if options.missing == "drop-row":
        return drop_missing(df, fields)
    if options.missing == "fill-value":
        return fill_value(df, fields, options.fill_value)
    if options.missing == "forward-fill":
        return forward_fill(df, fields, options.sort_by_asset_date, options.split)
    return df


def clean(panel: DataFrame, options: Cleaning = Cleaning(), present: list[str] | None = None) -> Cleaned:
    """The cleaned rows with counts of what changed; the panel itself stays as it is."""
    fields = [c for c in present_fields(panel, present) if c in panel.columns]
    kept = F.lit(True) if options.duplicate == "keep-all" else _turn(options.duplicate) == 1
    marked = panel.withColumn("_kept", kept)
    if options.missing == "forward-fill":
        w = _before(options.sort_by_asset_date)
        after = {c: F.last(F.when(F.col("_kept"), F.col(c)), ignorenulls=True).over(w) for c in fields}
    elif options.missing == "fill-value":
        after = {c: F.lit(0.0) for c in fields}
    else:
        after = {c: F.col(c) for c in fields}
    # one pass gives all counts: rows that stay are marked, and holes are counted before and after
    wide = marked.select("_kept", *fields, *(x.isNull().alias(f"_hole_{c}") for c, x in after.items()))
    hole = {c: F.col("_kept") & F.col(c).isNull() for c in fields}
    whole = ~functools.reduce(lambda x, y: x | y, (F.col(c).isNull() for c in fields), F.lit(False))
    n = wide.agg(
        F.count("*").alias("rows"),
        F.count_if("_kept").alias("single"),
        F.count_if(F.col("_kept") & whole).alias("whole"),
        sum((F.count_if(x) for x in hole.values()), F.lit(0)).alias("holes"),
        sum((F.count_if(F.col("_kept") & F.col(f"_hole_{c}")) for c in fields), F.lit(0)).alias("left"),
    ).first()
    rules, last = [], n.whole if options.missing == "drop-row" else n.single
    if n.rows > n.single:
        rules.append(f"duplicate keys: {options.duplicate}, {n.rows - n.single} rows removed")
    if options.sort_by_asset_date:
        rules.append("sorted by asset and time")
    changed = n.holes - n.left if options.missing in ("fill-value", "forward-fill") else 0
    if n.single > last:
        rules.append(f"{n.single - last} rows with missing values removed")
    if changed:
        rules.append(f"{changed} missing values filled " + (f"with {options.fill_value:g}" if options.missing == "fill-value" else "forward within each asset"))
    df = apply(panel, options, present)
    order = ("asset", "timestamp", "_row_id") if options.sort_by_asset_date else ("_row_id",)
    return Cleaned(df, order, n.rows - last, changed, rules, quality(df, present))

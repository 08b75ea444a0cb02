"""The fixed factor Cs_ZScore(Ts_Rank(Close / Open)).

It differs from the same graph of blocks: the last finite ratio of a window is
ranked even where the row's own is missing, a section needs two values, and a
row whose window is too short has a warning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelfactor.functions.nullsafe import finite
from panelfactor.plans.blocks import _round
from panelfactor.plans.graph import Settings


def legacy_expression(settings: Settings = Settings()) -> str:
    direction = "desc" if settings.descending else "asc"
    return f"Cs_ZScore(Ts_Rank(Close / Open, {settings.window:g}, {direction}, min_samples={settings.min_samples:g}))"


def legacy_factor(panel: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The panel with ratio, ts_rank, factor and warning."""
    window = max(2, _round(settings.window))
    least = max(1, min(window, _round(settings.min_samples)))
    order = "timestamp, _row_id" if "_row_id" in panel.columns else "timestamp"
    frame = f"OVER (PARTITION BY asset ORDER BY {order} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    section = "OVER (PARTITION BY timestamp)"
    beyond = "<" if settings.descending else ">"
    keep = [c for c in panel.columns if c not in ("ratio", "ts_rank", "factor", "warning")]
    return (
        panel.selectExpr(*keep, "try_divide(close, open) AS r0")
        .selectExpr(*keep, f"{finite('r0')} AS ratio")
        .selectExpr("*", f"collect_list(ratio) {frame} AS seen", f"last(ratio, true) {frame} AS now")
        .selectExpr("*", f"CASE WHEN size(seen) >= {least} THEN (size(filter(seen, v -> v {beyond} now)) + (size(filter(seen, v -> v = now)) + 1) / 2D) / size(seen) END AS ts_rank")
        .selectExpr("*", f"count(ts_rank) {section} AS n", f"avg(ts_rank) {section} AS m", f"stddev_pop(ts_rank) {section} AS s")
        .selectExpr(*keep, "ratio", "ts_rank", "CASE WHEN n >= 2 THEN try_divide(ts_rank - m, s) END AS factor", f"CASE WHEN ts_rank IS NULL THEN 'fewer than {least} valid observations' END AS warning")
    )

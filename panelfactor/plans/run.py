"""Factors over a panel: one at a time with a summary, or many in one plan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfactor.functions.nullsafe import NULL
from panelfactor.plans import catalog, expression
from panelfactor.plans.builder import ROW_ID, TIMESTAMP, Builder
from panelfactor.plans.dsl import parse_factor
from panelfactor.plans.graph import GraphEdge, GraphNode, Settings, compile_graph

FIELDS = ("open", "high", "low", "close", "volume", "amount", "vwap")
#: factors in one select at most: generated code has a size limit
BATCH = 60


def builder_for(panel: DataFrame, **options) -> Builder:
    """A Builder for the panel's columns; rows of one time are ordered by _row_id where there is one."""
    order = (TIMESTAMP, ROW_ID) if ROW_ID in panel.columns else (TIMESTAMP,)
    return Builder(order=order, fields=frozenset(c for c in FIELDS if c in panel.columns), **options)


@dataclass
class FactorRun:
    """A run: `points` is lazy, the counts cost one aggregation."""

    expression: str
    points: DataFrame
    warnings: list[str]
    supported: bool

    def summary(self) -> dict:
        """status, valid_values, missing_values and warnings."""
        if not self.supported:
            n = self.points.count()
            return {"status": "blocked", "expression": self.expression, "valid_values": 0, "missing_values": n, "warnings": self.warnings}
        return {"expression": self.expression, **summarize(self.points, self.warnings)}


def summarize(points: DataFrame, warnings: Iterable[str] = ()) -> dict:
    """Counts of a frame with a column factor, and distinct values of a column warning if there is one."""
    own = list(warnings)
    extra = [F.collect_set("warning").alias("w")] if "warning" in points.columns else []
    row = points.agg(F.count("*").alias("n"), F.count("factor").alias("v"), *extra).first()
    said = list(dict.fromkeys([*own, *(sorted(row.w) if extra else [])]))
    return {"status": "warning" if own or not row.v else "passed", "valid_values": row.v, "missing_values": row.n - row.v, "warnings": said}


def run_graph(panel: DataFrame, nodes: list[GraphNode], edges: list[GraphEdge], settings: Settings | None = None, **options) -> FactorRun:
    """The panel's columns with ratio, ts_rank and factor."""
    compiled = compile_graph(nodes, edges, settings, builder_for(panel, **options))
    text, _ = expression.expression(nodes, edges, settings)
    keep = [c for c in panel.columns if c not in ("ratio", "ts_rank", "factor")]
    return FactorRun(text, compiled.builder.run(panel, compiled.outputs(), keep), compiled.warnings, compiled.supported)


def run_expression(panel: DataFrame, text: str, **options) -> FactorRun:
    return run_graph(panel, *parse_factor(text), **options)


def compute_factors(panel: DataFrame, factors: Iterable[str] | Mapping[str, str], keep: list[str] | None = None, batch: int = BATCH, **options) -> DataFrame:
    """Many factors as columns of one frame: catalogue ids or names, or a mapping of column name to formula.

    All share one DAG, so common windows and lags are computed once.  Columns
    are made in batches over the same partitioning: later batches reuse the
    exchange and the sort of the first.
    """
    named = dict(factors) if isinstance(factors, Mapping) else {f.name: f.expression for f in map(catalog.find, factors)}
    keep = panel.columns if keep is None else keep
    df, done, names = panel, [], list(named)
    for at in range(0, len(names), batch):
        b = builder_for(panel, **options)
        outputs = {}
        for k, name in enumerate(names[at : at + batch], at):
            nodes, edges = parse_factor(named[name])
            outputs[f"_factor_{k}"] = compile_graph(nodes, edges, None, b).factor or b.element(NULL)
        df = b.run(df, outputs, [*(panel.columns if at + batch < len(names) else dict.fromkeys(keep)), *done])
        done += list(outputs)
    return df.select(*keep, *(F.col(c).alias(name) for c, name in zip(done, names, strict=True)))

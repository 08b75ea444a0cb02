"""A graph as a standalone PySpark program: it needs nothing but PySpark."""

from __future__ import annotations

from panelfactor.functions.nullsafe import finite
from panelfactor.plans.builder import Builder
from panelfactor.plans.expression import expression
from panelfactor.plans.graph import GraphEdge, GraphNode, Settings, compile_graph
from panelfactor.plans.run import FIELDS


def export_pyspark(nodes: list[GraphNode], edges: list[GraphEdge], settings: Settings | None = None, fields: tuple[str, ...] = FIELDS, row_id: bool = False, skew_estimator: str = "adjusted") -> str:
    """Source of compute_factor(df): df with columns timestamp, asset and prices, plus factor.

    Every shared node is emitted once.  Skewness and kurtosis default to the
    adjusted estimators of statistics packages.
    """
    order = ("timestamp", "_row_id") if row_id else ("timestamp",)
    compiled = compile_graph(nodes, edges, settings, Builder(order=order, fields=frozenset(fields), skew_estimator=skew_estimator))
    text, _ = expression(nodes, edges, settings)
    if compiled.factor is None or not compiled.supported:
        raise ValueError("; ".join(compiled.warnings))
    out = ["from pyspark.sql import DataFrame", "", "", "def compute_factor(df: DataFrame) -> DataFrame:", f'    """{text}"""'.replace("\\", "\\\\"), "    keep = [c for c in df.columns if c != 'factor']"]
    for layer in compiled.builder.layers([compiled.factor]):
        out.append("    df = df.selectExpr(")
        out.append('        "*",')
        out += [f"        {f'{n.sql} AS {n.name}'!r}," for n in layer]
        out.append("    )")
    last = f"{finite(f'CAST({compiled.factor} AS DOUBLE)')} AS factor"
    out += [f"    return df.selectExpr(*keep, {last!r})", ""]
    return "\n".join(out)


def export_sql(nodes: list[GraphNode], edges: list[GraphEdge], settings: Settings | None = None, table: str = "panel", fields: tuple[str, ...] = FIELDS) -> str:
    """The same as one Spark SQL query over a table."""
    compiled = compile_graph(nodes, edges, settings, Builder(fields=frozenset(fields)))
    if compiled.factor is None or not compiled.supported:
        raise ValueError("; ".join(compiled.warnings))
    steps, before = [], table
    for k, layer in enumerate(compiled.builder.layers([compiled.factor])):
        steps.append(f"step_{k} AS (SELECT *, {', '.join(f'{n.sql} AS {n.name}' for n in layer)} FROM {before})")
        before = f"step_{k}"
    last = f"SELECT asset, timestamp, {finite(f'CAST({compiled.factor} AS DOUBLE)')} AS factor FROM {before}"
    return f"WITH {', '.join(steps)} {last}" if steps else last

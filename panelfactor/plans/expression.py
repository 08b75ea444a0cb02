"""A graph as readable text."""

from __future__ import annotations

import re
from decimal import Decimal
from graphlib import CycleError, TopologicalSorter

from panelfactor.plans import blocks
from panelfactor.plans.graph import GraphEdge, GraphNode, Settings, bind

_SLOT = re.compile(r"\{(\w+)(?:\|([^}]*))?\}")


#: decimals of a number in a text; what they cannot show is in exponent form
DECIMALS = 8


def number_text(value: float | bool | str) -> str:
    """A parameter's text."""
    if isinstance(value, (str, bool)):
        return str(value).lower() if isinstance(value, bool) else value
    exact = Decimal(repr(float(value)))
    tiny = 0 < abs(exact) < Decimal(1).scaleb(-DECIMALS)
    return format((exact if tiny else round(exact, DECIMALS) + 0).normalize(), "e" if tiny else "f")


def _reached(output: GraphNode, nodes: list[GraphNode], edges: list[GraphEdge], warn) -> tuple[dict[str, tuple[GraphNode, dict[str, GraphNode]]], list[str]]:
    """The nodes that the output depends on with their sources by port, and their names with sources first.

    Of a cycle, the node that is nearest the output is cut off from the
    others, which then show its label.
    """
    known = {n.id: n for n in nodes}
    found: dict[str, tuple[GraphNode, dict[str, GraphNode]]] = {}
    todo = [output]
    while todo:
        node = todo.pop(0)
        if node.id not in found:
            sources, notes, faults = bind(node, known, edges)
            found[node.id] = node, sources
            todo += sources.values()
            for text in notes + faults:
                warn(text)
    distance = {name: k for k, name in enumerate(found)}
    needs = {name: {s.id for s in sources.values()} for name, (_, sources) in found.items()}
    while True:
        try:
            return found, list(TopologicalSorter(needs).static_order())
        except CycleError as error:
            ring = set(error.args[1])
            nearest = min(ring, key=distance.get)
            warn(f"{found[nearest][0].label}: the edges form a cycle")
            for name in ring:
                needs[name].discard(nearest)


def expression(nodes: list[GraphNode], edges: list[GraphEdge], settings: Settings | None = None) -> tuple[str, list[str]]:
    """The text of the graph's output, and warnings."""
    settings = settings or Settings()
    output = next((n for n in nodes if n.is_output), None)
    if output is None:
        return "", ["there is no factor output"]
    warnings: dict[str, None] = {}  # in order, each once

    def warn(text: str) -> None:
        warnings[text] = None

    found, order = _reached(output, nodes, edges, warn)
    done: dict[str, str] = {}

    def render(node: GraphNode, inputs: dict[str, str]) -> str:
        block = blocks.get(node.block)
        if block is None:
            warn(f"{node.label}: unknown block")
            return node.label
        if block.id == "custom_formula":
            text = (node.custom_expression or "").strip()
            x = inputs.get("series", "value")
            if not text:
                warn(f"{node.label}: the custom formula is empty")
                return x
            if not re.search(r"\bx\b", text):
                warn(f"{node.label}: the custom formula should use x")
            return re.sub(r"\bx\b", lambda _: x, text)
        p = blocks.Params(node.parameters, settings.window, settings.min_samples, settings.descending)
        own = {"window": str(p.window), "least": str(p.least), "direction": "desc" if p.descending else "asc"}
        base = {q.id: q.default for q in block.parameters}

        def slot(m: re.Match) -> str:
            name, other = m[1], m[2]
            if name in inputs:
                return inputs[name]
            if other is not None and other not in base:
                return other
            key = other or name
            if key in own:
                return own[key]
            value = node.parameters.get(key)
            return number_text(base[key] if value is None else value)

        return _SLOT.sub(slot, block.text)

    for name in order:
        node, sources = found[name]
        done[name] = render(node, {port: done.get(s.id, s.label) for port, s in sources.items()})
    return done[output.id], list(warnings)


def describe(nodes: list[GraphNode], edges: list[GraphEdge], settings: Settings | None = None) -> str:
    """A sentence that names the blocks in use, inputs first."""
    text, _ = expression(nodes, edges, settings)
    output = next((n for n in nodes if n.is_output), None)
    found, order = _reached(output, nodes, edges, lambda _: None) if output else ({}, [])
    steps = [found[i][0].label for i in order if not found[i][0].is_output]
    return f"The factor uses, in this order: {', '.join(dict.fromkeys(steps))}. Its expression is {text}." if steps else f"The factor is not complete yet. Expression: {text}."


def supported_locally(text: str) -> bool:
    """Whether a text is of the fixed factor's form (kept for older callers)."""
    return text.startswith("Cs_ZScore(Ts_Rank(Close / Open")

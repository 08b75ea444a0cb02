"""Catalogue of blocks: ports, parameters and how each one compiles.

`text` is the block's readable form: {port} is an input's text, {port|word}
with a stand-in where nothing is connected, {name} a parameter.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from panelfactor.functions.nullsafe import NULL, literal
from panelfactor.operators import crosssection as cs
from panelfactor.operators import elementwise as ew
from panelfactor.operators import logic
from panelfactor.operators import timeseries as ts
from panelfactor.plans.builder import Builder


@dataclass(frozen=True)
class Port:
    id: str
    type: str = "series"  # table, series, scalar or boolean
    required: bool = True


@dataclass(frozen=True)
class Parameter:
    id: str
    default: float | bool
    type: str = "number"
    min: float | None = None
    max: float | None = None
    step: float | None = None


@dataclass(frozen=True)
class Block:
    id: str
    category: str
    text: str
    compile: Callable[[Builder, dict[str, str], Params], str]
    inputs: tuple[Port, ...] = ()
    parameters: tuple[Parameter, ...] = ()
    output: str = "series"
    kind: str = "operator"
    registered: bool = True
    semantic: str = ""


@dataclass
class Params:
    """A node's parameters with fallbacks: a value of the wrong type, or one that is not finite, is the default."""

    own: dict[str, Any] = field(default_factory=dict)
    window_default: float = 5
    least_default: float = 5
    descending_default: bool = True

    def number(self, name: str, default: float) -> float:
        v = self.own.get(name)
        return v if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else default

    def flag(self, name: str, default: bool) -> bool:
        v = self.own.get(name)
        return v if isinstance(v, bool) else default

    @property
    def window(self) -> int:
        return max(2, _round(self.number("window", self.window_default)))

    @property
    def least(self) -> int:
        return max(1, min(self.window, _round(self.number("min_samples", self.least_default))))

    @property
    def lag(self) -> int:
        return max(1, _round(self.number("lag", 1)))

    @property
    def descending(self) -> bool:
        return self.flag("descending", self.descending_default)


def _round(x: float) -> int:
    """Halves go up."""
    return math.floor(x + 0.5)


X = Port("series")
LEFT, RIGHT = Port("left"), Port("right")
WINDOW = Parameter("window", 5, min=2, max=5000, step=1)
LEAST = Parameter("min_samples", 5, min=1, max=5000, step=1)
LAG = Parameter("lag", 1, min=1, max=5000, step=1)
TOLERANCE = Parameter("std_tolerance", 0, min=0, step=0.00001)
DESCENDING = Parameter("descending", True, type="select")
QUANTILE = Parameter("quantile", 0.8, min=0, max=1, step=0.05)
THRESHOLD = Parameter("threshold", 0, step=0.01)


def _or(b: Builder, inputs: dict[str, str], port: str, value: float) -> str:
    return inputs[port] if port in inputs else b.element(literal(value))


def _get(b: Builder, inputs: dict[str, str], port: str) -> str:
    return inputs[port] if port in inputs else b.element(NULL)


def _fields() -> list[Block]:
    titles = {"open": "Open", "high": "High", "low": "Low", "close": "Close", "volume": "Volume", "amount": "Amount", "vwap": "VWAP"}
    out = [Block("market_data", "data", "MarketData", lambda b, i, p: b.element(NULL), output="table", kind="input", semantic="MarketData")]
    for name, title in titles.items():
        out.append(Block(f"field_{name}", "data", title, lambda b, i, p, name=name: b.field(name), kind="input", semantic=title))
    return out


def _math() -> list[Block]:
    def two(id_: str, op, sign: str, semantic: str) -> Block:
        return Block(id_, "math", f"({{left|value}} {sign} {{right|value}})", lambda b, i, p: op(b, _get(b, i, "left"), _get(b, i, "right")), (LEFT, RIGHT), semantic=semantic)

    def named(id_: str, op, semantic: str) -> Block:
        return Block(id_, "math", f"{semantic}({{left|value}}, {{right|value}})", lambda b, i, p: op(b, _get(b, i, "left"), _get(b, i, "right")), (LEFT, RIGHT), semantic=semantic)

    def one(id_: str, op, semantic: str, text: str | None = None) -> Block:
        return Block(id_, "math", text or f"{semantic}({{series|value}})", lambda b, i, p: op(b, _get(b, i, "series")), (X,), semantic=semantic)

    return [
        two("add", ew.add, "+", "Add"),
        two("subtract", ew.subtract, "-", "Subtract"),
        two("multiply", ew.multiply, "*", "Multiply"),
        two("divide", ew.divide, "/", "Divide"),
        Block("power", "math", "Pow({left|value}, {right|exponent})", lambda b, i, p: ew.power(b, _get(b, i, "left"), _or(b, i, "right", p.number("exponent", 2))), (LEFT, Port("right", "scalar", False)), (Parameter("exponent", 2, step=0.1),), semantic="Power"),
        one("abs", ew.absolute, "Abs"),
        one("negate", ew.negate, "Negate", "(-{series|value})"),
        one("log", ew.log, "Log"),
        one("exp", ew.exp, "Exp"),
        one("sqrt", ew.sqrt, "Sqrt"),
        one("sign", ew.sign, "Sign"),
        named("maximum", ew.maximum, "Maximum"),
        named("minimum", ew.minimum, "Minimum"),
        Block(
            "clip",
            "math",
            "Clip({series|value}, {low|low}, {high|high})",
            lambda b, i, p: ew.clip(b, _get(b, i, "series"), _or(b, i, "low", p.number("low", -1)), _or(b, i, "high", p.number("high", 1))),
            (X, Port("low", "scalar", False), Port("high", "scalar", False)),
            (Parameter("low", -1, step=0.01), Parameter("high", 1, step=0.01)),
            semantic="Clip",
        ),
    ]


def _logic() -> list[Block]:
    def comparison(id_: str, sign: str, semantic: str) -> Block:
        return Block(id_, "logic", f"({{left|value}} {'==' if sign == '=' else sign} {{right|threshold}})", lambda b, i, p: logic.compare(b, sign, _get(b, i, "left"), _or(b, i, "right", p.number("threshold", 0))), (LEFT, Port("right", required=False)), (THRESHOLD,), "boolean", semantic=semantic)

    def connective(id_: str, word: str, semantic: str) -> Block:
        return Block(id_, "logic", f"({{left|false}} {word} {{right|false}})", lambda b, i, p: logic.connect(b, word, _get(b, i, "left"), _get(b, i, "right")), (Port("left", "boolean"), Port("right", "boolean")), output="boolean", semantic=semantic)

    return [
        comparison("greater", ">", "Greater"),
        comparison("less", "<", "Less"),
        comparison("equal", "=", "Equal"),
        connective("and", "AND", "And"),
        connective("or", "OR", "Or"),
        Block("not", "logic", "(NOT {condition|false})", lambda b, i, p: logic.negation(b, _get(b, i, "condition")), (Port("condition", "boolean"),), output="boolean", semantic="Not"),
        Block("where", "logic", "Where({condition|false}, {when_true|value}, {when_false|value})", lambda b, i, p: logic.where(b, _get(b, i, "condition"), _get(b, i, "when_true"), _get(b, i, "when_false")), (Port("condition", "boolean"), Port("when_true"), Port("when_false")), semantic="Where"),
        Block("fill_missing", "logic", "FillMissing({series|value}, {value|value})", lambda b, i, p: logic.fill_missing(b, _get(b, i, "series"), _or(b, i, "value", p.number("value", 0))), (X, Port("value", "scalar", False)), (Parameter("value", 0, step=0.01),), semantic="FillMissing"),
    ]


def _timeseries() -> list[Block]:
    def lagged(id_: str, op, semantic: str) -> Block:
        return Block(id_, "timeseries", f"{semantic}({{series|value}}, {{lag}})", lambda b, i, p: op(b, _get(b, i, "series"), p.lag), (X,), (LAG,), semantic=semantic)

    def rolled(id_: str, op, text: str, semantic: str) -> Block:
        return Block(id_, "timeseries", f"Ts_{text}({{series|MarketData}}, {{window}})", lambda b, i, p: op(b, _get(b, i, "series"), p.window, p.least), (X,), (WINDOW, LEAST), semantic=semantic)

    return [
        lagged("ts_ref", ts.ref, "Ref"),
        lagged("ts_delta", ts.delta, "Delta"),
        lagged("ts_pct_change", ts.pct_change, "PctChange"),
        rolled("ts_mean", ts.mean, "Mean", "Mean"),
        rolled("ts_sum", ts.total, "Sum", "Sum"),
        rolled("ts_std", ts.std, "Std", "Std"),
        rolled("ts_min", ts.low, "Min", "Min"),
        rolled("ts_max", ts.high, "Max", "Max"),
        Block("ts_rank", "timeseries", "Ts_Rank({series|Close / Open}, {window}, {direction}, min_samples={least})", lambda b, i, p: ts.rank(b, _get(b, i, "series"), p.window, p.least, p.descending), (X,), (WINDOW, LEAST, DESCENDING), semantic="Rank"),
        Block("ts_quantile", "timeseries", "Ts_Quantile({series|MarketData}, {window}, {quantile})", lambda b, i, p: ts.quantile(b, _get(b, i, "series"), p.window, p.least, p.number("quantile", 0.8)), (X,), (WINDOW, LEAST, QUANTILE), semantic="Quantile"),
        Block("ts_corr", "timeseries", "Ts_Corr({left|value}, {right|value}, {window}, std_tolerance={std_tolerance})", lambda b, i, p: ts.corr(b, _get(b, i, "left"), _get(b, i, "right"), p.window, p.least, p.number("std_tolerance", 0)), (LEFT, RIGHT), (WINDOW, LEAST, TOLERANCE), semantic="Corr"),
        Block("ts_cov", "timeseries", "Ts_Cov({left|value}, {right|value}, {window})", lambda b, i, p: ts.cov(b, _get(b, i, "left"), _get(b, i, "right"), p.window, p.least), (LEFT, RIGHT), (WINDOW, LEAST), semantic="Cov"),
        rolled("ts_slope", ts.slope, "Slope", "Slope"),
        Block("ts_rsquare", "timeseries", "Ts_Rsquare({series|MarketData}, {window}, std_tolerance={std_tolerance})", lambda b, i, p: ts.rsquare(b, _get(b, i, "series"), p.window, p.least, p.number("std_tolerance", 0)), (X,), (WINDOW, LEAST, TOLERANCE), semantic="Rsquare"),
        rolled("ts_argmax", ts.argmax, "ArgMax", "IdxMax"),
        rolled("ts_argmin", ts.argmin, "ArgMin", "IdxMin"),
        rolled("ts_skew", ts.skew, "Skew", "Skew"),
        rolled("ts_kurt", ts.kurt, "Kurt", "Kurt"),
        rolled("ts_residual", ts.residual, "Residual", "Resi"),
    ]


def _crosssection() -> list[Block]:
    def one(id_: str, op, semantic: str) -> Block:
        return Block(id_, "crosssection", f"{semantic}({{series|MarketData}})", lambda b, i, p: op(b, _get(b, i, "series")), (X,), semantic=semantic)

    return [
        one("cs_rank", cs.rank, "Cs_Rank"),
        one("cs_zscore", cs.zscore, "Cs_ZScore"),
        one("cs_mean", cs.mean, "Cs_Mean"),
        one("cs_std", cs.std, "Cs_Std"),
        one("cs_min", cs.low, "Cs_Min"),
        one("cs_max", cs.high, "Cs_Max"),
        one("cs_center", cs.center, "Cs_Center"),
        one("cs_scale", cs.scale, "Cs_Scale"),
        Block("cs_neutralize", "crosssection", "Cs_Neutralize({series|value}, {exposure|value})", lambda b, i, p: cs.neutralize(b, _get(b, i, "series"), _get(b, i, "exposure")), (X, Port("exposure")), semantic="Cs_Neutralize"),
    ]


def _catalogue() -> dict[str, Block]:
    blocks = [
        *_fields(),
        Block("constant", "constants", "{value}", lambda b, i, p: b.element(literal(p.number("value", 1))), (), (Parameter("value", 1, step=0.01),), "scalar", semantic="Constant"),
        *_math(),
        *_logic(),
        *_timeseries(),
        *_crosssection(),
        Block("factor_output", "output", "{value|factor_value}", lambda b, i, p: _get(b, i, "value"), (Port("value"),), kind="output", semantic="FactorOutput"),
        # kept for older graphs and for user formulas
        Block("custom_formula", "custom", "", None, (X,), registered=False, semantic="CustomFormula"),
        Block("close_open_ratio", "math", "Close / Open", lambda b, i, p: ew.divide(b, b.field("close"), b.field("open")), registered=False, semantic="CloseOpenRatio"),
    ]
    return {x.id: x for x in blocks}


BLOCKS = _catalogue()
CATEGORIES = ("data", "constants", "math", "logic", "timeseries", "crosssection", "output")

# Earlier names of blocks
ALIASES = {
    "open_field": "field_open",
    "high_field": "field_high",
    "low_field": "field_low",
    "close_field": "field_close",
    "volume_field": "field_volume",
    "amount_field": "field_amount",
    "vwap_field": "field_vwap",
    "condition": "where",
}


def registered() -> list[Block]:
    return [x for x in BLOCKS.values() if x.registered]


def canonical(block_id: str | None) -> str | None:
    return ALIASES.get(block_id, block_id) if block_id else None


def get(block_id: str | None) -> Block | None:
    return BLOCKS.get(block_id) or BLOCKS.get(canonical(block_id)) if block_id else None


def defaults(block_id: str | None) -> dict[str, float | bool]:
    found = get(block_id)
    return {p.id: p.default for p in found.parameters} if found else {}


def connectable(source: str, target: str) -> bool:
    """Whether a port of type `target` takes an output of type `source`: the same type, or a scalar for a series."""
    return source == target or (source == "scalar" and target == "series")

"""Expression DAG to layered DataFrame.

Operators add nodes to a Builder.  A node is one column: SQL text over other
nodes' names.  Equal text is one node, so whatever is used twice is computed
once, over all factors of a plan.

`run` groups nodes into layers.  Window nodes go to the first stage that their
inputs allow, all `asset` windows of a stage in one select and all `timestamp`
windows in the next; element-wise nodes follow in the stage of their inputs.
A plan hence has one exchange and sort by asset, and one by timestamp, for each
alternation between them and not for each operator, and Catalyst sees plain
columns that it can prune and fuse.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfactor.functions.nullsafe import finite
from panelfactor.operators import frames
from panelfactor.plans.partitions import partitions, spread
from panelfactor.plans.session import compiled

ASSET, TIMESTAMP, ROW_ID = "asset", "timestamp", "_row_id"
POSITION, BUCKET, OWN = "_position", "_bucket", "_own"
#: frames of up to so many rows are read row by row, all over one sort of rows
#: that are still narrow; halves sort rows that carry all earlier results again,
#: three times a stage, which costs more memory than it saves time below this
NARROW = 64
#: from so many narrow frames on a plan reads them by columns in tasks (`operators/frames`), not by window functions
MANY = 16
_WINDOWS = ("forward", "backward", "asset", "timestamp")
_GATHERED = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_NAME = re.compile(r"\bn_\d+\b")
_CALL = re.compile(r"(\w+)\((n_\d+)(?:, (n_\d+))?\)")


@dataclass(frozen=True)
class Node:
    name: str
    sql: str
    kind: str  # field, element, forward, backward, asset or timestamp
    type: str  # number or boolean
    stage: int
    level: int
    reach: int = 0  # rows of the asset before the current one that it looks at
    call: str = ""  # of a section: the aggregate, or the column that it ranks
    frame: tuple[str, ...] = ()  # of a narrow frame: the aggregate and what it is applied to


@dataclass(frozen=True)
class Split:
    """How to split assets: buckets of `rows` rows.

    `slot` is SQL text that does not fall with time and of which one value's
    rows of an asset fit a task, such as the day or month; rows are numbered
    by it first, so that no task has to hold an asset.
    """

    rows: int = 100_000
    slot: str = "substr(timestamp, 1, 7)"


@dataclass
class Builder:
    """Collects the nodes of any number of factors over one panel."""

    order: tuple[str, ...] = (TIMESTAMP,)
    fields: frozenset[str] = frozenset({"open", "high", "low", "close", "volume", "amount", "vwap"})
    skew_estimator: str = "runtime"
    split: Split | None = None
    large_sections: bool = False
    nodes: dict[str, Node] = field(default_factory=dict)
    _known: dict[tuple[str, str], str] = field(default_factory=dict)

    def _add(self, sql: str, kind: str, type_: str = "number", reach: int = 0, call: str = "", frame: tuple[str, ...] = ()) -> str:
        if (kind, sql) in self._known:
            return self._known[kind, sql]
        inputs = [self.nodes[n] for n in _NAME.findall(sql)]
        stage = max([0, *(i.stage for i in inputs)])
        if kind in _WINDOWS:
            stage, level = stage + 1, 0
        else:
            level = 1 + max([0, *(i.level for i in inputs if i.stage == stage)])
        name = f"n_{len(self.nodes)}"
        self.nodes[name] = Node(name, sql, kind, type_, stage, level, reach, call, frame)
        self._known[kind, sql] = name
        return name

    # nodes

    def field(self, name: str) -> str:
        return self._add(finite(f"CAST(`{name}` AS DOUBLE)") if name in self.fields else "CAST(NULL AS DOUBLE)", "field", "number")

    def element(self, sql: str, boolean: bool = False) -> str:
        return self._add(sql, "element", "boolean" if boolean else "number")

    def rolling(self, call: str, window: int, *frame: str) -> str:
        """call over the last `window` rows of the asset; frame: its name and arguments where call is not of that form."""
        if not frame and (plain := _CALL.fullmatch(call)):
            frame = tuple(x for x in plain.groups() if x)
        known = frame if frame and frame[0] in frames.CALLS and window <= NARROW else ()
        return self._add(f"{call} OVER ({self._by_asset()} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)", "asset", "number", window - 1, frame=known)

    def lag(self, x: str, n: int) -> str:
        return self._add(f"lag({x}, {n}) OVER ({self._by_asset()})", "asset", self.nodes[x].type, n)

    def position(self) -> str:
        """The row's number within its asset, from 1."""
        if self.split:
            return self._add(f"CAST({POSITION} AS DOUBLE)", "element")
        return self._add(f"CAST(row_number() OVER ({self._by_asset()}) AS DOUBLE)", "asset")

    def block(self, window: int) -> str:
        """The number of the row's block of `window` rows, from 0."""
        return self.element(f"CAST(floor(({self.position()} - 1D) / {window}D) AS BIGINT)")

    def forward(self, call: str, window: int) -> str:
        """call over the rows of the block up to the current one."""
        return self._add(f"{call} OVER (PARTITION BY {ASSET}, {self.block(window)} ORDER BY {self.position()} {_GATHERED})", "forward")

    def backward(self, call: str, window: int) -> str:
        """call over the rows of the block from its end back to the current one."""
        return self._add(f"{call} OVER (PARTITION BY {ASSET}, {self.block(window)} ORDER BY {self.position()} DESC {_GATHERED})", "backward")

    def before(self, gathered: str, window: int) -> str:
        """The frame's part of the block before, from what `backward` gathered; null where the frame has none."""
        at = f"OVER (PARTITION BY {ASSET} ORDER BY {self.position()})"
        block = self.block(window)
        other = self._add(f"lag({block}, {window - 1}) {at}", "asset", reach=window - 1)
        value = self._add(f"lag({gathered}, {window - 1}) {at}", "asset", reach=window - 1)
        return self.element(f"CASE WHEN {other} <> {block} THEN {value} END")

    def halves(self, call: str, window: int) -> tuple[str, str]:
        """call over the frame's part of the row's own block, and over its part of the block before."""
        return self.forward(call, window), self.before(self.backward(call, window), window)

    def section(self, call: str) -> str:
        """call over the rows of the timestamp."""
        return self._add(f"{call} OVER (PARTITION BY {TIMESTAMP})", "timestamp", call=call)

    def section_rank(self, x: str) -> tuple[str, str]:
        """How many values of the timestamp are below x, and how many equal it; undefined where x is null."""
        order = f"(PARTITION BY {TIMESTAMP} ORDER BY {x} ASC NULLS LAST"
        below = self._add(f"CAST(rank() OVER {order}) - 1 AS BIGINT)", "timestamp", call=x)
        return below, self._add(f"count({x}) OVER {order} RANGE BETWEEN CURRENT ROW AND CURRENT ROW)", "timestamp", call=x)

    def _by_asset(self) -> str:
        return f"PARTITION BY {ASSET} ORDER BY {', '.join(self.order)}"

    # conversions

    def type(self, x: str) -> str:
        return self.nodes[x].type

    def number(self, x: str) -> str:
        return self.element(f"CAST({x} AS DOUBLE)") if self.type(x) == "boolean" else x

    def truth(self, x: str) -> str:
        return x if self.type(x) == "boolean" else self.element(f"{x} <> 0D", boolean=True)

    def finite(self, sql: str) -> str:
        return self.element(finite(self.element(sql)))

    # plan

    def needed(self, outputs: list[str]) -> list[Node]:
        seen: dict[str, Node] = {}
        todo = list(outputs)
        while todo:
            n = todo.pop()
            if n not in seen:
                seen[n] = self.nodes[n]
                todo += _NAME.findall(self.nodes[n].sql)
        return [n for name, n in self.nodes.items() if name in seen]

    def layers(self, outputs: list[str], late: bool = False) -> list[list[Node]]:
        """The nodes that outputs need, in order of computation, those of one select together; late: frames as late as they can, to be read together."""
        groups: dict[tuple, list[Node]] = {}
        for n in self._late(outputs) if late else self.needed(outputs):
            # a stage begins in the direction in which the one before ended, which saves a sort
            turn = {"forward": n.stage % 2 == 0, "backward": n.stage % 2 == 1, "asset": 2, "timestamp": 3, "field": 4, "element": 4}
            groups.setdefault((n.stage, int(turn[n.kind]), n.level), []).append(n)
        return [groups[k] for k in sorted(groups)]

    def _late(self, outputs: list[str]) -> list[Node]:
        """The needed nodes, frames moved to the last stage that the windows over them allow."""
        nodes = self.needed(outputs)
        last = max(n.stage for n in nodes if n.frame)
        until: dict[str, int] = {}
        for n in reversed(nodes):
            own = n.stage - 1 if n.kind in _WINDOWS else until.get(n.name, last)
            for x in _NAME.findall(n.sql):
                until[x] = min(until.get(x, last), own)
        placed: dict[str, Node] = {}
        for n in nodes:
            inputs = [placed[x] for x in _NAME.findall(n.sql)]
            if n.frame:
                n = replace(n, stage=max(n.stage, until.get(n.name, last)))
            elif n.kind not in _WINDOWS:
                stage = max([0, *(i.stage for i in inputs)])
                n = replace(n, stage=stage, level=1 + max([0, *(i.level for i in inputs if i.stage == stage)]))
            placed[n.name] = n
        return list(placed.values())

    def run(self, panel: DataFrame, outputs: dict[str, str], keep: list[str] | None = None) -> DataFrame:
        """panel's columns `keep` (default: all) and the output nodes under their names, as finite doubles."""
        keep = panel.columns if keep is None else keep
        held = {*keep, ASSET, *self.order, TIMESTAMP, POSITION, BUCKET, OWN}
        many = sum(bool(n.frame) for n in self.needed(list(outputs.values()))) >= MANY and frames.plain(panel, held)
        layers = self.layers(list(outputs.values()), many)
        compiled(panel.sparkSession)
        df, lent, n, dealt = numbered(panel, self.split, self.order) if self.split else panel, False, partitions(panel), None
        for k, layer in enumerate(layers):
            by_asset = layer[0].kind in ("forward", "backward", "asset")
            if self.split and by_asset and not lent:
                df, lent = lend(df, self.split, self._reach(layers[k:])), True
            if lent and layer[0].kind == "timestamp":
                df, lent = df.where(OWN).drop(BUCKET, OWN), False
            keys = ([ASSET, BUCKET] if lent else [ASSET]) if by_asset else [TIMESTAMP] if layer[0].kind == "timestamp" and not self.large_sections else dealt
            if keys != dealt:
                df, dealt = spread(df, n, *keys), keys
            if self.large_sections and layer[0].kind == "timestamp":
                df, dealt = self._sections(df, layer), None
                continue
            key = f"PARTITION BY {ASSET}, {BUCKET}" if lent else f"PARTITION BY {ASSET}"
            read = [x for x in layer if many and x.frame]
            if len(read) < len(layer):
                df = df.selectExpr("*", *(f"{x.sql.replace(f'PARTITION BY {ASSET}', key)} AS {x.name}" for x in layer if x not in read))
            if read:
                later = {name for x in sum(layers[k + 1 :], []) for name in _NAME.findall(x.sql)}
                df, dealt = frames.read(df, [(x.name, x.frame[0], x.frame[1:], x.reach + 1) for x in read], keys, list(self.order), held | later | set(outputs.values())), None
        if lent:
            df = df.where(OWN)
        last = (f"{finite(f'CAST({n} AS DOUBLE)')} AS `{name}`" for name, n in outputs.items())
        return df.selectExpr(*(f"`{c}`" for c in keep), *last)

    @staticmethod
    def _sections(df: DataFrame, layer: list[Node]) -> DataFrame:
        from panelfactor.operators import sections

        plain = {n.name: n.call for n in layer if n.sql == f"{n.call} OVER (PARTITION BY {TIMESTAMP})"}
        ranks: dict[str, dict[str, str]] = {}
        for n in layer:
            if n.name not in plain:
                ranks.setdefault(n.call, {})["ties" if n.sql.startswith("count(") else "below"] = n.name
        df = sections.joined(df, plain) if plain else df
        for x, names in ranks.items():
            df = sections.ranked(df, x, **names)
        return df

    @staticmethod
    def _reach(layers: list[list[Node]]) -> int:
        """Rows before the current one that the windows by asset look at, up to the next section."""
        by_stage: dict[int, int] = {}
        for layer in layers:
            if layer[0].kind == "timestamp":
                break
            for n in layer:
                by_stage[n.stage] = max(by_stage.get(n.stage, 0), n.reach)
        return sum(by_stage.values())


def numbered(panel: DataFrame, split: Split, order: tuple[str, ...] = (TIMESTAMP,)) -> DataFrame:
    """panel with POSITION, each row's number within its asset, without any task holding an asset.

    Rows are counted by (asset, slot), the counts are summed over an asset's
    slots, and rows are numbered within their slot.  Both sides of the join are
    dealt by the same keys, which are never null, so rows move once.
    """
    keys = ["_key_asset", "_key_slot", "_no_asset", "_no_slot"]
    asset, slot = F.col(ASSET), F.col("_slot")
    named = {"_key_asset": F.coalesce(asset.cast("string"), F.lit("")), "_key_slot": F.coalesce(slot.cast("string"), F.lit("")), "_no_asset": asset.isNull(), "_no_slot": slot.isNull()}
    n = partitions(panel)
    slotted = spread(panel.withColumn("_slot", F.expr(split.slot)).withColumns(named), n, *keys)
    sizes = spread(slotted.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_slot").alias("_at")), n, "_key_asset", "_no_asset")
    starts = sizes.selectExpr(*keys, "coalesce(sum(_n) OVER (PARTITION BY _key_asset, _no_asset ORDER BY _at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS _start")
    joined = slotted.join(starts, keys)
    return joined.selectExpr(*(f"`{c}`" for c in panel.columns), f"_start + row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)}) AS {POSITION}")


def lend(df: DataFrame, split: Split, reach: int) -> DataFrame:
    """df in buckets of max(split.rows, reach) rows, each with the last `reach` rows of the bucket before (OWN is false on those)."""
    rows = max(split.rows, reach, 1)
    bucket = f"CAST(floor(({POSITION} - 1) / {rows}) AS BIGINT)"
    also = f"{POSITION} > ({bucket} + 1) * {rows} - {reach}"
    return df.selectExpr("*", f"inline(CASE WHEN {also} THEN array(struct({bucket} AS {BUCKET}, true AS {OWN}), struct({bucket} + 1 AS {BUCKET}, false AS {OWN})) ELSE array(struct({bucket} AS {BUCKET}, true AS {OWN})) END)")

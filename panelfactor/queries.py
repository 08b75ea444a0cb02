"""Queries over the driver's tables, each with independent DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfactor.operators import cleaning, legacy, quality
from panelfactor.plans import catalog
from panelfactor.plans.builder import Split
from panelfactor.plans.graph import GraphEdge, GraphNode, Settings, compile_graph
from panelfactor.plans.run import compute_factors, run_expression, run_graph
from panelfactor.sources import delimited
from panelfactor.sources.panels import EVENTS_SQL, LINEITEM_SQL, events_panel, lineitem_panel

Query = Callable[[SparkSession, str], DataFrame]


def graph(tree: tuple) -> tuple[list[GraphNode], list[GraphEdge]]:
    """A graph from nested (block, {port: tree}, {parameter: value} or formula)."""
    nodes: list[GraphNode] = []
    edges: list[GraphEdge] = []

    def add(t: tuple) -> str:
        block, inputs, more = (*t, {}, {})[:3] if len(t) < 3 else t
        name = f"{len(nodes)}-{block}"
        node = GraphNode(name, block, parameters=more if isinstance(more, dict) else {}, custom_expression=None if isinstance(more, dict) else more)
        nodes.append(node)
        for port, source in inputs.items():
            edges.append(GraphEdge(add(source), name, port))
        return name

    add(("factor_output", {"value": tree}))
    return nodes, edges


def rounded(x: str, digits: int) -> Column:
    """round(x, digits), which goes by decimal texts, only where doubles don't decide: near ties, and for large numbers."""
    scaled = F.col(x) * float(10**digits)
    sure = (F.abs(scaled) < 1e11) & (F.abs(scaled - F.rint(scaled)) < 0.499)
    return F.when(sure, F.rint(scaled) / float(10**digits)).otherwise(F.round(F.col(x), digits)) + F.lit(0.0)


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select("asset", "timestamp", *(rounded(n, digits).alias(n) for n in names))


#: prices are fractions with up to seven decimals, which six digits would round at ties
RAW = 9


def _block(tree: tuple, digits: int = 6, **options) -> Query:
    digits = RAW if tree[0].startswith("field_") else digits
    return lambda spark, d: _rounded(run_graph(lineitem_panel(spark, d), *graph(tree), **options).points, "factor", digits=digits)


R = ("divide", {"left": ("field_close",), "right": ("field_open",)})
Y = ("divide", {"left": ("field_close",), "right": ("field_vwap",)})
ONE = ("constant", {}, {"value": 1.0})
D = ("subtract", {"left": R, "right": ONE})
UP = ("greater", {"left": R}, {"threshold": 1})
Y_UP = ("greater", {"left": Y}, {"threshold": 1})
W = {"window": 7, "min_samples": 4}

BASE = f"""WITH {LINEITEM_SQL},
base AS (SELECT *, close / nullif(open, 0) AS r, close / nullif(vwap, 0) AS y, close / nullif(open, 0) - 1 AS d,
                row_number() OVER (PARTITION BY asset ORDER BY timestamp) AS rn FROM panel)"""
FRAME = "WINDOW w AS (PARTITION BY asset ORDER BY timestamp ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), a AS (PARTITION BY asset ORDER BY timestamp), t AS (PARTITION BY timestamp)"


def _sql(expr: str, base: str = BASE, source: str = "base", digits: int = 6) -> str:
    return f"{base} SELECT asset, timestamp, round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS factor FROM {source} {FRAME}"


def _gate(expr: str, x: str = "r", least: int = 4) -> str:
    return f"CASE WHEN count({x}) OVER w >= {least} THEN {expr} END"


#: per-frame lists with places from 1, for operators that depend on positions
LISTS = BASE + f", frames AS (SELECT asset, timestamp, r, list(r) OVER w AS l FROM base {FRAME}), pts AS (SELECT *, list_filter(list_zip(range(1, len(l) + 1), l), lambda p: p[2] IS NOT NULL) AS p FROM frames), means AS (SELECT *, list_avg(list_transform(p, lambda q: q[1])) AS mx, list_avg(list_transform(p, lambda q: q[2])) AS my FROM pts), sums AS (SELECT *, len(p) AS n, list_sum(list_transform(p, lambda q: (q[1] - mx) * (q[2] - my))) AS sxy, list_sum(list_transform(p, lambda q: (q[1] - mx) * (q[1] - mx))) AS sxx, list_sum(list_transform(p, lambda q: (q[2] - my) * (q[2] - my))) AS syy FROM means)"


def _listed(expr: str) -> str:
    return f"{LISTS} SELECT asset, timestamp, round(CASE WHEN n >= 4 THEN {expr} END, 6) + 0.0 AS factor FROM sums"


PAIRS = BASE + ", pairs AS (SELECT *, CASE WHEN y IS NOT NULL AND v IS NOT NULL THEN y END AS py, CASE WHEN y IS NOT NULL AND v IS NOT NULL THEN v END AS pv FROM (SELECT *, ln(volume) AS v FROM base))"
VOL = ("log", {"series": ("field_volume",)})
X = {"series": R}


def _strict(expr: str, *cols: str) -> str:
    return f"CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in cols)} THEN {expr} END"


def _yes(cond: str, *cols: str) -> str:
    return _strict(f"CASE WHEN {cond} THEN 1.0 ELSE 0.0 END", *cols)


def _ranked() -> str:
    return (
        f"{BASE}, k AS (SELECT asset, timestamp, (rank() OVER (PARTITION BY timestamp ORDER BY r) - 1 + (count(*) OVER (PARTITION BY timestamp, r) + 1) / 2.0) / count(*) OVER (PARTITION BY timestamp) AS f FROM base WHERE r IS NOT NULL)"
        " SELECT b.asset, b.timestamp, round(k.f, 6) + 0.0 AS factor FROM base b LEFT JOIN k USING (asset, timestamp)"
    )


_B = "(3.0 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)))"

#: block id: graph, SQL
BLOCK_CASES: dict[str, tuple[tuple, str]] = {
    "market_data": (("market_data",), _sql("CAST(NULL AS DOUBLE)")),
    **{f"field_{c}": ((f"field_{c}",), _sql(c, digits=RAW)) for c in ("open", "high", "low", "close", "volume", "amount", "vwap")},
    "constant": (("constant", {}, {"value": 2.5}), _sql("2.5")),
    "add": (("add", {"left": R, "right": Y}), _sql("r + y")),
    "subtract": (D, _sql("r - 1")),
    "multiply": (("multiply", {"left": R, "right": Y}), _sql("r * y")),
    "divide": (R, _sql("close / nullif(open, 0)")),
    "power": (("power", {"left": D}, {"exponent": 0.5}), _sql("CASE WHEN d >= 0 THEN sqrt(d) END")),
    "abs": (("abs", {"series": D}), _sql("abs(d)")),
    "negate": (("negate", {"series": D}), _sql("-d")),
    "log": (("log", {"series": D}), _sql("CASE WHEN d > 0 THEN ln(d) END")),
    "exp": (("exp", {"series": ("negate", {"series": R})}), _sql("exp(-r)")),
    "sqrt": (("sqrt", {"series": D}), _sql("CASE WHEN d >= 0 THEN sqrt(d) END")),
    "sign": (("sign", {"series": D}), _sql("CAST(sign(d) AS DOUBLE)")),
    "maximum": (("maximum", {"left": R, "right": Y}), _sql(_strict("greatest(r, y)", "r", "y"))),
    "minimum": (("minimum", {"left": R, "right": Y}), _sql(_strict("least(r, y)", "r", "y"))),
    "clip": (("clip", {"series": D}, {"low": -0.1, "high": 0.2}), _sql("CASE WHEN d < -0.1 THEN -0.1 WHEN d > 0.2 THEN 0.2 ELSE d END")),
    "greater": (UP, _sql(_yes("r > 1", "r"))),
    "less": (("less", {"left": R, "right": Y}), _sql(_yes("r < y", "r", "y"))),
    "equal": (("equal", {"left": ("field_close",), "right": ("field_open",)}), _sql(_yes("close = open", "close"))),
    "and": (("and", {"left": UP, "right": Y_UP}), _sql(_yes("r > 1 AND y > 1", "r", "y"))),
    "or": (("or", {"left": UP, "right": ("less", {"left": ("field_volume",)}, {"threshold": 20})}), _sql(_yes("r > 1 OR volume < 20", "r", "volume"))),
    "not": (("not", {"condition": UP}), _sql(_yes("r <= 1", "r"))),
    "where": (("where", {"condition": UP, "when_true": Y, "when_false": D}), _sql("CASE WHEN r > 1 THEN y WHEN r <= 1 THEN d END")),
    "fill_missing": (("fill_missing", {"series": R}, {"value": -1}), _sql("coalesce(r, -1.0)")),
    "ts_ref": (("ts_ref", X, {"lag": 3}), _sql("lag(r, 3) OVER a")),
    "ts_delta": (("ts_delta", X, {"lag": 2}), _sql("r - lag(r, 2) OVER a")),
    "ts_pct_change": (("ts_pct_change", X, {"lag": 1}), _sql("r / nullif(lag(r, 1) OVER a, 0) - 1")),
    "ts_mean": (("ts_mean", X, W), _sql(_gate("avg(r) OVER w"))),
    "ts_sum": (("ts_sum", X, W), _sql(_gate("sum(r) OVER w"))),
    "ts_std": (("ts_std", X, W), _sql(_gate("stddev_samp(r) OVER w"))),
    "ts_min": (("ts_min", X, W), _sql(_gate("min(r) OVER w"))),
    "ts_max": (("ts_max", X, W), _sql(_gate("max(r) OVER w"))),
    "ts_rank": (("ts_rank", X, {**W, "descending": False}), _listed("(len(list_filter(p, lambda q: q[2] > r)) + (len(list_filter(p, lambda q: q[2] = r)) + 1) / 2.0) / n * CASE WHEN r IS NULL THEN NULL ELSE 1 END")),
    "ts_quantile": (("ts_quantile", X, {**W, "quantile": 0.3}), _sql(_gate("quantile_cont(r, 0.3) OVER w"))),
    "ts_corr": (("ts_corr", {"left": Y, "right": VOL}, W), _sql("CASE WHEN count(py) OVER w >= 4 AND stddev_pop(py) OVER w > 0 AND stddev_pop(pv) OVER w > 0 THEN corr(py, pv) OVER w END", PAIRS, "pairs")),
    "ts_cov": (("ts_cov", {"left": Y, "right": VOL}, {"window": 7, "min_samples": 1}), _sql("CASE WHEN count(py) OVER w >= 1 THEN covar_pop(py, pv) OVER w END", PAIRS, "pairs")),
    "ts_slope": (("ts_slope", X, W), _listed("sxy / nullif(sxx, 0)")),
    "ts_rsquare": (("ts_rsquare", X, W), _listed("sxy * sxy / nullif(sxx * syy, 0)")),
    "ts_argmax": (("ts_argmax", X, W), _listed("CASE WHEN len(p) < len(l) THEN list_position(list_transform(l, lambda e: e IS NULL), true) ELSE list_position(l, list_max(l)) END")),
    "ts_argmin": (("ts_argmin", X, W), _listed("CASE WHEN len(p) < len(l) THEN list_position(list_transform(l, lambda e: e IS NULL), true) ELSE list_position(l, list_min(l)) END")),
    "ts_skew": (("ts_skew", X, W), _listed("CASE WHEN syy > 0 THEN sqrt(n * (n - 1.0)) / (n - 2) * (list_sum(list_transform(p, lambda q: pow(q[2] - my, 3))) / n) / pow(syy / n, 1.5) / n END")),
    "ts_kurt": (("ts_kurt", X, W), _listed(f"CASE WHEN syy > 0 THEN ((n - 1.0) / ((n - 2) * (n - 3)) * ((n + 1) * (list_sum(list_transform(p, lambda q: pow(q[2] - my, 4))) / n / pow(syy / n, 2) - 3) + 6) + {_B}) / n - {_B} END")),
    "ts_residual": (("ts_residual", X, W), _listed("r - (my + sxy / sxx * (len(l) - mx))")),
    "cs_rank": (("cs_rank", X), _ranked()),
    "cs_zscore": (("cs_zscore", X), _sql("(r - avg(r) OVER t) / nullif(CASE WHEN count(r) OVER t > 1 THEN stddev_pop(r) OVER t END, 0)")),
    "cs_mean": (("cs_mean", X), _sql(_strict("avg(r) OVER t", "r"))),
    "cs_std": (("cs_std", X), _sql(_strict("stddev_pop(r) OVER t", "r"))),
    "cs_min": (("cs_min", X), _sql(_strict("min(r) OVER t", "r"))),
    "cs_max": (("cs_max", X), _sql(_strict("max(r) OVER t", "r"))),
    "cs_center": (("cs_center", X), _sql("r - avg(r) OVER t")),
    "cs_scale": (("cs_scale", {"series": D}), _sql("d / nullif(sum(abs(d)) OVER t, 0)")),
    "cs_neutralize": (
        ("cs_neutralize", {"series": Y, "exposure": VOL}),
        _sql("CASE WHEN py IS NOT NULL AND count(py) OVER t >= 2 AND var_pop(pv) OVER t > 0 THEN py - (avg(py) OVER t + covar_pop(py, pv) OVER t / var_pop(pv) OVER t * (pv - avg(pv) OVER t)) END", PAIRS, "pairs"),
    ),
    "factor_output": (("field_open",), _sql("open", digits=RAW)),
    "close_open_ratio": (("close_open_ratio",), _sql("close / nullif(open, 0)")),
    "custom_formula": (("custom_formula", X, "where(x > 1 && !(x > 2), np.log(x) * 2, clip(-x**2, -3, -0.5)) + x % 0.3"), _sql("CASE WHEN r > 1 AND r <= 2 THEN ln(r) * 2 WHEN r IS NOT NULL THEN least(-0.5, greatest(-3.0, r * r)) END + (r - 0.3 * floor(r / 0.3))")),
}

FORMULA_CASES: dict[str, tuple[str, str]] = {
    "formula_math": ("max(abs(x - 1), sqrt(x), exp(-x)) + min(x, 1, pow(x, 2)) / (1 + log1p(x))", "greatest(abs(r - 1), sqrt(r), exp(-r)) + least(r, 1, r * r) / (1 + ln(1 + r))"),
    "formula_logic": ("ifelse(isnan(x), 0, x >= 1 || x < 0.5)", "CASE WHEN r >= 1 OR r < 0.5 THEN 1.0 ELSE 0.0 END"),
    "formula_isnan": ("isnan(x) * 2 + 1", "CASE WHEN r IS NULL THEN 3.0 ELSE 1.0 END"),
}

#: DuckDB forms of the rolling catalogue over named columns; {n} is the window and w its frame
_C1 = "c1 IS NOT NULL AND c IS NOT NULL"
ROLLING_SQL = {
    "ROC": "lag(c, {n}) OVER a / c",
    "MA": "avg(c) OVER w / c",
    "STD": "CASE WHEN count(c) OVER w > 1 THEN stddev_samp(c) OVER w END / c",
    "MAX": "max(h) OVER w / c",
    "MIN": "min(l) OVER w / c",
    "QTLU": "quantile_cont(c, 0.8) OVER w / c",
    "QTLD": "quantile_cont(c, 0.2) OVER w / c",
    "RSV": "(c - min(l) OVER w) / nullif(max(h) OVER w - min(l) OVER w + 1e-12, 0)",
    "CNTP": "avg(up) OVER w",
    "CNTN": "avg(dn) OVER w",
    "CNTD": "avg(up) OVER w - avg(dn) OVER w",
    "SUMP": "sum(cu) OVER w / (sum(ca) OVER w + 1e-12)",
    "SUMN": "sum(cd) OVER w / (sum(ca) OVER w + 1e-12)",
    "SUMD": "(sum(cu) OVER w - sum(cd) OVER w) / (sum(ca) OVER w + 1e-12)",
    "VMA": "avg(v) OVER w / (v + 1e-12)",
    "VSTD": "CASE WHEN count(v) OVER w > 1 THEN stddev_samp(v) OVER w END / (v + 1e-12)",
    "WVMA": "CASE WHEN count(wv) OVER w > 1 THEN stddev_samp(wv) OVER w END / (avg(wv) OVER w + 1e-12)",
    "VSUMP": "sum(vu) OVER w / (sum(va) OVER w + 1e-12)",
    "VSUMN": "sum(vd) OVER w / (sum(va) OVER w + 1e-12)",
    "VSUMD": "(sum(vu) OVER w - sum(vd) OVER w) / (sum(va) OVER w + 1e-12)",
    "CORR": "CASE WHEN count(pc) OVER w > 1 AND stddev_samp(c) OVER w > 2e-5 AND stddev_samp(lv) OVER w > 2e-5 AND stddev_pop(pc) OVER w > 0 AND stddev_pop(pl) OVER w > 0 THEN corr(pc, pl) OVER w END",
    "CORD": "CASE WHEN count(pq) OVER w > 1 AND stddev_samp(cq) OVER w > 2e-5 AND stddev_samp(lq) OVER w > 2e-5 AND stddev_pop(pq) OVER w > 0 AND stddev_pop(pz) OVER w > 0 THEN corr(pq, pz) OVER w END",
    "BETA": "sxy / nullif(sxx, 0) / c",
    "RSQR": "CASE WHEN n > 1 AND sqrt(syy / (n - 1)) > 2e-5 THEN sxy * sxy / (sxx * syy) END",
    "RESI": "(c - (my + sxy / nullif(sxx, 0) * (len(f) - mx))) / c",
    "RANK": "CASE WHEN c IS NOT NULL THEN (len(list_filter(p, lambda q: q[2] < c)) + (len(list_filter(p, lambda q: q[2] = c)) + 1) / 2.0) / n END",
    "IMAX": "hi / {n}",
    "IMIN": "li / {n}",
    "IMXD": "(hi - li) / {n}",
}


def _place(col: str, pick: str) -> str:
    return f"CASE WHEN list_sum(list_transform({col}, lambda e: CASE WHEN e IS NULL THEN 0 ELSE 1 END)) = 0 THEN NULL WHEN list_contains(list_transform({col}, lambda e: e IS NULL), true) THEN list_position(list_transform({col}, lambda e: e IS NULL), true) ELSE list_position({col}, {pick}({col})) END"


def _rolling_sql(n: int) -> str:
    """All rolling features of window n as columns."""
    frame = f"WINDOW w AS (PARTITION BY asset ORDER BY timestamp ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), a AS (PARTITION BY asset ORDER BY timestamp)"
    columns = ", ".join(f"round({sql.format(n=n)}, 6) + 0.0 AS {name}{n}" for name, sql in ROLLING_SQL.items())
    return f"""WITH {LINEITEM_SQL},
c0 AS (SELECT asset, timestamp, close AS c, high AS h, low AS l, volume AS v, ln(volume + 1) AS lv, lag(close) OVER a AS c1, lag(volume) OVER a AS v1 FROM panel WINDOW a AS (PARTITION BY asset ORDER BY timestamp)),
c2 AS (SELECT *, CASE WHEN c > c1 THEN 1.0 ELSE 0.0 END AS up, CASE WHEN c < c1 THEN 1.0 ELSE 0.0 END AS dn,
  CASE WHEN {_C1} THEN greatest(c - c1, 0) END AS cu, CASE WHEN {_C1} THEN greatest(c1 - c, 0) END AS cd, abs(c - c1) AS ca,
  CASE WHEN v IS NOT NULL AND v1 IS NOT NULL THEN greatest(v - v1, 0) END AS vu, CASE WHEN v IS NOT NULL AND v1 IS NOT NULL THEN greatest(v1 - v, 0) END AS vd, abs(v - v1) AS va,
  abs(c / c1 - 1) * v AS wv, c / c1 AS cq, ln(v / v1 + 1) AS lq FROM c0),
c3 AS (SELECT *, CASE WHEN lv IS NOT NULL THEN c END AS pc, CASE WHEN c IS NOT NULL THEN lv END AS pl, CASE WHEN lq IS NOT NULL THEN cq END AS pq, CASE WHEN cq IS NOT NULL THEN lq END AS pz FROM c2),
f0 AS (SELECT *, list(c) OVER w AS f, list(h) OVER w AS fh, list(l) OVER w AS fl FROM c3 {frame}),
f1 AS (SELECT *, list_filter(list_zip(range(1, len(f) + 1), f), lambda p: p[2] IS NOT NULL) AS p, CAST({_place('fh', 'list_max')} AS DOUBLE) AS hi, CAST({_place('fl', 'list_min')} AS DOUBLE) AS li FROM f0),
f2 AS (SELECT *, len(p) AS n, list_avg(list_transform(p, lambda q: q[1])) AS mx, list_avg(list_transform(p, lambda q: q[2])) AS my FROM f1),
f3 AS (SELECT *, list_sum(list_transform(p, lambda q: (q[1] - mx) * (q[2] - my))) AS sxy, list_sum(list_transform(p, lambda q: (q[1] - mx) * (q[1] - mx))) AS sxx, list_sum(list_transform(p, lambda q: (q[2] - my) * (q[2] - my))) AS syy FROM f2)
SELECT asset, timestamp, {columns} FROM f3 {frame}"""


def _rolling(n: int, **options) -> Query:
    names = [f"{name}{n}" for name in catalog.ROLLING]
    return lambda spark, d: _rounded(compute_factors(lineitem_panel(spark, d), names, keep=["asset", "timestamp"], **options), *names)


def _named(names: dict[str, str]) -> Query:
    return lambda spark, d: _rounded(compute_factors(lineitem_panel(spark, d), names, keep=["asset", "timestamp"]), *names)


def _lagged_sql(name: str) -> str:
    own = name.lower()
    base = "(volume + 1e-12)" if name == "VOLUME" else "close"
    cols = ", ".join(f"round({f'lag({own}, {k}) OVER a' if k else own} / {base}, 6) + 0.0 AS {name}{k}" for k in catalog.LAGS)
    return f"WITH {LINEITEM_SQL} SELECT asset, timestamp, {cols} FROM panel WINDOW a AS (PARTITION BY asset ORDER BY timestamp)"


CANDLE_SQL = {
    "KMID": "(close - open) / open",
    "KLEN": "(high - low) / open",
    "KMID2": "(close - open) / (high - low + 1e-12)",
    "KUP": f"(high - {_strict('greatest(open, close)', 'close')}) / open",
    "KUP2": f"(high - {_strict('greatest(open, close)', 'close')}) / (high - low + 1e-12)",
    "KLOW": f"({_strict('least(open, close)', 'close')} - low) / open",
    "KLOW2": f"({_strict('least(open, close)', 'close')} - low) / (high - low + 1e-12)",
    "KSFT": "(2 * close - high - low) / open",
    "KSFT2": "(2 * close - high - low) / (high - low + 1e-12)",
    "OPEN": "open / close",
    "HIGH": "high / close",
    "LOW": "low / close",
    "VWAP": "vwap / close",
}



def _candles(spark: SparkSession, d: str) -> DataFrame:
    names = {**catalog.CANDLES, **catalog.PRICES}
    return _rounded(compute_factors(events_panel(spark, d), names, keep=["asset", "timestamp"]), *names)


def event_rows(spark: SparkSession, d: str) -> DataFrame:
    """Single events as panel rows, with repeated keys and holes."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "event_type", "value")
    return e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH").alias("timestamp"),
        F.col("event_type").alias("asset"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("open"),
        F.when(F.col("event_id") % 13 == 0, 0.0).when(F.col("event_id") % 11 != 0, F.col("value") * 2).alias("close"),
        F.col("event_id").alias("_row_id"),
    )


EVENT_ROWS = """rows AS (SELECT strftime(ts, '%Y-%m-%dT%H') AS timestamp, event_type AS asset, CASE WHEN event_id % 17 <> 0 THEN value END AS open,
  CASE WHEN event_id % 13 = 0 THEN 0.0 WHEN event_id % 11 <> 0 THEN value * 2 END AS close, event_id AS _row_id FROM events)"""
_DEDUP = "one AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY timestamp, asset ORDER BY _row_id{}) = 1)"


def _cleaned(**options) -> Query:
    return lambda spark, d: cleaning.apply(event_rows(spark, d), cleaning.Cleaning(**options)).select("timestamp", "asset", "open", "close", "_row_id")


def _clean_sql(order: str = "", select: str = "open, close", where: str = "", dedup: bool = True) -> str:
    return f"WITH {EVENT_ROWS}{', ' + _DEDUP.format(order) if dedup else ''} SELECT timestamp, asset, {select}, _row_id FROM {'one' if dedup else 'rows'} {where}"


def _ffill(order: str) -> str:
    return ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY asset ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS {c}" for c in ("open", "close"))


#: event ids in a block of lines
PARSE_BLOCK = 50_000


def _parse(spark: SparkSession, d: str) -> delimited.Parsed:
    """Events as lines of a file, with quotes at the ends of cells and inside them."""
    e = spark.read.parquet(f"{d}/events.parquet")
    k = F.col("event_id")
    price = F.when(k % 19 == 0, "bad").when(k % 23 == 0, "").when(k % 5 == 0, F.concat(F.lit('1",'), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit('".5'))).otherwise(F.concat(F.lit('"1,'), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit('.5"')))
    owner = F.when(k % 29 == 0, F.concat(F.lit('u"x,""'), F.col("user_id").cast("string"), F.lit('"'))).otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    asset = F.when(k % 97 == 0, F.lit(" ")).otherwise(F.col("event_type"))
    body = e.select(F.concat_ws(",", k.cast("string"), asset, price, (k % 7).cast("string"), owner).alias("value"), F.lit("").alias("_file"), F.expr(f"event_id div {PARSE_BLOCK}").alias("_block"), k.cast("long").alias("_at"))
    head = spark.createDataFrame([('\ufeffDa"te", 代码 ,"开盘价",Close,owner', "", -(1 << 62), 0)], "value string, _file string, _block long, _at long").coalesce(1)
    return delimited.parse(head.union(body))


def _parse_rows(spark: SparkSession, d: str) -> DataFrame:
    return _parse(spark, d).rows.select("timestamp", "asset", "open", "close", F.col("extra")["owner"].alias("owner"), F.col("_row_id").alias("line"))


PARSE_SQL = """SELECT CAST(event_id AS VARCHAR) AS timestamp, event_type AS asset,
  CASE WHEN event_id % 19 = 0 OR event_id % 23 = 0 THEN NULL ELSE 1000 + event_id % 1000 + 0.5 END::DOUBLE AS open,
  CAST(event_id % 7 AS DOUBLE) AS close, CASE WHEN event_id % 29 = 0 THEN 'ux,"' || user_id ELSE 'u' || user_id END AS owner,
  row_number() OVER (ORDER BY event_id) + 1 AS line FROM events QUALIFY event_id % 97 <> 0"""

QUALITY_SQL = f"""WITH {EVENT_ROWS}, late AS (SELECT *, timestamp < lag(timestamp) OVER (PARTITION BY asset ORDER BY _row_id) AS late FROM rows)
SELECT count(*) AS rows, count(DISTINCT asset) AS assets, count(DISTINCT timestamp) AS dates, count(*) - count(DISTINCT (timestamp, asset)) AS duplicate_keys,
  count(*) FILTER (WHERE open IS NULL) + count(*) FILTER (WHERE close IS NULL) AS missing_values, 0::BIGINT AS invalid_numbers,
  count(*) FILTER (WHERE open = 0 OR close = 0) AS zero_prices, count(*) FILTER (WHERE late) AS out_of_order_rows,
  count(*) FILTER (WHERE open IS NULL) AS missing_open, count(*) FILTER (WHERE close IS NULL) AS missing_close FROM late"""

PARSE_ERRORS_SQL = """WITH numbered AS (SELECT *, row_number() OVER (ORDER BY event_id) + 1 AS line FROM events)
SELECT line, 'open' AS field, 'bad' AS raw, 'line ' || line || ': open: bad is not a number' AS message FROM numbered WHERE event_id % 19 = 0 AND event_id % 97 <> 0
UNION ALL SELECT line, 'key', '', 'line ' || line || ': timestamp and asset must not be empty' FROM numbered WHERE event_id % 97 = 0"""

#: events with infinite and undefined prices
INVALID_SQL = """WITH p AS (SELECT *, event_id % 31 = 0 AS a, event_id % 37 = 0 AS b FROM events)
SELECT count(*) AS rows, count(*) FILTER (WHERE a) + count(*) FILTER (WHERE b) AS invalid_numbers, count(*) FILTER (WHERE NOT b AND value IS NULL) + count(*) FILTER (WHERE NOT a AND value IS NULL) AS missing_values,
  count(DISTINCT (strftime(ts, '%Y-%m-%dT%H'), event_type)) AS keys FROM p"""

ISSUES_SQL = f"""WITH counts AS ({QUALITY_SQL}), said AS (
  SELECT duplicate_keys AS n, 'duplicate keys of timestamp and asset' AS text FROM counts UNION ALL SELECT missing_values, 'missing values' FROM counts
  UNION ALL SELECT zero_prices, 'rows with a price of zero' FROM counts UNION ALL SELECT out_of_order_rows, 'rows out of order of time' FROM counts)
SELECT n || ' ' || text AS issue FROM said WHERE n > 0"""


def _clean_counts_sql() -> str:
    """Rows and holes before and after each of CLEANINGS; a rule is named if it changed something, and the order always."""
    parts = []
    for name, o in CLEANINGS.items():
        single = "rows" if o.duplicate == "keep-all" else f"(SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY timestamp, asset ORDER BY _row_id{' DESC' if o.duplicate == 'keep-last' else ''}) = 1)"
        after = {"drop-row": f"(SELECT * FROM {single} WHERE open IS NOT NULL AND close IS NOT NULL)", "fill-value": f"(SELECT coalesce(open, 0) AS open, coalesce(close, 0) AS close FROM {single})"}.get(o.missing) or f"(SELECT {_ffill('timestamp, _row_id' if o.sort_by_asset_date else '_row_id')} FROM {single})"
        holes = "count(*) FILTER (WHERE open IS NULL) + count(*) FILTER (WHERE close IS NULL)"
        changed = "0" if o.missing == "drop-row" else "s.h - a.h"
        parts.append(f"""SELECT '{name}' AS options, r.n - a.n AS removed_rows, CAST({changed} AS BIGINT) AS changed_cells,
  CAST((r.n > s.n) AS BIGINT) + {int(o.sort_by_asset_date)} + CAST((s.n > a.n) AS BIGINT) + CAST(({changed} > 0) AS BIGINT) AS rules, a.n AS rows, a.h AS missing_values
FROM (SELECT count(*) AS n FROM rows) r, (SELECT count(*) AS n, {holes} AS h FROM {single} AS x) s, (SELECT count(*) AS n, {holes} AS h FROM {after} AS x) a""")
    return f"WITH {EVENT_ROWS} " + " UNION ALL ".join(parts)


#: the last finite ratio of a frame is ranked
LEGACY_SQL = f"""{BASE}, f AS (SELECT asset, timestamp, r, list_filter(list(r) OVER (PARTITION BY asset ORDER BY timestamp ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), lambda e: e IS NOT NULL) AS l FROM base),
k AS (SELECT *, CASE WHEN len(l) >= 3 THEN (len(list_filter(l, lambda e: e < l[-1])) + (len(list_filter(l, lambda e: e = l[-1])) + 1) / 2.0) / len(l) END AS ts_rank FROM f)
SELECT asset, timestamp, round(r, 6) + 0.0 AS ratio, round(ts_rank, 6) + 0.0 AS ts_rank,
  round(CASE WHEN count(ts_rank) OVER t >= 2 AND max(ts_rank) OVER t > min(ts_rank) OVER t THEN (ts_rank - avg(ts_rank) OVER t) / stddev_pop(ts_rank) OVER t END, 6) + 0.0 AS factor FROM k WINDOW t AS (PARTITION BY timestamp)"""

FLAGSHIP = ("cs_zscore", {"series": ("ts_rank", {"series": R}, {"window": 5, "min_samples": 3, "descending": True})})
FLAGSHIP_SQL = f"""{BASE}, f AS (SELECT asset, timestamp, r, list_filter(list(r) OVER (PARTITION BY asset ORDER BY timestamp ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), lambda e: e IS NOT NULL) AS l FROM base),
k AS (SELECT *, CASE WHEN len(l) >= 3 AND r IS NOT NULL THEN (len(list_filter(l, lambda e: e < r)) + (len(list_filter(l, lambda e: e = r)) + 1) / 2.0) / len(l) END AS s FROM f)
SELECT asset, timestamp, round(CASE WHEN max(s) OVER t > min(s) OVER t THEN (s - avg(s) OVER t) / stddev_pop(s) OVER t END, 6) + 0.0 AS factor FROM k WINDOW t AS (PARTITION BY timestamp)"""


def _flagship(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(run_graph(lineitem_panel(spark, d), *graph(FLAGSHIP)).points, "factor")


def _legacy(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(legacy.legacy_factor(lineitem_panel(spark, d), Settings(5, 3, True)), "ratio", "ts_rank", "factor")


def _summary(spark: SparkSession, d: str) -> DataFrame:
    got = run_expression(lineitem_panel(spark, d), "Mean($close, 5)/$close").summary()
    return spark.createDataFrame([(got["status"], got["valid_values"] + got["missing_values"], got["valid_values"], got["missing_values"])], "status string, rows long, valid_values long, missing_values long")


def _issues(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(text,) for text in quality.quality(event_rows(spark, d)).issues], "issue string")


CLEANINGS = {
    "first, drop": cleaning.Cleaning(missing="drop-row"),
    "last, fill": cleaning.Cleaning(duplicate="keep-last", missing="fill-value", fill_value=2),
    "first, forward": cleaning.Cleaning(missing="forward-fill"),
    "all, forward unsorted": cleaning.Cleaning(duplicate="keep-all", missing="forward-fill", sort_by_asset_date=False),
}


def _clean_counts(spark: SparkSession, d: str) -> DataFrame:
    made = {name: cleaning.clean(event_rows(spark, d), options) for name, options in CLEANINGS.items()}
    return spark.createDataFrame([(name, c.removed_rows, c.changed_cells, len(c.applied_rules), c.report.rows, c.report.missing_values) for name, c in made.items()], "options string, removed_rows long, changed_cells long, rules long, rows long, missing_values long")


CLEAN_COUNTS_SQL = _clean_counts_sql()


def _invalid(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    panel = e.select(F.date_format("ts", "yyyy-MM-dd'T'HH").alias("timestamp"), F.col("event_type").alias("asset"), F.when(F.col("event_id") % 37 == 0, float("-inf")).otherwise(F.col("value")).alias("open"), F.when(F.col("event_id") % 31 == 0, float("nan")).otherwise(F.col("value")).alias("close"))
    return quality.quality_frame(panel).select("rows", "invalid_numbers", "missing_values", (F.col("rows") - F.col("duplicate_keys")).alias("keys"))


#: assets are split into many buckets on the test data too
SPLIT = Split(rows=400, slot="substr(timestamp, 1, 7)")


def _wide(tree: tuple, window: int) -> tuple:
    """The case's graph with a window that is read in two halves."""
    return (*tree[:2], {**tree[2], "window": window})


def _cases() -> dict[str, tuple[Query, str]]:
    out: dict[str, tuple[Query, str]] = {"flagship_cs_zscore_ts_rank": (_flagship, FLAGSHIP_SQL)}
    for block, (tree, sql) in BLOCK_CASES.items():
        out[f"block_{block}"] = (_block(tree), sql)
    for block, (tree, sql) in BLOCK_CASES.items():
        if len(tree) > 2 and "window" in tree[2]:
            digits = RAW if block == "ts_rsquare" else 6  # values of it are binary fractions, ties of fewer digits
            wide = sql.replace("6 PRECEDING", "19 PRECEDING").replace(", 6) + 0.0", f", {digits}) + 0.0")
            out[f"wide_{block}"] = (_block(_wide(tree, 20), digits), wide)
            out[f"split_{block}"] = (_block(_wide(tree, 20), digits, split=SPLIT), wide)
        if block.startswith("cs_"):
            out[f"large_{block}"] = (_block(tree, large_sections=True), sql)
    for name, (text, sql) in FORMULA_CASES.items():
        out[name] = (_block(("custom_formula", X, text)), _sql(sql))
    candles = ", ".join(f"round({sql}, 6) + 0.0 AS {name}" for name, sql in CANDLE_SQL.items())
    out["alpha158_candles_and_prices"] = (_candles, f"WITH {EVENTS_SQL} SELECT asset, timestamp, {candles} FROM panel")
    for n in catalog.WINDOWS:
        out[f"alpha158_rolling_{n}"] = (_rolling(n), _rolling_sql(n))
    out["split_alpha158_rolling_30"] = (_rolling(30, split=SPLIT), _rolling_sql(30))
    for name in catalog.LAGGED:
        out[f"alpha360_{name.lower()}"] = (_named({f"{name}{k}": catalog.find(f"alpha360-{name.lower()}{k}").expression for k in catalog.LAGS}), _lagged_sql(name))
    out["panel_lineitem"] = (lambda s, d: _rounded(lineitem_panel(s, d), "open", "high", "low", "close", "volume", digits=RAW), f"WITH {LINEITEM_SQL} SELECT asset, timestamp, " + ", ".join(f"round({c}, {RAW}) + 0.0 AS {c}" for c in ("open", "high", "low", "close", "volume")) + " FROM panel")
    out["clean_keep_first"] = (_cleaned(), _clean_sql())
    out["clean_keep_last"] = (_cleaned(duplicate="keep-last"), _clean_sql(" DESC"))
    out["clean_keep_all"] = (_cleaned(duplicate="keep-all"), _clean_sql(dedup=False))
    out["clean_drop_row"] = (_cleaned(missing="drop-row"), _clean_sql(where="WHERE open IS NOT NULL AND close IS NOT NULL"))
    out["clean_fill_value"] = (_cleaned(missing="fill-value", fill_value=-1.5), _clean_sql(select="coalesce(open, -1.5) AS open, coalesce(close, -1.5) AS close"))
    out["clean_forward_fill"] = (_cleaned(missing="forward-fill"), _clean_sql(select=_ffill("timestamp, _row_id")))
    out["clean_forward_fill_split"] = (_cleaned(missing="forward-fill", split=Split(slot="substr(timestamp, 1, 10)")), _clean_sql(select=_ffill("timestamp, _row_id")))
    out["clean_forward_fill_unsorted_split"] = (_cleaned(missing="forward-fill", sort_by_asset_date=False, duplicate="keep-all", split=Split(slot="_row_id div 500")), _clean_sql(select=_ffill("_row_id"), dedup=False))
    out["clean_forward_fill_unsorted"] = (_cleaned(missing="forward-fill", sort_by_asset_date=False, duplicate="keep-all"), _clean_sql(select=_ffill("_row_id"), dedup=False))
    out["quality_report"] = (lambda s, d: quality.quality_frame(event_rows(s, d)), QUALITY_SQL)
    out["parse_delimited"] = (_parse_rows, PARSE_SQL)
    out["parse_errors"] = (lambda s, d: _parse(s, d).errors, PARSE_ERRORS_SQL)
    out["quality_invalid"] = (_invalid, INVALID_SQL)
    out["quality_issues"] = (_issues, ISSUES_SQL)
    out["clean_counts"] = (_clean_counts, CLEAN_COUNTS_SQL)
    out["legacy_factor"] = (_legacy, LEGACY_SQL)
    out["run_summary"] = (_summary, f"WITH {LINEITEM_SQL}, f AS (SELECT avg(close) OVER (PARTITION BY asset ORDER BY timestamp ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / close AS factor FROM panel) SELECT 'passed' AS status, count(*) AS rows, count(factor) AS valid_values, count(*) - count(factor) AS missing_values FROM f")
    return out


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _cases().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _cases().items()}

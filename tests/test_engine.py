"""Operators, graphs, formulas and texts on small hand-made panels."""

import math

import pytest

from panelfactor.plans import blocks
from panelfactor.plans.builder import Builder
from panelfactor.plans.dsl import FactorSyntaxError, parse_factor
from panelfactor.plans.export import export_pyspark, export_sql
from panelfactor.plans.expression import describe, expression, number_text
from panelfactor.plans.formula import FormulaError, check_block, compile_formula
from panelfactor.plans.graph import GraphEdge, GraphNode, Settings, compile_graph, lint
from panelfactor.plans.run import compute_factors, run_expression, run_graph
from panelfactor.queries import BLOCK_CASES, FLAGSHIP, graph

SCHEMA = "timestamp string, asset string, open double, close double, _row_id long"


def panel(spark, closes, opens=None, asset="A"):
    opens = opens or [10.0] * len(closes)
    return spark.createDataFrame([(f"2026-01-{k + 1:02d}", asset, o, c, k) for k, (o, c) in enumerate(zip(opens, closes, strict=True))], SCHEMA)


def values(run):
    return [r.factor for r in run.points.orderBy("_row_id").collect()]


def evaluate(spark, tree, closes, **options):
    return values(run_graph(panel(spark, closes), *graph(tree), **options))


C = ("field_close",)


@pytest.mark.parametrize(
    ("tree", "want"),
    [
        (("add", {"left": C, "right": ("constant", {}, {"value": 2})}), [4, -1, None]),
        (("divide", {"left": C, "right": ("constant", {}, {"value": 0})}), [None, None, None]),
        (("power", {"left": C}, {"exponent": 0.5}), [2**0.5, None, None]),
        (("exp", {"series": ("multiply", {"left": C, "right": ("constant", {}, {"value": 1000})})}), [None, 0, None]),
        (("log", {"series": C}), [math.log(2), None, None]),
        (("sqrt", {"series": C}), [2**0.5, None, None]),
        (("sign", {"series": C}), [1, -1, None]),
        (("maximum", {"left": C, "right": ("constant", {}, {"value": 0})}), [2, 0, None]),
        (("clip", {"series": C}, {"low": 5, "high": 1}), [1, 1, None]),
        (("clip", {"series": C}), [1, -1, None]),
        (("greater", {"left": C}), [1, 0, None]),
        (("and", {"left": ("greater", {"left": C}), "right": ("greater", {"left": ("field_high",)})}), [None, None, None]),
        (("or", {"left": ("greater", {"left": C}), "right": ("greater", {"left": ("field_high",)})}), [None, None, None]),
        (("not", {"condition": ("greater", {"left": C})}), [0, 1, None]),
        (("where", {"condition": ("greater", {"left": C}), "when_true": C, "when_false": ("constant", {}, {"value": 9})}), [2, 9, None]),
        (("fill_missing", {"series": C}, {"value": 7}), [2, -3, 7]),
        (("market_data",), [None, None, None]),
    ],
)
def test_elementwise_and_logic(spark, tree, want):
    assert evaluate(spark, tree, [2.0, -3.0, None]) == pytest.approx(want)


def test_windows_by_hand(spark):
    w = {"window": 3, "min_samples": 1}

    def ts(block, closes, **p):
        return evaluate(spark, (block, {"series": C}, {**w, **p}), closes)

    five = [1.0, 2.0, 4.0, 4.0, 0.0]
    assert ts("ts_mean", five) == pytest.approx([1, 1.5, 7 / 3, 10 / 3, 8 / 3])
    assert ts("ts_std", [1.0, 2.0, 3.0]) == pytest.approx([None, 0.5**0.5, 1])
    assert ts("ts_rank", five) == pytest.approx([1, 1, 1, 2.5 / 3, 1 / 3])
    assert ts("ts_rank", five, descending=False) == pytest.approx([1, 0.5, 1 / 3, 1.5 / 3, 1])
    assert ts("ts_quantile", five, quantile=0.5) == pytest.approx([1, 1.5, 2, 4, 4])
    assert ts("ts_slope", [1.0, None, 5.0]) == pytest.approx([None, None, 2])
    assert ts("ts_residual", [1.0, 2.0, 6.0]) == pytest.approx([None, 0, 6 - (3 + 2.5)])
    assert ts("ts_argmax", [3.0, 3.0, 1.0, None, 2.0]) == pytest.approx([1, 1, 1, 3, 2])
    assert ts("ts_argmin", [3.0, 1.0, 1.0, 1.0, None]) == pytest.approx([1, 2, 2, 1, 3])
    assert ts("ts_argmax", [None, None]) == [None, None]
    assert ts("ts_mean", [1.0, None, 3.0], min_samples=2) == pytest.approx([None, None, 2])
    assert evaluate(spark, ("ts_ref", {"series": C}, {"lag": 2}), five) == pytest.approx([None, None, 1, 2, 4])
    assert evaluate(spark, ("ts_pct_change", {"series": C}, {"lag": 1}), [0.0, 2.0, 3.0]) == pytest.approx([None, None, 0.5])
    assert evaluate(spark, ("ts_cov", {"left": C, "right": C}, {"window": 2, "min_samples": 1}), [5.0, 7.0]) == pytest.approx([0, 1])
    assert evaluate(spark, ("ts_corr", {"left": C, "right": C}, {"window": 3, "min_samples": 2}), [1.0, 1.0, 1.0, 2.0]) == pytest.approx([None, None, None, 1])


def test_skewness_estimators(spark):
    tree = ("ts_skew", {"series": C}, {"window": 5, "min_samples": 3})
    adjusted = evaluate(spark, tree, [1.0, 2.0, 7.0, 8.0], skew_estimator="adjusted")[-1]
    assert evaluate(spark, tree, [1.0, 2.0, 7.0, 8.0])[-1] == pytest.approx(adjusted / 4)


def test_assets_do_not_mix_and_order_of_rows_does_not_matter(spark):
    rows = [("2026-01-03", "A", 1.0, 3.0, 0), ("2026-01-01", "A", 1.0, 1.0, 1), ("2026-01-02", "B", 1.0, 9.0, 2), ("2026-01-02", "A", 1.0, 2.0, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    run = run_expression(df, "Ref($close,1)")
    assert values(run) == [2.0, None, None, 1.0]


def test_tie_sections(spark):
    rows = [("d", a, 1.0, c, k) for k, (a, c) in enumerate(zip("ABC", (5.0, 5.0, 1.0), strict=True))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert values(run_graph(df, *graph(("cs_zscore", {"series": C})))) == pytest.approx([0.5**0.5, 0.5**0.5, -(2**0.5)])
    assert values(run_graph(df, *graph(("cs_rank", {"series": C})))) == pytest.approx([2.5 / 3, 2.5 / 3, 1 / 3])
    assert values(run_graph(df, *graph(("cs_zscore", {"series": ("field_open",)})))) == [None] * 3


def test_graph_faults():
    out = GraphNode("out", "factor_output", "output")
    close = GraphNode("c", "field_close", "input")
    assert not compile_graph([close], []).supported
    assert "missing" in compile_graph([out], []).warnings[0]
    unknown = compile_graph([GraphNode("z", "nonsense"), out], [GraphEdge("z", "out", "value")])
    assert not unknown.supported and "unknown block" in unknown.warnings[0]
    a, b = GraphNode("a", "abs"), GraphNode("b", "abs")
    ring = compile_graph([a, b, out], [GraphEdge("a", "b", "series"), GraphEdge("b", "a", "series"), GraphEdge("a", "out", "value")])
    assert not ring.supported and any("cycle" in w for w in ring.warnings)
    two = compile_graph([close, GraphNode("o", "open_field"), out], [GraphEdge("c", "out"), GraphEdge("o", "out", "value")])
    assert two.supported and "several edges" in two.warnings[0]
    assert not compile_graph([close, out], [GraphEdge("c", "out", "nowhere")]).supported
    empty = compile_graph([close, GraphNode("f", "custom_formula"), out], [GraphEdge("c", "f"), GraphEdge("f", "out")])
    assert not empty.supported
    assert lint([close, GraphNode("n", "not"), out], [GraphEdge("c", "n", "condition")])


def test_blocked_summary(spark):
    run = run_graph(panel(spark, [1.0, 2.0]), [GraphNode("out", "factor_output", "output")], [])
    assert run.summary() == {"status": "blocked", "expression": "factor_value", "valid_values": 0, "missing_values": 2, "warnings": run.warnings}
    fine = run_expression(panel(spark, [1.0, None]), "$close").summary()
    assert (fine["status"], fine["valid_values"], fine["missing_values"]) == ("passed", 1, 1)


@pytest.mark.parametrize(
    ("text", "want"),
    [("-x**2", 4), ("2**3**2", 512), ("7 % -4 + x", 5), ("np.log(math.e) + x", 3), ("x / 0", None), ("max(x, 3, 1)", 3), ("where(x > 1 && true, 10, 20)", 10), ("ifelse(!x, 1, 2)", 2), ("isnan(log(-1)) + 0", 1), ("clip(x, 3, 1)", 1), ("x != 2 || x == 2", 1), ("1e-3 * .5", 0.0005), ("sqrt(-x)", None), ("2 ** -x", 0.25), ("-(x + 1) * 2 ^ 2", -12), ("max()", None), ("isnan()", 1), ("pow(x)", None), ("abs(-x, 9)", 2), ("!(x > 3) + 1", 2), ("1 - 2 - 3", -4), ("2 < 3 == true", 1), ("((x))", 2)],
)
def test_formula(spark, text, want):
    assert evaluate(spark, ("custom_formula", {"series": C}, text), [2.0]) == pytest.approx([want])


@pytest.mark.parametrize("text", ["y + 1", "foo(x)", "x +", "(x", "x ? 1", "x x", "", "x)", "()", "x, x", "max(x,)", "max(,x)", "x (x)", "pi(x)", "* x"])
def test_formula_errors(text):
    b = Builder()
    with pytest.raises(FormulaError):
        compile_formula(b, text, b.field("close"))
    assert not compile_graph(*graph(("custom_formula", {"series": C}, text))).supported


def test_custom_block_check():
    assert check_block("double", "x * 2") == []
    assert len(check_block(" ", "y ^ 2")) == 3
    assert check_block("a", "np.log(X) + 1e3") == [] and len(check_block("a", "x ; 1")) == 1 and len(check_block("a", "1 + 2")) == 1


@pytest.mark.parametrize("text", ["$price", "Foo($close)", "$close >= 1", "Ref($close, 0)", "Mean($close", "$close $open", "Mean()"])
def test_factor_language_errors(text):
    with pytest.raises(FactorSyntaxError):
        parse_factor(text)


def test_texts():
    assert expression(*graph(FLAGSHIP))[0] == "Cs_ZScore(Ts_Rank((Close / Open), 5, desc, min_samples=3))"
    assert expression(*parse_factor("Corr($close,Log($volume+1),5)"))[0] == "Ts_Corr(Close, Log((Volume + 1)), 5, std_tolerance=0.00002)"
    assert expression(*graph(("custom_formula", {"series": C}, "x * max(x, 1)")))[0] == "Close * max(Close, 1)"
    assert expression(*graph(("clip", {"series": C, "low": ("constant", {}, {"value": 0.25})})))[0] == "Clip(Close, 0.25, 1)"
    assert [number_text(v) for v in (1e-12, 2e-5, 3.0, 0.123456789, True, -2.5e-9)] == ["1e-12", "0.00002", "3", "0.12345679", "true", "-2.5e-9"]
    assert "field_close" in describe(*graph(FLAGSHIP))


def test_exports_run_alone(spark):
    nodes, edges = graph(FLAGSHIP)
    df = panel(spark, [9.0, 11.0, 12.0, None, 8.0, 10.0]).unionByName(panel(spark, [9.0, 8.0, 13.0, 4.0, 8.0, 1.0], asset="B"))
    want = sorted((r.asset, r.timestamp, r.factor) for r in run_graph(df, nodes, edges).points.collect())
    scope = {}
    exec(export_pyspark(nodes, edges, fields=("open", "close")), scope)
    assert sorted((r.asset, r.timestamp, r.factor) for r in scope["compute_factor"](df).collect()) == want
    df.createOrReplaceTempView("panel_for_export")
    rows = spark.sql(export_sql(nodes, edges, table="panel_for_export", fields=("open", "close"))).collect()
    assert sorted((r.asset, r.timestamp, r.factor) for r in rows) == want


def test_catalogue_of_blocks():
    assert len(blocks.registered()) == 60 and len(blocks.BLOCKS) == 62
    assert {b.category for b in blocks.registered()} == set(blocks.CATEGORIES)
    assert blocks.get("condition").id == "where" and blocks.canonical("vwap_field") == "field_vwap"
    assert blocks.connectable("scalar", "series") and not blocks.connectable("series", "scalar")
    assert set(BLOCK_CASES) == set(blocks.BLOCKS)
    p = blocks.Params({"window": 1.2, "min_samples": 99, "lag": 0, "descending": "x"}, 5, 5, False)
    assert (p.window, p.least, p.lag, p.descending) == (2, 2, 1, False)
    assert blocks.Params({"window": float("nan")}, 7.5, 3).window == 8


def test_plan_has_one_exchange_for_all_windows_of_an_asset(spark, capsys):
    df = panel(spark, [1.0, 2.0])
    out = compute_factors(df, ["MA5", "STD10", "CORR20", "IMAX5", "RANK30", "SUMP60"], keep=["asset", "timestamp"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(asset") == 1
    assert "Python" not in plan and "Join" not in plan


def test_settings_are_defaults_of_windows(spark):
    df = panel(spark, [1.0, 2.0, 3.0])
    nodes, edges = graph(("ts_mean", {"series": C}))
    assert values(run_graph(df, nodes, edges, Settings(2, 2))) == pytest.approx([None, 1.5, 2.5])

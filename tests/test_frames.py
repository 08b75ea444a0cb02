"""Wide frames, split assets, large sections and fills, against the plain way and by hand."""

import itertools
import math
import random
import re
import statistics

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelfactor.operators import cleaning, frames, sections
from panelfactor.plans import builder, catalog, partitions
from panelfactor.plans.builder import OWN, POSITION, Split, lend, numbered
from panelfactor.plans.run import compute_factors, run_graph
from panelfactor.queries import BLOCK_CASES, graph, rounded

SCHEMA = "timestamp string, asset string, open double, close double, volume double, _row_id long"
ROLLED = [k for k, (tree, _) in BLOCK_CASES.items() if len(tree) > 2 and "window" in tree[2]]
CLOSE, VOLUME = ("field_close",), ("field_volume",)


@pytest.fixture(scope="module")
def panel(spark):
    """Walks with holes, constant stretches, jumps of size, an asset of holes only, and repeated timestamps."""
    rng, rows = random.Random(5), []
    for asset, scale in (("A", 1.0), ("B", 1e6), ("C", 1e-6), ("flat", 1.0), ("none", None), ("short", 1.0)):
        x = 100.0 * (scale or 1)
        for k in range(7 if asset == "short" else 230):
            if scale is not None and not (asset == "flat" and 40 <= k < 150):
                x += (scale or 1) * rng.gauss(0.1, 1)
            hole = scale is None or (rng.random() < 0.15 and asset != "flat") or (asset == "A" and 60 <= k < 95)
            rows.append((f"2026-{1 + k // 60:02d}-{1 + k % 60 // 2:02d}", asset, 10.0, None if hole else x, None if rng.random() < 0.1 else rng.choice([5.0, 5.0, rng.random() * 1000]), k))
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def tree_of(block, window, least=3):
    parameters = {**BLOCK_CASES[block][0][2], "window": window, "min_samples": least}
    pair = block in ("ts_corr", "ts_cov")
    return (block, {"left": CLOSE, "right": VOLUME} if pair else {"series": CLOSE}, parameters)


def result(df, tree, **options):
    run = run_graph(df, *graph(tree), **options)
    return {(r.asset, r["_row_id"]): r.factor for r in run.points.select("asset", "_row_id", "factor").collect()}


def close(a, b, size=1.0):
    if a is None or b is None:
        return a is b
    return math.isclose(a, b, rel_tol=2e-8, abs_tol=1e-9 * size)


@pytest.mark.parametrize("block", ROLLED)
@pytest.mark.parametrize("window", [9, 50])
def test_halves_and_rows_agree(panel, block, window, monkeypatch):
    tree = tree_of(block, window)
    wide = result(panel, tree)
    split = result(panel, tree, split=Split(rows=37, slot="substr(timestamp, 1, 7)"))
    monkeypatch.setattr("panelfactor.operators.timeseries.NARROW", 10**6)
    plain = result(panel, tree)
    assert len(plain) == len(wide) == len(split) == panel.count()
    for key, want in plain.items():
        size = {"B": 1e6, "C": 1e-6}.get(key[0], 1.0)
        assert close(wide[key], want, size), (key, wide[key], want)
        assert close(split[key], want, size), (key, split[key], want)


@pytest.mark.parametrize("block", ROLLED)
def test_halves_of_long_frames_agree(panel, block, monkeypatch):
    tree = tree_of(block, 80)
    wide = result(panel, tree)
    split = result(panel, tree, split=Split(rows=37, slot="substr(timestamp, 1, 7)"))
    monkeypatch.setattr("panelfactor.operators.timeseries.NARROW", 10**6)
    plain = result(panel, tree)
    for key, want in plain.items():
        size = {"B": 1e6, "C": 1e-6}.get(key[0], 1.0)
        assert close(wide[key], want, size) and close(split[key], want, size), (key, wide[key], split[key], want)


@pytest.mark.parametrize("split", [None, Split(rows=400)])
def test_frames_of_the_catalogue_share_one_sort(panel, split):
    """F3 to F22: rows are sorted by asset once and before results widen them, for every window of the catalogue."""
    for n in catalog.WINDOWS:
        made = compute_factors(panel, [f"{name}{n}" for name in catalog.ROLLING], split=split)
        plan = made._jdf.queryExecution().executedPlan().toString()
        by_asset = re.findall(r"Sort \[asset#\d+ ASC NULLS FIRST, (?!_slot).*", plan)
        assert len(by_asset) <= (1 if split is None else 2) and "DESC" not in plan, (n, by_asset)


@pytest.mark.parametrize("split", [None, Split(rows=37, slot="substr(timestamp, 1, 7)")])
def test_frames_read_by_columns_agree(panel, split, monkeypatch):
    """F2 to F12: the catalogue's frames are no window functions, and give what window functions give."""
    bars = panel.selectExpr("*", "close + 1 AS high", "close - volume AS low")
    names = [f"{name}{n}" for n in (5, 60) for name in catalog.ROLLING]
    made = compute_factors(bars, names, keep=["asset", "_row_id"], split=split)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "RowFrame, -59" not in plan and "RowFrame, -4" not in plan
    got = {(r.asset, r["_row_id"]): r for r in made.collect()}
    monkeypatch.setattr(builder, "MANY", 10**6)
    plain = compute_factors(bars, names, keep=["asset", "_row_id"], split=split)
    assert "MapInArrow" not in plain._jdf.queryExecution().executedPlan().toString()
    want = {(r.asset, r["_row_id"]): r for r in plain.collect()}
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert all(close(got[key][c], row[c]) for c in names), (key, [(c, got[key][c], row[c]) for c in names if not close(got[key][c], row[c])])


def test_frames_over_frames_and_sections(panel, monkeypatch):
    """Frames that other windows and sections are made of, and frames of those."""
    means = [f"Mean(Std(Sum($close, {n}), 3) - Ref(Max($volume, {n}), 2), 4)" for n in range(2, 9)]
    section = ("cs_rank", {"series": ("ts_mean", {"series": ("cs_mean", {"series": ("ts_std", {"series": CLOSE}, {"window": 9, "min_samples": 3})})}, {"window": 5, "min_samples": 2})})
    results = []
    for many in (10**6, 1):
        monkeypatch.setattr(builder, "MANY", many)
        made = compute_factors(panel, {f"f{k}": text for k, text in enumerate(means)}, keep=["asset", "_row_id"])
        results.append(({(r.asset, r["_row_id"]): tuple(r)[2:] for r in made.collect()}, result(panel.where("_row_id % 2 = 0"), section)))
    (plain, sections_plain), (read, sections_read) = results
    assert plain.keys() == read.keys() and all(close(a, b, {"B": 1e6, "C": 1e-6}.get(k[0], 1.0)) for k, row in plain.items() for a, b in zip(row, read[k], strict=True))
    assert sections_plain.keys() == sections_read.keys() and all(close(sections_read[k], v) for k, v in sections_plain.items())


def test_frames_over_slices_and_batches(monkeypatch):
    """Frames reach over the borders of batches and slices, and not over those of assets."""
    rng = random.Random(3)
    numbers = [k + 1 for n in (1, 40, 3, 25) for k in range(n)]
    x = [None if rng.random() < 0.2 else rng.choice([1.0, 2.0, rng.random()]) for _ in numbers]
    rows = pa.record_batch({"x": pa.array(x, pa.float64()), "p": [float(n) for n in numbers], "id": list(range(len(x))), frames.NUMBER: numbers})
    wanted = [(call, call, ("x", "p") if call.startswith(("first", "regr", "covar")) else ("x",), window) for call, window in zip(sorted(frames.CALLS), itertools.cycle((2, 7, 12)))]

    def read(size, slices):
        monkeypatch.setattr(frames, "ROWS", slices)
        parts = (rows.slice(k, size) for k in range(0, len(x), size))
        return pa.Table.from_batches(frames._work(["id"], wanted)(parts)).to_pylist()

    whole = read(len(x), 4096)
    assert [r["id"] for r in whole] == list(range(len(x)))
    assert read(5, 3) == whole and read(1, 1) == whole
    windows = {name: window for name, _, _, window in wanted}
    for k, row in enumerate(whole):
        frame = {name: x[k - min(w, numbers[k]) + 1 : k + 1] for name, w in windows.items()}
        assert row["count"] == sum(v is not None for v in frame["count"])
        assert row["collect_list"] == sorted(v for v in frame["collect_list"] if v is not None)
        assert row["max"] == max((v for v in frame["max"] if v is not None), default=None)


@pytest.mark.parametrize("many", [1, 10**6])
def test_residuals_far_from_the_first_row(spark, many, monkeypatch):
    """-25324.749506775068 / 590.2277777777778 is -42.9067395 and a little less; the line's intercept is 264 rows away."""
    monkeypatch.setattr(builder, "MANY", many)
    last = [521.5502439024391, 2239.068536585366, 32518.36333333333, 47903.695, 590.2277777777778]
    df = spark.createDataFrame([(f"{k:04d}", "A", v) for k, v in enumerate([1000.0] * 259 + last)], "timestamp string, asset string, close double")
    made = compute_factors(df, ["RESI5"]).orderBy(F.desc("timestamp")).select(F.round("RESI5", 6)).first()
    assert made[0] == -42.90674


def test_rounding_is_sparks(spark):
    """By doubles where they decide, else by decimals: ties, neighbours of ties, large numbers and what is no number."""
    rng = random.Random(4)
    ties = [(k + 0.5) / 10**6 for k in (-3, -1, 0, 1, 2, 1234567, 10**9 + 7, 10**12)]
    near = [math.nextafter(v, to) for v in ties for to in (-math.inf, math.inf)]
    odd = [None, 0.0, -0.0, -1e-9, 1e-7, 4.9999e-7, 1e15 + 0.3, 1e300, -1e300, math.nan, math.inf, -math.inf]
    values = ties + near + odd + [rng.gauss(0, 10 ** rng.randint(-8, 12)) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (6, 9):
        both = df.select(rounded("x", digits).alias("a"), (F.round("x", digits) + F.lit(0.0)).alias("b"))
        assert both.where("NOT a <=> b").isEmpty()


@pytest.mark.parametrize("split", [None, Split(rows=37, slot="substr(timestamp, 1, 7)")])
def test_tasks_grow_with_the_input(spark, panel, split, tmp_path, monkeypatch):
    """F4 to F21: a panel of more files is dealt to more tasks than the session has, for windows, numbers and sections."""
    panel.write.parquet(str(tmp_path / "panel"))
    stored = spark.read.parquet(str(tmp_path / "panel"))
    tree = ("ts_mean", {"series": ("cs_mean", {"series": ("ts_corr", {"left": CLOSE, "right": VOLUME}, {"window": 9, "min_samples": 3})})}, {"window": 12, "min_samples": 2})
    want = result(stored, tree, split=split)
    monkeypatch.setattr(partitions, "SHARE", 1024)
    n = partitions.partitions(stored)
    assert n >= 9  # the session has 4
    assert run_graph(stored, *graph(tree), split=split).points.rdd.getNumPartitions() == n
    got = result(stored, tree, split=split)
    assert got.keys() == want.keys() and all(close(got[k], v, {"B": 1e6, "C": 1e-6}.get(k[0], 1.0)) for k, v in want.items())
    if split:
        placed, plain = (numbered(df, split, ("timestamp", "_row_id")) for df in (stored, panel))
        assert placed.rdd.getNumPartitions() == n and placed.exceptAll(plain).isEmpty() and plain.exceptAll(placed).isEmpty()


@pytest.mark.parametrize("split", [None, Split(rows=37, slot="substr(timestamp, 1, 7)")])
def test_tasks_are_not_merged(spark, panel, split, tmp_path, monkeypatch):
    """F5 to F20: a session of many partitions, which Spark merges to few large ones, leaves the number of tasks as it is."""
    panel.write.parquet(str(tmp_path / "panel"))
    stored = spark.read.parquet(str(tmp_path / "panel"))
    monkeypatch.setattr(partitions, "SHARE", 1024)
    n, before = partitions.partitions(stored), spark.conf.get("spark.sql.shuffle.partitions")
    tree = ("ts_corr", {"left": CLOSE, "right": VOLUME}, {"window": 20, "min_samples": 3})
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert spark.sparkContext.defaultParallelism < n < 64
        assert run_graph(stored, *graph(tree), split=split).points.rdd.getNumPartitions() == n
        if split:
            assert numbered(stored, split, ("timestamp", "_row_id")).rdd.getNumPartitions() == n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_slots_are_numbered_by_value(spark):
    """Slots of numbers go by number, not by text; a null slot comes first and a null asset is an asset."""
    rows = [(f"{k:04d}", a, k) for k in range(240) for a in ("A", "", None)]
    df = spark.createDataFrame(rows, "timestamp string, asset string, k int").repartition(5)
    placed = numbered(df, Split(slot="if(k < 7, null, k div 20)"))
    assert placed.count() == len(rows) and placed.where(F.col(POSITION) != F.col("k") + 1).isEmpty()


def test_constant_frames_do_not_vary(panel):
    std, corr = result(panel, tree_of("ts_std", 20)), result(panel, tree_of("ts_corr", 20))
    for k in range(62, 148):
        assert std["flat", k] == 0.0 and corr["flat", k] is None


def test_sections_between_windows_of_split_assets(panel):
    """A section sees own rows alone, also between two windows by asset."""
    tree = ("ts_mean", {"series": ("cs_rank", {"series": ("ts_mean", {"series": CLOSE}, {"window": 9, "min_samples": 1})})}, {"window": 12, "min_samples": 2})
    one = panel.where("_row_id % 2 = 0")
    assert result(one, tree) == pytest.approx(result(one, tree, split=Split(rows=20), large_sections=True), abs=1e-9)


def test_one_asset_is_shared_by_all_tasks(spark):
    """200,000 rows of one asset: buckets differ little in rows, and each has what its frames reach back to."""
    n, rows, reach = 200_000, 5000, 59
    hot = spark.range(n).select(F.expr("date_format(timestamp_seconds(id * 600), 'yyyy-MM-dd HH:mm')").alias("timestamp"), F.lit("A").alias("asset"), F.rand(1).alias("close"), F.col("id").alias("_row_id"))
    split = Split(rows=rows, slot="substr(timestamp, 1, 7)")
    placed = numbered(hot, split, ("timestamp", "_row_id"))
    assert placed.where(F.col(POSITION) != F.col("_row_id") + 1).isEmpty()
    lent = lend(placed, split, reach)
    sizes = [r["count"] for r in lent.groupBy("_bucket").count().collect() if r["count"] > reach]
    assert len(sizes) == n // rows and max(sizes) <= 2 * statistics.median(sizes)
    assert lent.where(OWN).count() == n
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = run_graph(hot, *graph(("ts_mean", {"series": CLOSE}, {"window": 60, "min_samples": 60})), split=split)
        tasks = [r["count"] for r in out.points.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
        assert len(tasks) >= 3 and max(tasks) <= 2 * statistics.median(tasks)
        assert out.points.where("factor IS NULL").count() == 59
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("block", [k for k in BLOCK_CASES if k.startswith("cs_")])
def test_large_sections_agree(panel, block):
    inputs = {"series": CLOSE, "exposure": VOLUME} if block == "cs_neutralize" else {"series": CLOSE}
    plain, large = (result(panel, (block, inputs), large_sections=flag) for flag in (False, True))
    assert all(close(large[k], v, 1e6) for k, v in plain.items())


def test_ranks_over_ranges(spark):
    """One timestamp with many values, a third of them equal, and one of nulls only."""
    rng = random.Random(8)
    values = [7.0 if k % 3 == 0 else rng.choice([rng.gauss(0, 1), float(rng.randint(-50, 50))]) for k in range(5000)] + [None] * 9
    df = spark.createDataFrame([(k, "t" if k < 5005 else None, v) for k, v in enumerate(values)] + [(9999, "empty", None)], "k long, timestamp string, x double").repartition(7)
    out = {r.k: (r.below, r.ties) for r in sections.ranked(df, "x", "below", "ties", ranges=16).collect()}
    known = sorted(v for v in values if v is not None)
    import bisect

    for k, v in enumerate(values):
        want = (None, None) if v is None else (bisect.bisect_left(known, v), bisect.bisect_right(known, v) - bisect.bisect_left(known, v))
        assert out[k] == want
    groups = sections.ranked(df, "x", "below", "ties", ranges=16)
    assert groups.count() == 5010


def test_fill_over_slots(panel):
    """The same as one window by asset, in order of time and of rows."""
    fields = ["open", "close", "volume"]
    for by_time, slot in ((True, "substr(timestamp, 1, 9)"), (False, "_row_id div 13")):
        plain = cleaning.forward_fill(panel, fields, by_time)
        slotted = cleaning.forward_fill(panel, fields, by_time, Split(slot=slot))
        assert slotted.columns == panel.columns and plain.exceptAll(slotted).isEmpty() and slotted.exceptAll(plain).isEmpty()


def test_blocks_are_as_long_as_the_frame(panel):
    b = builder.Builder()
    x = b.field("close")
    here, before = b.halves(f"sum({x})", 30)
    assert b.nodes[here].kind == "forward" and "DESC" not in b.nodes[here].sql
    assert {n.kind for n in b.needed([before])} >= {"backward", "asset"} and 29 <= b._reach(b.layers([before])) <= 58  # a bound: stages are added up

"""Reading, reports, cleaning, the fixed factor, projects and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from panelfactor import queries
from panelfactor.operators.cleaning import Cleaning, apply, clean
from panelfactor.operators.legacy import legacy_expression, legacy_factor
from panelfactor.operators.quality import quality
from panelfactor.plans.graph import Settings
from panelfactor.sources import delimited, projects
from panelfactor.sources.panels import demo_panel, read_parquet, tail
from panelfactor.streaming.incremental import batch_values, lookback, stream_factor

SCHEMA = "timestamp string, asset string, open double, close double, _row_id long"


def test_csv(spark):
    p = delimited.parse_text(spark, "﻿date,code,open,close,Note\r\n2026-01-01,000001,\"1,234.5\",2,\"a,b\"\n\n2026-01-02,000001,bad,0x10,\n,000001,1,1,x\n2026-01-02,000001,bad,0x10,\n")
    rows = p.rows.orderBy("_row_id").collect()
    assert [(r.timestamp, r.asset, r.open, r.close, r.extra["Note"]) for r in rows] == [("2026-01-01", "000001", 1234.5, 2.0, "a,b"), ("2026-01-02", "000001", None, 16.0, None), ("2026-01-02", "000001", None, 16.0, None)]
    assert sorted((e.line, e.field, e.raw) for e in p.errors.collect()) == [(4, "open", "bad"), (4, "open", "bad"), (5, "key", "")]
    assert p.field_map["asset"] == "code" and p.source_rows == 4 and p.warnings() and p.present == ["open", "close"]


def literal_cells(line, delimiter):
    """The rule of quotes, a character at a time."""
    out, now, inside, k = [], "", False, 0
    while k < len(line):
        c = line[k]
        if c == '"' and inside and line[k + 1 : k + 2] == '"':
            now, k = now + c, k + 1
        elif c == '"':
            inside = not inside
        elif c == delimiter and not inside:
            out.append(now.strip(delimited.WHITE))
            now = ""
        else:
            now += c
        k += 1
    return [*out, now.strip(delimited.WHITE)]


def test_cells_of_any_line(spark):
    rng = random.Random(1)
    lines = ['a"b,c"d,1', '"",""', '"', 'a,"', '"a""b",c', 'a""b,"c', '""""', '"""a,b"""', " a , \u00a0b\t", "", "\0,\0s\"\0n,\""] + ["".join(rng.choice('ab,," "\t\0s') for _ in range(rng.randint(0, 14))) for _ in range(600)]
    for delimiter in (",", "\t"):
        got = spark.createDataFrame([(v,) for v in lines], "value string").select("value", delimited.cells(F.col("value"), delimiter).alias("c")).collect()
        for r in got:
            assert r.c == literal_cells(r.value, delimiter), r.value


def test_quotes_inside_cells(spark):
    p = delimited.parse_text(spark, 'date,"co""de",asset,open,close\n2020-01-01,x,a"b,c"d,1,2\n')
    r = p.rows.first()
    assert (r.asset, r.open, r.close, r.extra) == ("ab,cd", 1.0, 2.0, {'co"de': "x"}) and p.errors.isEmpty()


def test_numbers_of_other_bases(spark):
    cells = ["0b101", "0B2", "0o17", "0O8", "0XfF", "-0x1", " 1 ,", ",", "1_0", "Infinity", "1e999", ".5", "5.", "+5"]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select(delimited.number(F.col("c"))).collect()
    assert [r[0] for r in got] == [5.0, None, 15.0, None, 255.0, None, 1.0, 0.0, None, None, None, 0.5, 5.0, 5.0]


def test_folder_in_order_of_files(spark, tmp_path):
    """Three files whose sizes are not in order of their names; the second begins with the header again."""
    head = "date,code,open,close"
    (tmp_path / "a.csv").write_text(f"\ufeff{head}\n2020-01-01,A0,1,1\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text(f"\ufeff{head}\r\n" + "".join(f"2020-02-01,B{k},{k},bad\r\n" for k in range(50)), encoding="utf-8")
    (tmp_path / "c.csv").write_text("".join(f"2020-03-01,C{k},{k},1\n\n" for k in range(200)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # several splits a file
    try:
        p = delimited.read(spark, str(tmp_path))
        rows = p.rows.orderBy("_row_id").collect()
        assert not p.problems and [r.asset for r in rows] == ["A0", *(f"B{k}" for k in range(50)), *(f"C{k}" for k in range(200))]
        assert [r["_row_id"] for r in rows] == [2, *range(4, 54), *range(54, 454, 2)]
        assert sorted((e.line, e.raw) for e in p.errors.collect()) == [(k, "bad") for k in range(4, 54)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_tsv_with_other_headers(spark):
    p = delimited.parse_text(spark, "日期\t代码\t开盘价\t收盘价\t成交量\n2026-01-01\tA\t1e3\t2\t12d\n")
    assert p.delimiter == "\t"
    r = p.rows.first()
    assert (r.open, r.close, r.volume) == (1000.0, 2.0, None) and p.errors.count() == 1


@pytest.mark.parametrize(("text", "problem"), [("date,code,open\n1,2,3", "close"), ("", "no header")])
def test_unreadable(spark, text, problem):
    p = delimited.parse_text(spark, text)
    assert p.rows.count() == 0 and any(problem in x for x in p.problems)


def rows(spark, data):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(data)], SCHEMA)


def test_quality(spark):
    df = rows(spark, [("2026-01-02", "A", 0.0, 1.0), ("2026-01-01", "A", 1.0, None), ("2026-01-01", "A", float("inf"), 0.0), ("2026-01-01", "B", 1.0, 1.0)])
    q = quality(df)
    assert (q.rows, q.assets, q.dates, q.duplicate_keys, q.missing_values, q.invalid_numbers, q.zero_prices, q.out_of_order_rows) == (4, 2, 2, 1, 1, 1, 2, 1)
    assert q.missing_by_field == {"close": 1} and len(q.issues) == 5
    assert quality(df.limit(0)).rows == 0


def test_cleaning(spark):
    df = rows(spark, [("2026-01-02", "A", 2.0, None), ("2026-01-01", "A", 1.0, 5.0), ("2026-01-01", "A", 9.0, 9.0)])
    c = clean(df, Cleaning(missing="forward-fill"))
    assert [(r.timestamp, r.open, r.close) for r in c.rows.orderBy(*c.order).collect()] == [("2026-01-01", 1.0, 5.0), ("2026-01-02", 2.0, 5.0)]
    assert (c.removed_rows, c.changed_cells, len(c.applied_rules)) == (1, 1, 3) and c.report.missing_values == 0
    assert df.count() == 3
    unsorted = apply(df, Cleaning(duplicate="keep-last", missing="forward-fill", sort_by_asset_date=False))
    assert {(r.open, r.close) for r in unsorted.collect()} == {(2.0, None), (9.0, 9.0)}
    assert apply(df, Cleaning(missing="drop-row")).count() == 1
    assert clean(df, Cleaning(duplicate="keep-all", missing="fill-value", fill_value=float("nan"))).rows.where("close = 0").count() == 1


def test_fixed_factor(spark):
    data = [(f"2026-01-0{d}", a, 1.0, c) for d in (1, 2) for a, c in zip("ABC", (1.0, 2.0, 3.0) if d == 1 else (2.0, 3.0, 1.0), strict=True)]
    out = legacy_factor(rows(spark, data), Settings(2, 2, True)).orderBy("timestamp", "asset").collect()
    assert [r.factor for r in out[:3]] == [None] * 3 and out[0].warning
    assert [r.factor for r in out[3:]] == pytest.approx([0.5**0.5, 0.5**0.5, -(2**0.5)])
    gap = legacy_factor(rows(spark, [("1", "A", 1.0, 1.0), ("2", "A", 1.0, 2.0), ("3", "A", 0.0, 2.0)]), Settings(3, 2, True)).orderBy("timestamp").collect()
    assert gap[2].ratio is None and gap[2].ts_rank == 1.0
    half = legacy_factor(rows(spark, [(str(d), "A", 1.0, float(c)) for d, c in enumerate((3, 1, 2))]), Settings(2.5, 2.5, True)).orderBy("timestamp").collect()
    assert half[1].ts_rank is None and half[2].ts_rank == pytest.approx(2 / 3)  # halves go up: windows of three
    assert legacy_expression() == "Cs_ZScore(Ts_Rank(Close / Open, 5, desc, min_samples=5))"


STATE = {
    "name": "A/b  c",
    "view": "workspace",
    "nodes": [{"id": "n", "position": {"x": 0, "y": 1}, "data": {"blockId": "field_close"}}],
    "edges": [{"id": "e", "source": "n", "target": "m"}],
    "settings": {"window": 1, "minSamples": 99, "descending": True},
    "rows": [{"timestamp": "2026-01-01", "asset": "A", "open": 1, "close": None, "extra": {"k": 3}}],
    "dataName": "d",
    "lastRun": "",
    "showMore": False,
    "selectedNode": None,
}


def test_projects(spark, tmp_path):
    doc = projects.create(STATE, "2026-01-01T00:00:00Z")
    parsed = projects.parse(json.loads(projects.dumps(doc)))
    assert parsed["settings"] == {"window": 2, "minSamples": 2, "descending": True} and parsed["rows"][0]["extra"] == {"k": "3"}
    assert projects.parse(json.loads(projects.dumps(parsed))) == parsed
    assert projects.file_name(" A/b  c ") == "A_b_c.factor.json" and projects.file_name("??").startswith("factor-project")
    path = str(tmp_path / "p.json")
    projects.save(doc, path)
    assert projects.load(path) == parsed
    (tmp_path / "p.json").write_text("{")
    assert projects.load(path) is None and projects.load(path + "x") is None
    old = projects.parse({**doc, "schemaVersion": 1, "originalRows": []})
    assert old["originalRows"] == old["rows"] and old["schemaVersion"] == 2
    frame = projects.rows_frame(spark, parsed["rows"])
    assert projects.frame_rows(frame) == [{"timestamp": "2026-01-01", "asset": "A", "open": 1.0, "close": None, "extra": {"k": "3"}}]
    projects.save_with_rows(doc, frame, path, str(tmp_path / "rows"))
    assert read_parquet(spark, str(tmp_path / "rows"), {"asset": "asset", "px": "open"}).columns == ["asset", "px"]
    again = projects.load(path)
    assert again["rowsPath"] == str(tmp_path / "rows") and projects.load(path) == projects.parse(json.loads(projects.dumps(again)))
    assert projects.frame_rows(projects.panel(spark, again)) == projects.frame_rows(frame) == projects.frame_rows(projects.panel(spark, parsed))


def test_versions_and_custom_blocks():
    doc = projects.parse(projects.create({**STATE, "cleanedRows": []}, "2026-01-01T00:00:00Z"))
    cleaned = projects.switch(doc, "cleaned")
    assert (cleaned["currentDataVersion"], cleaned["rows"]) == ("cleaned", []) and projects.switch(cleaned, "original")["rows"] == doc["rows"]
    with pytest.raises(projects.ProjectError):
        projects.switch(projects.parse(projects.create(STATE)), "cleaned")
    block = projects.custom_block("Twice it", "x * 2", created_at="2026-01-01T00:00:00.000Z")
    two = projects.add_custom_block(projects.add_custom_block(doc, block), block, 3, 4)
    assert two["customBlocks"] == [block] and len({n["id"] for n in two["nodes"]}) == 3 and projects.parse(two) == two
    with pytest.raises(projects.ProjectError):
        projects.custom_block("broken", "x +")


def test_damaged_parts_of_a_project_are_left_out():
    doc = projects.create(STATE) | {
        "cleaningOptions": {"duplicate": "nonsense", "fillValue": float("nan")},
        "qualityReport": {"rows": 1, "assets": 1, "dates": 1, "zeroPrices": "x", "missingByField": {"open": 2, "low": None}, "issues": ["a", 3]},
        "runResult": {"status": "odd", "expression": "e", "points": [{"timestamp": "t", "asset": "A", "factor": 1.5, "ratio": "x"}, 7], "warnings": None},
        "parseReport": {"delimiter": ";"},
        "customBlocks": [{"id": "a", "name": "n", "expression": "x"}, {"id": 3}],
        "intent": {"text": "t", "confirmed": True, "checks": {"logic": True, "data": 1}},
    }
    got = projects.parse(doc)
    assert got["cleaningOptions"] == projects.DEFAULT_CLEANING and got["parseReport"] is None
    assert got["qualityReport"]["missingByField"] == {"open": 2} and got["qualityReport"]["issues"] == ["a"] and got["qualityReport"]["zeroPrices"] == 0
    run = got["runResult"]
    assert (run["status"], run["missingValues"], len(run["points"]), run["points"][0]["ratio"], run["warnings"]) == ("warning", 1, 1, None, [])
    assert [b["symbol"] for b in got["customBlocks"]] == ["fx"] and got["intent"]["checks"] == {"logic": True, "parameters": False, "data": False}


def test_hexadecimal_and_quoted_cells(spark):
    parsed = delimited.parse_text(spark, 'date, "my, code",code,open,close\n2026-01-01,"a ""b""",x,0x1F,0xFFFFFFFFFFFFFFFFFFFFFF\n2026-01-02,,x,0x,"1,234.5"')
    assert parsed.headers == ["date", "my, code", "code", "open", "close"]
    got = parsed.rows.orderBy("timestamp").collect()
    assert (got[0].open, got[0].close) == (31.0, float(16**22 - 1)) and (got[1].open, got[1].close) == (None, 1234.5)


@pytest.mark.parametrize(
    "change",
    [{"format": "x"}, {"schemaVersion": 3}, {"name": " "}, {"view": "nope"}, {"nodes": None}, {"nodes": [{"id": "n"}]}, {"edges": [{}]}, {"settings": {}}, {"rows": [{"asset": "A"}]}, {"rows": [{"timestamp": "t", "asset": "A", "open": "1"}]}, {"selectedNode": 3}, {"showMore": 1}, {"savedAt": None}],
)
def test_rejected_projects(change):
    with pytest.raises(projects.ProjectError):
        projects.parse({**projects.create(STATE), **change})


def test_tail(spark):
    panel = demo_panel(spark)
    last = tail(panel, 3).collect()
    assert [r._row_id for r in last] == [25, 26, 27] and tail(panel.drop("_row_id"), 2).count() == 2


def test_stream(spark, tmp_path):
    assert lookback("Mean(Ref($close,2),5)/$close") == 6
    df = demo_panel(spark).drop("_row_id")
    days = [r.timestamp for r in df.select("timestamp").distinct().orderBy("timestamp").collect()]
    source = str(tmp_path / "in")
    schema = df.schema
    text = "Mean($close,3)/$close"
    for k, day in enumerate(days):
        df.where(df.timestamp == day).coalesce(1).write.parquet(f"{source}/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
        stream_factor(stream, text, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {(r.asset, r.timestamp): r.factor for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = {(r.asset, r.timestamp): r.factor for r in batch_values(None, df, text).collect()}
    assert got == pytest.approx(whole) and len(whole) == 28
    assert spark.read.parquet(str(tmp_path / "store")).drop("batch").exceptAll(df).isEmpty()


def test_idle_assets_cost_a_batch_nothing(spark, tmp_path):
    """What a batch of one asset changes in the state, beside few and beside many idle assets; nulls stay nulls."""
    schema = "timestamp string, asset string, open double, close double"
    changed = []
    for idle in (3, 60):
        at = tmp_path / str(idle)
        for k, day in enumerate([[(f"2026-01-{d:02d}", f"A{a}", 1.0, None if (a + d) % 4 == 0 else float(a + d)) for a in range(idle) for d in range(1, 6)], [("2026-01-06", "A1", 1.0, 9.0), ("2026-01-07", "A1", 1.0, None)]]):
            spark.createDataFrame(day, schema).coalesce(1).write.parquet(f"{at}/in/{k}")
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/in")
            query = stream_factor(stream, "Mean($close,4)", f"{at}/store", f"{at}/out", f"{at}/check")
            query.awaitTermination()
        changed.append([p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]])
        got = spark.read.parquet(f"{at}/out").where("timestamp > '2026-01-05'").orderBy("timestamp").collect()
        assert [(r.asset, r.close, r.factor) for r in got] == [("A1", 9.0, (5 + 6 + 9) / 3), ("A1", None, (5 + 6 + 9) / 3)]
        assert spark.read.parquet(f"{at}/store").count() == 5 * idle + 2
    assert changed[0] == changed[1]


def test_lines_of_many_partitions(spark, tmp_path):
    """no line is lost or numbered twice where Spark joins the partitions of narrow and wide rows differently."""
    n = 60_000
    spark.range(1, n + 1).selectExpr("id AS event_id", "'type' AS event_type", "id % 100 AS user_id").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    options = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64kb"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        parsed = queries._parse(spark, str(tmp_path))
        rows = parsed.rows.selectExpr("count(*) AS n", "count(DISTINCT _row_id) AS d", "count_if(_row_id = CAST(timestamp AS LONG) + 1) AS right").first()
        errors = parsed.errors.where("field = 'key'").selectExpr("count(*) AS n", "sum(line) AS total").first()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    bad = range(97, n + 1, 97)
    assert (rows.n, rows.d, rows.right) == (n - len(bad),) * 3
    assert (errors.n, errors.total) == (len(bad), sum(k + 1 for k in bad))
    unplaced = spark.range(0, n, 1, 7).selectExpr("IF(id = 0, 'date,code,open,close', concat(id, ',a,1,2')) AS value")
    assert delimited.parse(unplaced).rows.where("_row_id = CAST(timestamp AS LONG) + 1").count() == n - 1

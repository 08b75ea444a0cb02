"""Operators 6 and 7, and the pipeline."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from panelfactor.llm import decontamination, jaccard_join, mixing, quality_classifier
from tests.llm import brute


@pytest.fixture(scope="module")
def labelled(spark):
    """Prose that is good, and shouting or symbol-ridden prose that is bad."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for k in range(600):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        good = k % 3 != 0
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words) if k % 2 else " ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in words)
        rows.append((k, text, "en", f"src{k % 5}", len(text)))
        if k % 5:
            labels.append((k, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    model = quality_classifier.learn(docs, labels)
    out = quality_classifier.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 50 and np.mean([(r.score >= 0.5) == (r.quality == 1) for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_nothing_is_learnt_from_held_out_rows(labelled):
    docs, labels = labelled
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_classifier.learn(docs, labels), quality_classifier.learn(docs, flipped)
    assert a.good == b.good and a.bad == b.bad and (a.weights == b.weights).all()


def test_scores_once_more(spark, labelled, monkeypatch):
    """The whole of operator 6 step by step, with a bound on texts that some exceed."""
    docs, labels = labelled
    monkeypatch.setattr(quality_classifier, "TEXT_BYTES", 700)
    known = {r.doc_id: r.quality for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.col("doc_id")).alias("h")).collect()}
    halves = {}
    for label in (0, 1):
        ids = sorted((i for i, q in known.items() if q == label and zlib.crc32(str(i).encode()) % 3 != 1), key=order.get)
        halves[label] = [texts[i].encode() for i in ids if len(texts[i].encode()) <= 700]
    assert sum(map(len, halves.values())) < sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in known)
    packers = []
    for label in (1, 0):
        d = zstandard.train_dictionary(quality_classifier.DICT_SIZE, halves[label][::2])
        packers.append(zstandard.ZstdCompressor(level=quality_classifier.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def evidence(text):
        good, bad = (len(p.compress(text)) for p in packers)
        return (bad - good) / max(good, bad, 1)

    x = np.array([evidence(t) for label in (1, 0) for t in halves[label][1::2]])
    y = np.array([1.0] * len(halves[1][1::2]) + [0.0] * len(halves[0][1::2]))
    centre, spread = x.mean(), x.std() + 1e-9
    z, w = (x - centre) / spread, np.zeros(2)
    for _ in range(200_000):  # plain gradient descent on the same penalised loss
        p = 1 / (1 + np.exp(-(w[0] * z + w[1])))
        step = np.array([((p - y) * z).mean() + 1e-4 * w[0], (p - y).mean() + 1e-4 * w[1]])
        w -= 4 * step
        if np.abs(step).max() < 1e-9:
            break
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, quality_classifier.learn(docs, labels)).collect()}
    for i, t in texts.items():
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(w[0] * (evidence(t.encode()) - centre) / spread + w[1]))), abs=1e-4)


def test_quality_edges(spark, docs, nothing, labelled):
    _, labels = labelled
    none = quality_classifier.learn(docs, labels.limit(0))
    assert none.weights is None and {r.score for r in quality_classifier.score(docs, none).collect()} == {0.5}
    only_good = quality_classifier.learn(docs, labels.where("quality = 1"))
    assert only_good.weights is None and only_good.share > 0.9
    model = quality_classifier.train([b"aa bb cc"] * 3, [b"!! ??"] * 3)
    out = quality_classifier.score(docs.withColumnRenamed("score", "old"), model)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert quality_classifier.score(nothing, model, out="p").count() == 0


def rake(rows, rate=mixing.RATE):
    """(source, lang, topic, tokens) rows: the chance of each cell, and the cells' expected tokens, margins and targets.

    The same fixed point by another road: each margin's factors are found by bisection over what its cells give.
    """
    x = defaultdict(int)
    for *cell, n in rows:
        x[tuple(cell)] += n
    cells = list(x)
    cap = np.array([x[c] for c in cells], float)
    total = rate * cap.sum()

    def solve(cap, y, goal):
        """min(cap, f * y) with the sum `goal`, or cap where that cannot be."""
        if goal >= cap.sum() * (1 - 1e-12):
            return cap.copy()
        low, high = -60.0, 60.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if np.minimum(cap, 10**mid * y).sum() < goal else (low, mid)
        return np.minimum(cap, 10**high * y)

    names, at, targets = [], [], []
    for k in range(3):
        values = sorted({c[k] for c in cells}, key=str)
        index = np.array([values.index(c[k]) for c in cells])
        own = np.bincount(index, cap)
        share = own**mixing.ALPHA * (own > 0)
        names.append(values)
        at.append(index)
        targets.append(solve(own, share / share.sum() * total, total))
    y = cap * rate
    for _ in range(60):
        for index, target in zip(at, targets, strict=True):
            for v, goal in enumerate(target):
                y[index == v] = solve(cap[index == v], y[index == v], goal)
    return {c: (y[k] / cap[k] if cap[k] else 0.0) for k, c in enumerate(cells)}


def topic(text):
    return next((name for name, parts in mixing.TOPICS if any(p in (text or "") for p in parts)), "prose")


def tokens(text):
    return -(-len((text or "").encode()) // 4)


def test_mixing(docs, corpus):
    out = mixing.weigh(docs, rate=0.05, rounds=60).collect()
    chance = rake([(r[3], r[2], topic(r[1]), tokens(r[1])) for r in corpus], 0.05)
    assert len(out) == len(corpus)
    for r in out:
        assert (r._topic, r._tokens) == (topic(r.text), tokens(r.text))
        assert r._probability == pytest.approx(chance[r.source, r.lang, r._topic], abs=1e-6)
        assert r._probability <= 1 and r._copies == int(r._sampled)
    again = mixing.weigh(docs.repartition(3), rate=0.05, rounds=60).where("_sampled").select("id").collect()
    assert sorted(r.id for r in again) == sorted(r.id for r in out if r._sampled)


def hot(spark):
    """A hot source and rare topics, whose targets are far above what they have."""
    rng = random.Random(12)
    kinds = [("plain words only", 0.9), ("mail@site", 0.03), ("License text", 0.03), ("a | b", 0.02), ("def f", 0.02)]
    rows = [(k, rng.choices([t for t, _ in kinds], [w for _, w in kinds])[0] + " word" * rng.randint(1, 40), "src0" if k % 3 == 0 else f"src{k % 17}", rng.choice(["en", "en", "en", "de"])) for k in range(6000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)


def test_mixing_reaches_every_reachable_target(spark):
    df = hot(spark)
    report = mixing.margins(df).toPandas()
    total = report[report.margin == "lang"].tokens.sum()
    for _, own in report.groupby("margin"):
        share = own.tokens**mixing.ALPHA / (own.tokens**mixing.ALPHA).sum()
        assert own.wanted.to_numpy() == pytest.approx((share * mixing.RATE * total).to_numpy())
        assert own.target.sum() == pytest.approx(mixing.RATE * total) and (own.target <= own.tokens * (1 + 1e-9)).all()
        whole = own.target >= own.tokens * (1 - 1e-9)
        assert (own.target[~whole] >= own.wanted[~whole] * (1 - 1e-9)).all()
    assert (report.target < 0.9 * report.wanted).sum() == 4  # the rare topics
    assert ((report.expected - report.target).abs() <= 0.01 * report.target).all()
    out = mixing.weigh(df).toPandas()
    assert out._probability.max() <= 1
    for m in mixing.MARGINS:
        own = report[report.margin == m].set_index("value")
        expected = (out._tokens * out._probability).groupby(out[f"_{m}"]).sum()
        assert expected.to_dict() == pytest.approx(own.expected.to_dict())
        drawn = out[out._sampled].groupby(f"_{m}")._tokens.sum()
        assert (drawn - own.target).abs().max() < 0.03 * mixing.RATE * total


def test_mixing_with_repeated_rows_reaches_all(spark):
    df = hot(spark)
    report = mixing.margins(df, repeats=8).toPandas()
    assert report.target.to_numpy() == pytest.approx(report.wanted.to_numpy()) and report.expected.to_numpy() == pytest.approx(report.target.to_numpy(), rel=1e-6)
    out = mixing.weigh(df, repeats=8).toPandas()
    assert out._expected.max() > 2 and ((out._copies > 0) == out._sampled).all()
    assert mixing.sample(df, repeats=8).count() == out._copies.sum()


def test_mixing_without_broadcast_and_with_given_targets(docs, monkeypatch):
    plain = sorted((r.id, round(r._probability, 7)) for r in mixing.weigh(docs).collect())
    monkeypatch.setattr(mixing, "CELLS", 0)
    assert sorted((r.id, round(r._probability, 7)) for r in mixing.weigh(docs).collect()) == plain
    given = mixing.weigh(docs, targets={"lang": {"en": 3, "nowhere": 1}, "source": {}}, rate=0.2)
    assert given.where("_probability > 0").count() > 10
    assert given.where("lang <> 'en' and _probability > 0").count() == 0


def test_mixing_uses_no_python(docs, nothing):
    plan = mixing.weigh(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan
    assert mixing.sample(nothing).count() == 0


def test_pipeline(spark, labelled, tmp_path):
    docs, labels = labelled
    rows = [tuple(r) for r in docs.collect()]
    rng = random.Random(8)
    line = "All rights reserved by nobody in particular"
    rows = [(i, f"{t}\n{line}" if i % 2 else t, lang, f"src{i % 13}", n) for i, t, lang, _, n in rows]
    good = [r for r in rows if r[0] % 3]
    for k in range(40):  # near copies
        words = good[k][1].split(" ")
        if k % 2:
            words[rng.randrange(3)] += "q"
        rows.append((1000 + k, " ".join(words), "en", "src1", 0))
    items = [(1, " ".join(good[50][1].split()[3:20])), (2, "something else that no document has at all in its text")]
    schema = docs.schema
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)
    out = corpus_pipeline.run(spark, d)
    got = sorted((r.doc_id, r.text, r.n_chars) for r in out.collect())

    # the same, step by step
    frame = spark.createDataFrame(rows, schema)
    model = quality_classifier.learn(frame, labels)
    scores = model.scores([r[1].encode() for r in rows])
    kept = [r for r, s in zip(rows, scores, strict=True) if s >= 0.5]
    sites = {}
    for r in kept:
        for x in r[1].split("\n"):
            sites.setdefault(x.strip(" "), set()).add(r[3])
    clean = []
    for i, t, lang, source, n in kept:
        left = [x for x in t.split("\n") if not x.strip(" ") or len(sites[x.strip(" ")]) < 10]
        text = "\n".join(left)
        clean.append((i, text, lang, source, len(text) if text != t else n))
    least = brute.components([(r[0], r[1]) for r in clean], 5, 80)
    single = [r for r, (i, _, c) in zip(clean, least, strict=True) if c == i]
    bad = {w[0] for w in brute.contamination([(r[0], r[1]) for r in single], items) if w[5]}
    pure = [r for r in single if r[0] not in bad]
    assert bad and len(single) < len(clean) < len(rows)
    chance = rake([(r[3], r[2], topic(r[1]), tokens(r[1])) for r in pure])
    import hashlib

    def draw(i):
        return int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:12], 16) / 2**48

    want = sorted((r[0], r[1], r[4]) for r in pure if draw(r[0]) < chance[r[3], r[2], topic(r[1])])
    assert got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "benchmark", "mix"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, d).columns == docs.columns


def test_stages_keep_extra_columns_of_any_name(spark, labelled, tmp_path):
    docs, labels = labelled
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    extra = ["_p", "good", "n_removed", "N_LINES", "_sampled", "_topic", "topic", "Tokens", "probability", "_probability", "c0", "id", "row", "key", "gone", "fp", "_score", "item_id", "k1", "site"]
    wide = docs.limit(60).select("*", *(F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in extra))
    wide = spark.createDataFrame(wide.collect(), wide.schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, str(tmp_path))
        assert out.columns == [*wide.columns, *(["__topic", "_tokens", "__probability"] if name == "mix" else [])]
        rows = out.collect()
        assert rows and all(r[5 + k] == f"{c}:{r.doc_id}" for r in rows for k, c in enumerate(extra))


def test_stages_take_empty_tables(spark, nothing, labelled, tmp_path):
    _, labels = labelled
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0


def test_same_sets_by_any_route(docs):
    a = jaccard_join.join(docs).orderBy("doc_id", "n_shingles").collect()
    assert a == jaccard_join.join(docs.coalesce(1)).orderBy("doc_id", "n_shingles").collect()
    assert decontamination.SIZE == 10

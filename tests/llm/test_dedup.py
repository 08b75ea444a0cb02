"""Operators 1, 5, 8 and 10 against brute force."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelfactor.llm import _spark, decontamination, jaccard_join, line_dedup, substring_dedup
from tests.llm import brute


def texts(corpus):
    return [(r[0], r[1]) for r in corpus]


def key(r):
    return tuple((x is None, str(x)) for x in r)


def same(df, want):
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize(("size", "hot"), [(5, 1000), (20, 1)])
def test_repeated_windows(docs, corpus, monkeypatch, size, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    out = substring_dedup.remove_repeats(docs, size=size)
    same(out.select("doc_id", "n_words", "n_removed", "kept_sha256"), brute.repeats(texts(corpus), size))
    for r in out.where("n_removed > 0").collect():
        assert sum(b - a for a, b in r.intervals) == r.n_removed
        assert all(x[1] < y[0] for x, y in zip(r.intervals, r.intervals[1:], strict=False))
        assert len(r.kept_text.split()) == r.n_words - r.n_removed


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_components(docs, corpus, n, percent):
    same(jaccard_join.join(docs, n=n, percent=percent), brute.components(texts(corpus), n, percent))


def test_components_without_a_pivot_that_links_to_all(spark):
    """Chains and rings of sets, of which no single one links with all the others."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):
        words = list(base)
        for j in range(k):  # k drifts away from the base word by word
            words[2 * j % 120] = f"v{j}"
        rows.append((rng.randrange(10**6) * 100 + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(jaccard_join.join(df, n=2, percent=80), brute.components(rows, 2, 80))


@pytest.mark.parametrize("small", [False, True])
def test_components_of_clusters_near_the_threshold(spark, monkeypatch, small):
    """Clusters of near copies whose references differ by about the limit, so that only followers may link; also with tiny blocks, shares and broadcasts."""
    if small:
        monkeypatch.setattr(jaccard_join, "BLOCK", 2)
        monkeypatch.setattr(jaccard_join, "SPLIT", 2)
        monkeypatch.setattr(_spark, "HEAVY", 4)
    rng = random.Random(21)
    rows = []
    for family in range(12):
        base = [f"f{family}w{k}" for k in range(100)]
        for cluster in range(3):
            centre = list(base)
            for j in rng.sample(range(100), rng.randint(3, 8)):
                centre[j] = f"c{cluster}x{j}"
            for member in range(6):
                words = list(centre)
                for j in rng.sample(range(100), rng.randint(0, 5)):
                    words[j] = rng.choice([base[j], f"m{member}y{j}"])
                rows.append((len(rows), " ".join(words[: rng.randint(96, 100)])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same(jaccard_join.join(df, n=1, percent=90), brute.components(rows, 1, 90))


def test_sets_with_equal_first_prints(docs, corpus):
    """With first prints of 4 bits all sets share one with others: the second print tells them apart."""
    out = jaccard_join._classed(docs, "doc_id", "text", 3, 90, bits=4)
    same(out.select("doc_id", "n_shingles", "component_id"), brute.components(texts(corpus), 3, 90))


def test_one_of_each_group_stays(docs, corpus):
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    want = [k for k, (i, _, c) in enumerate(brute.components(texts(corpus), 5, 80)) if c == i]
    assert sorted(r.id for r in kept.collect()) == want


def test_rows_without_an_id_or_with_a_repeated_one_are_judged_alone(spark):
    rng = random.Random(9)
    a, b, c, d, e = (" ".join(f"{p}{rng.randrange(10**6)}" for _ in range(40)) for p in "abcde")
    rows = [(1, a, 0), (None, a.upper(), 1), (None, b, 2), (None, c, 3), (None, c.upper(), 4), (None, c, 5), (2, a, 6), (2, d, 7), (None, None, 8), (None, " ", 9), (None, None, 10), (5, e, 11), (5, e, 12)]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, k long").repartition(3))
    ks = {r.k for r in kept.collect()}
    assert ks - {3, 4, 5} == {0, 2, 7, 8, 9, 10, 11, 12} and len(ks & {3, 4, 5}) == 1


def test_long_sets_at_the_threshold(spark):
    """450,000 shared of 475,000 words each: a similarity of 0.9 exactly, which halves of hashes miss by some 20."""
    shared = " ".join(f"w{k}" for k in range(450_000))
    rows = [(j, f"{shared} " + " ".join(f"{j}v{k}" for k in range(25_000 + (j == 3)))) for j in (1, 2, 3)]
    df = spark.createDataFrame(rows[:2], "doc_id long, text string").repartition(2)
    assert [r.component_id for r in jaccard_join.join(df, n=1, percent=90).collect()] == [1, 1]
    df = spark.createDataFrame(rows[1:], "doc_id long, text string").repartition(2)
    assert sorted(r.component_id for r in jaccard_join.join(df, n=1, percent=90).collect()) == [2, 3]


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 110), (110, 200)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(60)]
    got = {r.node: r.root for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {x: find(x) for x in parent}


ITEMS = [(1, None), (2, ""), (3, "one"), (4, "la la la"), (None, "nobody owns this item at all"), (5, "?!")]


@pytest.mark.parametrize("block", [400_000, 40])
def test_contamination(spark, docs, corpus, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK", block)
    words = brute.ALNUM.findall(corpus[7][1].translate(brute.LOWER))
    items = [*ITEMS, (6, " ".join(words[:30]).upper()), (7, " ".join(words[5:17])), (8, " - ".join(words[-9:])), (9, corpus[91][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find(docs, table)
    out = found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long"), decontamination.items_digest("items"), F.col("n_hit") > 0)
    want = brute.contamination(texts(corpus), items)
    same(out, want)
    clean = decontamination.drop_contaminated(docs, table)
    assert clean.columns == docs.columns
    assert sorted(r.id for r in clean.collect()) == [k for k, w in enumerate(want) if not w[5]]


def test_contamination_by_an_item_longer_than_a_block(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK", 25)
    items = [(1, corpus[91][1]), (2, corpus[4][1]), (3, "one")]
    groups = list(decontamination._blocks(iter(items), 10))
    assert all(sum(high - low for *_, low, high in g) <= 25 for g in groups) and sum(any(n == 1 for n, *_ in g) for g in groups) > 3
    found = decontamination.find(docs, spark.createDataFrame(items, "item_id long, text string"))
    out = found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long"), decontamination.items_digest("items"), F.col("n_hit") > 0)
    same(out, brute.contamination(texts(corpus), items))


def test_contamination_without_items(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find(docs, none).where("n_hit > 0 or size(items) > 0").count() == 0


@pytest.mark.parametrize(("min_sites", "heavy"), [(2, 10_000), (10, 3), (14, 1)])
def test_lines(docs, corpus, monkeypatch, min_sites, heavy):
    monkeypatch.setattr(_spark, "HEAVY", heavy)
    out = line_dedup.remove(docs, min_sites=min_sites)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256))
    same(got, brute.boilerplate([(r[0], r[1], r[3]) for r in corpus], min_sites))
    assert out.where("text is null").count() == 1


def test_lines_use_no_python(docs):
    plan = line_dedup.remove(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan


def test_empty_tables(nothing, spark):
    assert substring_dedup.remove_repeats(nothing).count() == 0
    assert jaccard_join.join(nothing).count() == 0 and jaccard_join.keep_one(nothing).count() == 0
    assert decontamination.find(nothing, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0
    assert line_dedup.remove(nothing).count() == 0


def test_few_links_take_few_jobs(spark, monkeypatch):
    """op10, pipeline: the same labels as in rounds, in a handful of jobs."""
    rng = random.Random(3)
    edges = [(k + 1, k) for k in range(-300, 300)] + [(rng.randrange(1000, 4000), rng.randrange(1000, 4000)) for _ in range(1500)] + [(9000, 9000), (9000, 9000), (-(1 << 63), (1 << 63) - 1)]
    links = spark.createDataFrame(edges, "a long, b long").repartition(5)
    spark.sparkContext.setJobGroup("few links", "few links")
    few = {r.node: r.root for r in jaccard_join.components(links).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few links")
    spark.sparkContext._jsc.clearJobGroup()
    assert 0 < len(jobs) <= 12
    monkeypatch.setattr(jaccard_join, "FEW", 0)
    assert few == {r.node: r.root for r in jaccard_join.components(links).collect()}
    assert jaccard_join.components(links.where("a is null")).isEmpty()


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_sets_that_may_link_are_in_one_band(percent):
    """op10's disk: a set's band or the one of its largest partner is that of any larger set that it may link to."""
    edges = jaccard_join._bands(percent)
    for x in [*range(1, 300), 9999, 10_000, 123_456]:
        top = int(jaccard_join._reached(np.array([x]), percent)[0])
        own, upper = (int(np.searchsorted(edges, s, "right")) for s in (x, top))
        for y in {x, top, *range(x, min(top, x + 60) + 1)}:
            assert 100 * x >= percent * y and int(np.searchsorted(edges, y, "right")) in (own, upper)


@pytest.mark.parametrize("percent", [30, 80, 90])
def test_linked_sets_share_enough_of_their_longer_prefixes(percent):
    rng, linked = random.Random(percent), 0
    for _ in range(3000):
        both = rng.sample(range(4000), rng.choice([1, 3, 10, 40, 200, 600]))
        x, y = (sorted({*both, *rng.sample(range(4000), rng.randint(0, 1 + len(both) * (100 - percent) // percent))}) for _ in range(2))
        i = len({*x} & {*y})
        if 100 * i < percent * (len(x) + len(y) - i):
            continue
        linked += 1
        heads, least = [], []
        for s in (x, y):
            alike = (percent * len(s) + 99) // 100
            heads.append({*s[: len(s) - alike + int(jaccard_join._least_shared(np.array([len(s)]), percent)[0])]})
            least.append(int(jaccard_join._least_shared(np.array([alike]), percent)[0]))
        assert len(heads[0] & heads[1]) >= max(least)
    assert linked > 300


def test_sets_with_a_few_chance_shingles_in_common_are_in_no_list():
    """op10's disk: texts of a shared vocabulary have words in common with many others, but no other text with enough of them."""
    rng = random.Random(3)
    texts = [" ".join(rng.sample([f"w{k}" for k in range(200_000)], 600)) for _ in range(50)]
    texts.append(texts[0] + " more words")
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    rare, seen = SimpleNamespace(value=(np.zeros(0, np.uint64), np.zeros(0, np.int32))), {}
    for part in jaccard_join._prefixes(1, 90, jaccard_join.Prints(), rare)([batch]):
        for k, fp in zip(*(part.column(c).to_numpy().view(np.uint64).tolist() for c in ("key", "fp")), strict=True):
            seen.setdefault(k, set()).add(fp)
    met = np.array([k for k, fps in seen.items() if len(fps) > 1], np.uint64)
    assert len(met) > 100
    shared = SimpleNamespace(value=SimpleNamespace(has=lambda keys: np.isin(keys, met)))
    listed = {fp for part in jaccard_join._prefixes(1, 90, jaccard_join.Prints(), rare, shared)([batch]) for fp in part.column("fp").to_pylist()}
    assert len(listed) == 2


def test_long_sets_are_kept_apart_by_their_sketches(spark):
    """op10's disk: unrelated sets of 20,000 shingles do not move, and a pair of sketches of two sizes is compared in the smaller one's."""
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (20_000, 20_000, 1000)]
    sets += [np.concatenate([sets[2], rng.integers(0, 1 << 63, 60, dtype=np.uint64)])]
    wide = jaccard_join._wide(np.concatenate(sets), np.cumsum([0, *map(len, sets)])).to_pylist()
    assert [len(w) for w in wide] == [512, 512, 16, 32]
    groups = spark.createDataFrame(list(enumerate(wide)), "fp long, wide array<long>")
    pairs = spark.createDataFrame([(a, b, len(sets[a]) + len(sets[b]), 0) for a, b in ((0, 1), (2, 3), (3, 2))], "a long, b long, sizes long, slack long")
    assert sorted(map(tuple, jaccard_join._tried(pairs, groups, 90).collect())) == [(2, 3), (3, 2)]


def test_lists_with_a_hot_shingle(docs, corpus, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FLOOR", 3)
    monkeypatch.setattr(jaccard_join, "HEAVY", 1 << 40)
    same(jaccard_join.join(docs), brute.components(texts(corpus)))

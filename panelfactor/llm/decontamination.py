"""Benchmark decontamination (8): prefix-filtered containment join.

A window is `size` consecutive words of a benchmark item, or the whole of a
shorter item.  Exact containment means that all shingles of a window occur, so
a prefix of one suffices: each window is looked up under its rarest shingle
of up to `gram` words, by the number of times that the corpus has it.

1. One pass counts the benchmark's shingles in all documents.
2. A second finds each document's shingles among those keys, places the window
   around each hit (positional bound: its offset must fit into the document;
   length bound: the document must hold the whole window), and verifies the
   whole window word by word.

The item side is broadcast in blocks of at most BLOCK windows, each matched
against all rows; a longer item goes over several blocks.  With several blocks
their hits are merged by row, so no size of the benchmark overfills a task.

Defined cases: null texts have no words, so they hit nothing; items without
words have no window; equal windows of several items count for each; a null
item_id is left out of the item list.  Rows stay as they are, with any id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfactor.llm import _words as W
from panelfactor.llm._spark import arrow, documents

SIZE, GRAM = 10, 3
#: windows in a broadcast block at most: about 150 bytes each
BLOCK = 400_000


@dataclass
class Block:
    """Windows of some items: their words' hashes (padded), lengths, items and the keys they are found by."""

    words: np.ndarray  # n_windows x size
    length: np.ndarray
    item: np.ndarray  # row of `names`
    names: list
    gram: np.ndarray  # shingle length of a window
    key: np.ndarray | None = None  # rarest shingle, ascending over `by`
    offset: np.ndarray | None = None
    by: np.ndarray | None = None  # window of each key


def _windows(parts: list[tuple[object, np.ndarray, int, int]], size: int, gram: int) -> Block:
    """Windows number `low` to `high` of items, given as (item_id, hashes of the words, low, high)."""
    rows, length, owner = [np.zeros((0, size), np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, (_, h, low, high) in enumerate(parts):
        n = min(size, len(h))
        own = np.lib.stride_tricks.sliding_window_view(h, n)[low:high]
        rows.append(np.pad(own, ((0, 0), (0, size - n))))
        length.append(np.full(len(own), n))
        owner.append(np.full(len(own), k))
    lengths = np.concatenate(length)
    return Block(np.concatenate(rows), lengths, np.concatenate(owner), [i for i, *_ in parts], np.minimum(gram, lengths))


def _shingles(b: Block, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows that are found by shingles of g words: their rows, shingles (rows x places) and which places are inside the window."""
    rows = np.flatnonzero(b.gram == g)
    places = b.words.shape[1] - g + 1
    out = np.zeros((len(rows), places), np.uint64)
    for j in range(g):
        out = out * np.uint64(W.BASE) + b.words[rows, j : j + places]
    return rows, out, np.arange(places)[None, :] <= (b.length[rows] - g)[:, None]


def _count(shared):
    """Times that each benchmark shingle occurs in these documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        totals = {g: np.zeros(len(v), np.int64) for g, v in grams.items()}
        for batch in batches:
            for part in W.slices(batch, "text"):
                w = W.words(part.column("text"), W.ALNUM, lower=True)
                for g, known in grams.items():
                    starts, _ = W.starts_inside(w.first, g, len(w.hash))
                    h = W.rolling(w.hash, g)[starts] if len(starts) else np.zeros(0, np.uint64)
                    at, hit = _find(known, h)
                    np.add.at(totals[g], at[hit], 1)
        for g, known in grams.items():
            some = totals[g] > 0
            yield pa.record_batch([pa.array(np.full(int(some.sum()), g, np.int32)), pa.array(known[some].view(np.int64)), pa.array(totals[g][some])], names=["g", "h", "n"])

    return work


#: bits of a first test that rejects most words before the binary search
_SIEVE = 20


def _find(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each h in the ascending `known`, and whether it is there."""
    at, hit = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    if not len(known) or not len(h):
        return at, hit
    sieve = np.zeros(1 << _SIEVE, bool)
    sieve[W.mix(known) >> np.uint64(64 - _SIEVE)] = True
    maybe = np.flatnonzero(sieve[W.mix(h) >> np.uint64(64 - _SIEVE)])
    place = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
    at[maybe], hit[maybe] = place, known[place] == h[maybe]
    return at, hit


def _choose_keys(b: Block, seen: dict[int, tuple[np.ndarray, np.ndarray]]) -> Block:
    """Give each window its rarest shingle (ties: the least hash) and that one's offset.

    seen has, by length, the shingles that the corpus has, ascending, and how often.
    """
    n = len(b.length)
    key, offset = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for g in np.unique(b.gram).tolist():
        rows, shingles, inside = _shingles(b, g)
        known, times = seen.get(g, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        count = np.zeros(shingles.shape, np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
            count = np.where(known[at] == shingles, times[at], 0)
        count[~inside] = np.iinfo(np.int64).max
        rarest = count == count.min(axis=1)[:, None]
        best = np.where(rarest, shingles, np.uint64(0xFFFFFFFFFFFFFFFF)).argmin(axis=1)
        best = np.where(rarest[np.arange(len(rows)), best], best, rarest.argmax(axis=1))
        key[rows], offset[rows] = shingles[np.arange(len(rows)), best], best
    order = np.lexsort((key, b.gram))
    return Block(b.words, b.length, b.item, b.names, b.gram, key[order], offset[order], order)


def match(w: W.Words, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of the block's windows: the first word of each, and the window."""
    found_at, found_w = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    order_gram = b.gram[b.by]
    for g in np.unique(order_gram).tolist():
        part = np.flatnonzero(order_gram == g)
        known, first, many = np.unique(b.key[part], return_index=True, return_counts=True)
        starts, doc = W.starts_inside(w.first, g, len(w.hash))
        h = W.rolling(w.hash, g)[starts] if len(starts) else np.zeros(0, np.uint64)
        place, hit = _find(known, h)
        starts, doc, place = starts[hit], doc[hit], place[hit]
        for step in range(0, len(starts), 1 << 16):  # windows that share a key multiply hits: go by blocks
            s, d, p = (x[step : step + (1 << 16)] for x in (starts, doc, place))
            each = many[p]
            row = np.repeat(np.arange(len(s)), each)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            slot = part[first[p[row]] + nth]
            window = b.by[slot]
            at = s[row] - b.offset[slot]
            ok = (at >= w.first[d[row]]) & (at + b.length[window] <= w.first[d[row] + 1])
            at, window = at[ok], window[ok]
            for k in range(b.words.shape[1]):  # verify word by word
                inside = k < b.length[window]
                same = ~inside
                same[inside] = w.hash[at[inside] + k] == b.words[window[inside], k]
                at, window = at[same], window[same]
            found_at.append(at)
            found_w.append(window)
    return np.concatenate(found_at), np.concatenate(found_w)


def _hits(shared, extra: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        for batch in batches:
            for part in W.slices(batch, "text"):
                w = W.words(part.column("text"), W.ALNUM, lower=True)
                at, window = match(w, b)
                edge = np.zeros(len(w.hash) + 1, np.int32)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + b.length[window], -1)
                hit = np.cumsum(edge) > 0
                before = np.concatenate([[0], np.cumsum(hit[:-1])])
                doc = np.searchsorted(w.first, at, side="right") - 1
                pairs = np.unique(np.stack([doc, b.item[window]]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
                items: list[list] = [[] for _ in range(part.num_rows)]
                for d, i in pairs.T.tolist():
                    if b.names[i] is not None:
                        items[d].append(b.names[i])
                spans: list[list] = [[] for _ in range(part.num_rows)]
                for d in np.unique(doc).tolist():
                    lo, hi = w.first[d], w.first[d + 1]
                    x = np.flatnonzero(np.diff(np.concatenate([[0], hit[lo:hi].view(np.int8), [0]])))
                    spans[d] = x.reshape(-1, 2).tolist()
                yield pa.record_batch(
                    [part.column(c) for c in extra] + [pa.array(w.counts()), pa.array(before[w.first[1:]] - before[w.first[:-1]]), pa.array([sorted(set(x)) for x in items], pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                    names=[*extra, "n_words", "n_hit", "items", "spans"],
                )

    return work


def _blocks(items: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    """(item_id, text) rows as groups of at most BLOCK windows; an item with more of them goes over several groups."""
    group, n = [], 0
    for name, text in items:
        h = W.words(pa.array([text], pa.string()), W.ALNUM, lower=True).hash
        low, last = 0, max(len(h) - size + 1, 1) if len(h) else 0
        while low < last:
            high = min(last, low + BLOCK - n)
            group.append((name, h, low, high))
            n += high - low
            low = high
            if n >= BLOCK:
                yield group
                group, n = [], 0
    if group:
        yield group


def _no_keys(size: int, gram: int) -> Block:
    return _choose_keys(_windows([], size, gram), {})


def _prepare(texts: DataFrame, benchmark: DataFrame, size: int, gram: int) -> list:
    """Broadcast blocks of windows with keys chosen by the counts over texts (a DataFrame of `text`); one at least."""
    sc, results = texts.sparkSession.sparkContext, []
    source = ((r[0], r[1]) for r in benchmark.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator())
    for group in _blocks(source, size):
        block = _windows(group, size, gram)
        grams = {}
        for g in np.unique(block.gram).tolist():
            _, shingles, inside = _shingles(block, g)
            grams[g] = np.unique(shingles[inside])
        counted = arrow(texts, _count(sc.broadcast(grams)), "g int, h long, n long").groupBy("g", "h").agg(F.sum("n").alias("n")).toArrow()  # at most the block's shingles
        of, h, n = (counted.column(k).to_numpy() for k in ("g", "h", "n"))
        seen = {}
        for g in grams:
            own, times = h[of == g].view(np.uint64), n[of == g]
            order = np.argsort(own)
            seen[g] = own[order], times[order]
        results.append(sc.broadcast(_choose_keys(block, seen)))
    return results or [sc.broadcast(_no_keys(size, gram))]


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, blocks: list | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, items (array of item_id), spans (word offsets [from, to) that are hit)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    results = blocks or _prepare(rows.select("text"), benchmark, size, gram)
    schema = "n_words long, n_hit long, items array<long>, spans array<array<long>>"
    if len(results) == 1:
        return arrow(rows, _hits(results[0], ["doc_id"]), f"doc_id long, {schema}")
    # each block adds to the row's hits: rows are told apart by id and text
    named = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    parts = [arrow(named, _hits(b, ["doc_id", "row"]), f"doc_id long, row long, {schema}").where("n_hit > 0").select("doc_id", "row", "items", "spans") for b in results]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.union(p)
    hits = hits.groupBy("doc_id", "row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")).withColumnRenamed("doc_id", "id2")
    none = F.array().cast("array<long>")
    base = arrow(named, _hits(spark.sparkContext.broadcast(_no_keys(size, gram)), ["doc_id", "row"]), f"doc_id long, row long, {schema}").select("doc_id", "row", "n_words")
    joined = base.join(hits, (base["row"] == hits["row"]) & base["doc_id"].eqNullSafe(hits["id2"]), "left").select("doc_id", "n_words", F.coalesce("items", none).alias("items"), F.coalesce("spans", F.array().cast("array<array<long>>")).alias("spans"))
    start = F.struct(F.array().cast("array<array<long>>").alias("done"), F.lit(0).cast("long").alias("to"))
    merged = F.aggregate(
        "spans",
        start,
        lambda a, s: F.when(s[0] <= a["to"], F.struct(F.concat(F.slice(a["done"], 1, F.greatest(F.size(a["done"]) - 1, F.lit(0))), F.array(F.array(F.when(F.size(a["done"]) > 0, F.element_at(a["done"], F.greatest(F.size(a["done"]), F.lit(1)))[0]).otherwise(s[0]), F.greatest(a["to"], s[1])))).alias("done"), F.greatest(a["to"], s[1]).alias("to"))).otherwise(F.struct(F.concat(a["done"], F.array(s)).alias("done"), s[1].alias("to"))),
        lambda a: a["done"],
    )
    joined = joined.withColumn("spans", merged)
    return joined.select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0]).alias("n_hit"), "items", "spans")


def items_digest(col: str):
    """sha256 over the item ids, sorted as strings and comma-joined."""
    return F.sha2(F.array_join(F.array_sort(F.transform(col, lambda x: x.cast("string"))), ","), 256)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items_digest("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _clean_rows(shared):
    hits = _hits(shared, [])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                n_hit = np.concatenate([x.column("n_hit").to_numpy() for x in hits(iter([part]))])
                yield part.filter(pa.array(n_hit == 0))

    return work


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """The rows of docs whose text has no hit, with all their columns."""
    blocks = _prepare(docs.select(F.col(text_col).alias("text")), benchmark, size, gram)
    names = ["text" if c == text_col else f"c{k}" for k, c in enumerate(docs.columns)]
    for block in blocks:
        plain = docs.toDF(*names)
        docs = arrow(plain, _clean_rows(block), plain.schema).toDF(*docs.columns)
    return docs

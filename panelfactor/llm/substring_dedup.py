"""Substring dedup (5): repeated windows of words, by Rabin-Karp hashes.

Every window of `size` consecutive words has a rolling polynomial hash.  A
window is a repeat when the same words also start at a smaller (doc_id,
start); the words under repeats go, merged into maximal intervals.

A hash of every window in one shuffle would be several times the input, so
three passes narrow it, none of which loses a repeat:

1. Each window has an anchor: the least hash among its shingles of `gram`
   words.  Equal windows have equal anchors, and neighbours mostly share
   theirs.  Anchors are counted (combined in each task first).
2. A bit array of fixed size tells which anchors occur twice.  The texts are
   read again; runs of windows under such an anchor are sent, keyed by the
   anchor, after each task has resolved repeats inside its own slice.  A
   passage in every document thus sends a row for each slice, not each copy.
   Runs of anchors that occur more than HOT times are sent window by window,
   keyed by the anchor and a part of the window's hash: equal windows still
   meet, and no task gets all of a hot anchor.
3. Per (anchor, window) the least (doc_id, start) is the one that stays.  The
   others return as bit masks of 64 starts, joined to the texts by doc_id.

Defined cases: a null text is empty; a null doc_id sorts last; rows that share
a doc_id are one document (equal starts in them are one place, marks in one
hold for all); texts under `size` words keep every word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelfactor.llm import _words as W
from panelfactor.llm._spark import Bitmap, arrow, cut, documents, null_id

SIZE, GRAM = 20, 8
#: occurrences of an anchor from which its windows are dealt to PARTS parts
HOT, PARTS = 1000, 64


def _anchors(h: np.ndarray, first: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, their documents and their anchors."""
    starts, doc = W.starts_inside(first, size, len(h))
    if not len(starts):
        return starts, doc, np.zeros(0, np.uint64)
    low = W.mix(W.rolling(h, gram))
    span, have = size - gram + 1, 1
    while have < span:  # sliding minimum by doubling
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return starts, doc, low[starts]


def _count_anchors(size: int, gram: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                w = W.words(part.column("text"))
                starts, doc, low = _anchors(w.hash, w.first, size, gram)
                if not len(low):
                    continue
                run = np.ones(len(low), bool)  # one count for each run of windows under one anchor
                run[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
                value, count = np.unique(low[run], return_counts=True)
                # a run of windows may itself repeat inside: the same anchor value with several starts
                inner = np.unique(low[1:][(~run)[1:]])
                count = np.where(np.isin(value, inner) & _selfsame(w, low, value, size), count + 1, count)
                yield pa.record_batch([pa.array(value.view(np.int64)), pa.array(count.astype(np.int32))], names=["m", "n"])

    return work


def _selfsame(w: W.Words, low: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Anchors under which some window repeats within this slice (as in `la la la ...`)."""
    starts, _ = W.starts_inside(w.first, size, len(w.hash))
    h = W.mix(W.rolling(w.hash, size))[starts]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.unique(low[order][1:][same])
    return np.isin(value, twice)


def _runs(size: int, gram: int, shared) -> object:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, hot = shared.value
        for batch in batches:
            for part in W.slices(batch, "text", 16 << 20):
                w = W.words(part.column("text"))
                starts, doc, low = _anchors(w.hash, w.first, size, gram)
                keep = often.has(low)
                if not keep.any():
                    continue
                h = W.mix(W.rolling(w.hash, size))[starts[keep]]
                doc, low = doc[keep], low[keep]
                at = starts[keep] - w.first[doc]
                ids = part.column("id").to_numpy()[doc]
                yield from _rows(ids, at, low, h, doc, hot)

    return work


def _rows(ids, at, low, h, doc, hot: Bitmap) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((at, ids, low, h))
    oh, ol, oi, oa = h[order], low[order], ids[order], at[order]
    head = np.ones(len(order), bool)
    head[1:] = (oh[1:] != oh[:-1]) | (ol[1:] != ol[:-1])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    later_sorted = (oi != oi[lead]) | (oa != oa[lead])  # not at the first place of this window here
    later = np.zeros(len(order), bool)
    later[order] = later_sorted
    dup = np.zeros(len(order), bool)  # the same place again, from a repeated row
    dup[order] = ~later_sorted & ~head
    # marks that are already certain
    place, bit = at[later] >> 6, np.uint64(1) << (at[later] & 63).astype(np.uint64)
    if len(place):
        cut = np.ones(len(place), bool)
        cut[1:] = (place[1:] != place[:-1]) | (doc[later][1:] != doc[later][:-1])
        begin = np.flatnonzero(cut)
        mask = np.bitwise_or.reduceat(bit, begin)
        n = len(begin)
        yield _batch(ids[later][begin], pa.array(ids[later][begin]), np.full(n, -1), pa.nulls(n, pa.list_(pa.int64())), place[begin], mask, np.zeros(n, np.int64))
    sent = np.flatnonzero(~later & ~dup)
    if len(sent):
        d, a, m = doc[sent], at[sent], low[sent]
        cut = np.ones(len(sent), bool)
        many = hot.has(m)
        cut[1:] = (d[1:] != d[:-1]) | (m[1:] != m[:-1]) | (a[1:] != a[:-1] + 1) | many[1:]
        begin = np.flatnonzero(cut)
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(sent)).astype(np.int32)), pa.array(h[sent].view(np.int64)))
        part = np.where(many[begin], (h[sent][begin] % np.uint64(PARTS)).astype(np.int64), 0)
        yield _batch(ids[sent][begin], pa.array(m[begin].view(np.int64)), part, lists, None, None, a[begin])


def _batch(ids, m, part, lists, place, mask, at) -> pa.RecordBatch:
    n = len(ids)
    place = pa.nulls(n, pa.int64()) if place is None else pa.array(place.astype(np.int64))
    mask = pa.nulls(n, pa.int64()) if mask is None else pa.array(mask.view(np.int64))
    return pa.record_batch([pa.array(ids), m, pa.array(part.astype(np.int32)), pa.array(at.astype(np.int64)), lists, place, mask], names=["id", "m", "part", "at", "hs", "place", "mask"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """Rows (id, marks): per document with repeats, bit masks of the starts of repeated windows."""
    gram = min(gram, size)
    texts = docs.select(null_id(id_col).alias("id"), F.col(text_col).alias("text"))
    twice = arrow(texts.select("text"), _count_anchors(size, gram), "m long, n int").groupBy("m").agg(F.sum("n").alias("n")).where("n > 1")
    twice = cut(twice)
    shared = docs.sparkSession.sparkContext.broadcast((Bitmap.of(twice, "m"), Bitmap.of(twice.where(F.col("n") > HOT), "m", 20)))
    runs = arrow(texts, _runs(size, gram, shared), "id long, m long, part int, at long, hs array<long>, place long, mask long")
    windows = runs.repartition("m", "part").select("id", "m", "part", "at", "place", "mask", F.posexplode_outer("hs").alias("k", "h"))
    order = Window.partitionBy("m", "part", "h").orderBy("id", "at")
    ranked = windows.withColumn("at", F.col("at") + F.coalesce("k", F.lit(0))).withColumn("r", F.when(F.col("h").isNotNull(), F.rank().over(order)))
    marks = ranked.where("mask is not null or r > 1").select(
        "id",
        F.coalesce("place", F.shiftright("at", 6)).alias("place"),
        F.coalesce("mask", F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask"),
    )
    marks = marks.groupBy("id", "place").agg(F.bit_or("mask").alias("mask"))
    return marks.groupBy("id").agg(F.collect_list(F.struct("place", "mask")).alias("marks"))


def _clean(size: int, with_text: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "intervals", "kept_text")}
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks"), strict=True):
                ws = (text or "").encode().split()
                gone, spans = _covered(marks, len(ws), size)
                kept = ws if gone is None else [x for x, g in zip(ws, gone, strict=True) if not g]
                joined = b" ".join(kept)
                out["n_words"].append(len(ws))
                out["n_removed"].append(len(ws) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
                out["intervals"].append(spans)
                out["kept_text"].append(joined.decode() if with_text else None)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["intervals"], pa.list_(pa.list_(pa.int64()))), pa.array(out["kept_text"], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "intervals", "kept_text"],
            )

    return work


def _covered(marks, n: int, size: int):
    """Which of n words lie in a marked window, and the maximal intervals [from, to) of them."""
    if not marks.is_valid or n < size:
        return None, []
    flat = marks.values.flatten()
    place, mask = flat[0].to_numpy(), flat[1].to_numpy().view(np.uint64)
    bits = np.unpackbits(np.ascontiguousarray(mask).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, col = np.nonzero(bits)
    start = place[row] * 64 + col
    start = start[start <= n - size]
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + size, -1)
    gone = np.cumsum(edge[:n]) > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    return gone, turn.reshape(-1, 2).tolist()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, intervals (word offsets removed), kept_text."""
    marks = repeats(docs, id_col, text_col, size, gram)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), null_id(id_col).alias("id"))
    joined = texts.join(marks, "id", "left").select("doc_id", "text", "marks")
    return arrow(joined, _clean(size, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, intervals array<array<long>>, kept_text string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")

"""PII (2): information-theoretic sanitisation.

Base spans are addresses and numbers by pattern (email, ip, card, phone).
Their values are the protected entities.  The corpus then tells which words
give an entity away: for an entity e and a word t that occur in the same
document, anywhere in it, with document counts over the whole corpus,

    disclosure(e, t) = PMI(e, t) / IC(e) = log2(N n_et / (n_e n_t)) / log2(N / n_e)

is 1 where t occurs with e only and at most 0 where they are independent.
Where at least MIN_DOCS documents support it, a word from REMOVE up is removed
and from GENERALISE up generalised to its kind, wherever it occurs, also in
documents that do not name the entity.  Words inside base spans go with them.

Pairs are only counted if they can reach the threshold, which is known before:
n_et is at most n_e and n_t, so n_e >= MIN_DOCS, n_t >= MIN_DOCS and n_t <= N (n_e / N) ^ threshold.  Tables of
fixed size (Levels) hold a bound of n_e or n_t for each slot of hashes and lose
no pair.  Counts are combined in each task before they move; texts never move.

Defined cases: a null text is empty; rows stay as they are, with any id, null
and repeated ones too; one document's repeated words count once; entities of
every document (N = n_e) disclose nothing.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfactor.llm import _words as W
from panelfactor.llm._spark import Bitmap, arrow, cut, documents, findable, lookup, masked

KINDS = ("email", "ip", "card", "phone")
MIN_DOCS, GENERALISE, REMOVE = 3, 0.7, 0.9
#: pairs of a slice that are held at once before they are counted
PAIRS = 1 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each `@` has one run of local characters before it, so the leftmost match starts at that run or at the last match's end."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """A chain of dotted numbers gives a match for every four of them."""
    for chain in _CHAIN.finditer(text):
        parts = chain[0].split(".")
        at = chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = "".join(_DIGITS.findall(m[0]))
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.findall(m[0])) <= 15:
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind, then start."""
    return [(k, a, b) for k, find in enumerate(FINDERS.values()) for a, b in find(text)]


def entity(kind: int, value: str) -> int:
    """The protected entity of a match: lower-cased address or bare digits, as a signed 64-bit hash; never 0."""
    plain = value.lower() if kind == 0 else value if kind == 1 else "".join(_DIGITS.findall(value))
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little", signed=True) or 1


class Levels:
    """For each slot of 64-bit hashes the least or greatest of its members' rounded log2 of a count, in 8 MB; safe to broadcast.

    A slot's value bounds the count of each of its members from below (least)
    or above (greatest); hashes of an empty slot are no members.
    """

    BITS, NONE = 23, 255

    def __init__(self, level: np.ndarray):
        self.level = level

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return self.level[(hashes.view(np.uint64) >> np.uint64(64 - self.BITS)).astype(np.int64)]

    @classmethod
    def build(cls, df: DataFrame, column: str, count: str, least: bool) -> Levels:
        level = F.floor(F.log2(count)) if least else F.ceil(F.log2(count))
        slot = F.shiftrightunsigned(F.col(column), 64 - cls.BITS).cast("int").alias("slot")
        table = df.select(slot, level.cast("short").alias("level")).groupBy("slot").agg((F.min if least else F.max)("level").alias("level")).toArrow()
        out = np.full(1 << cls.BITS, cls.NONE, np.uint8)
        out[table.column("slot").to_numpy()] = table.column("level").to_numpy()
        return cls(out)


class Slice:
    """Base spans of a slice, its words outside of them, and the distinct entities of each document."""

    def __init__(self, part: pa.RecordBatch):
        texts = [t or "" for t in part.column("text").to_pylist()]
        flat = [(d, entity(k, t[a:b]), a, b) for d, t in enumerate(texts) for k, a, b in base_spans(t)]
        table = np.array(flat, np.int64).reshape(-1, 4)
        self.doc, self.entity = _distinct(table[:, 0], table[:, 1])
        self.words = w = W.words(part.column("text"), W.ALNUM, lower=True)
        point = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])  # code points before each byte
        self.base = point[w.doc_bytes]
        self.start, self.end = point[w.start], point[w.end]
        a, b = table[:, 2] + self.base[table[:, 0]], table[:, 3] + self.base[table[:, 0]]
        taken = np.zeros(len(self.start) + 1, np.int32)  # words that a base span touches
        np.add.at(taken, np.searchsorted(self.end, a, "right"), 1)
        np.add.at(taken, np.searchsorted(self.start, b, "left"), -1)
        self.free = np.cumsum(taken[:-1]) <= 0
        self.of = np.repeat(np.arange(part.num_rows), w.counts())

    def terms(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and their distinct terms, of the words in a mask only."""
        return _distinct(self.of[keep], self.words.hash[keep].view(np.int64))


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of two arrays, in order."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity, documents) within each slice."""
    for batch in batches:
        for part in W.slices(batch, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            e, n = np.unique(np.array([x for t in texts for x in {entity(k, t[a:b]) for k, a, b in base_spans(t)}], np.int64), return_counts=True)
            yield pa.record_batch([pa.array(e), pa.array(n)], names=["entity", "n"])


def _pairs(entities, terms, total: int, threshold: float):
    """(entity, term, documents) within each slice, of the pairs that can reach the threshold."""

    def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        e, t = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.lexsort((t, e))
        e, t = e[order], t[order]
        at = np.flatnonzero(np.concatenate([[True], (e[1:] != e[:-1]) | (t[1:] != t[:-1])]))
        return pa.record_batch([pa.array(e[at]), pa.array(t[at]), pa.array(np.diff(np.append(at, len(e))))], names=["entity", "term", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                c = Slice(part)
                level = entities.value.of(c.entity)
                doc, e, level = (x[level != Levels.NONE] for x in (c.doc, c.entity, level))
                has = np.zeros(part.num_rows, bool)
                has[doc] = True
                of, term = c.terms(c.free & has[c.of])
                low = terms.value.of(term)
                of, term, low = (x[low != Levels.NONE] for x in (of, term, low))
                # log2 of the greatest n_t that e can have; a little more, for rounding
                cap = math.log2(total) * (1 - threshold) + threshold * np.minimum(level, math.log2(total)) + 1e-6
                held, size = [], 0
                for d in np.flatnonzero(has):
                    es, ts = slice(*np.searchsorted(doc, (d, d + 1))), slice(*np.searchsorted(of, (d, d + 1)))
                    step = max(1, PAIRS // max(ts.stop - ts.start, 1))
                    for k in range(es.start, es.stop, step):
                        some = slice(k, min(k + step, es.stop))
                        x, y = np.nonzero(low[ts][None, :] <= cap[some][:, None])
                        if len(x):
                            held.append((e[some][x], term[ts][y]))
                            size += len(x)
                        if size >= PAIRS:
                            yield counted(held)
                            held, size = [], 0
                if held:
                    yield counted(held)

    return work


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents) within each slice."""
    for batch in batches:
        for part in W.slices(batch, "text", 16 << 20):
            w = W.words(part.column("text"), W.ALNUM, lower=True)
            _, h = _distinct(np.repeat(np.arange(part.num_rows), w.counts()), w.hash.view(np.int64))
            term, n = np.unique(h, return_counts=True)
            yield pa.record_batch([pa.array(term), pa.array(n)], names=["term", "n"])


def disclosing(texts: DataFrame, min_docs: int = MIN_DOCS, threshold: float = GENERALISE) -> DataFrame:
    """Rows (entity, term, disclosure, n_t: documents with the term) from `threshold` up, over all of texts (a DataFrame of `text`)."""
    context, total = texts.sparkSession.sparkContext, texts.count()
    of_entity = cut(arrow(texts, _entities, "entity long, n long").groupBy("entity").agg(F.sum("n").alias("n_e")).where(f"n_e >= {min_docs} and n_e < {total}"))
    entities = context.broadcast(Levels.build(of_entity, "entity", "n_e", least=False))
    words = cut(arrow(texts, _word_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t")).where(f"n_t >= {min_docs}"))
    terms = context.broadcast(Levels.build(words, "term", "n_t", least=True))
    pairs = cut(arrow(texts, _pairs(entities, terms, max(total, 1), threshold), "entity long, term long, n long").groupBy("entity", "term").agg(F.sum("n").alias("n")).where(f"n >= {min_docs}"))
    both = cut(lookup(pairs, of_entity.withColumn("weight", F.col("n_e")), "entity", "weight", "inner"))
    both = lookup(both, words.withColumn("weight", F.col("n_t")), "term", "weight", "inner")
    size = math.log2(max(total, 1))
    ratio = (size + F.log2("n") - F.log2("n_e") - F.log2("n_t")) / (size - F.log2("n_e"))
    return both.select("entity", "term", ratio.alias("disclosure"), "n_t").where(F.col("disclosure") >= threshold)


def _spans():
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                found = [base_spans(t) for t in texts]
                count = np.array([[sum(k == kind for k, _, _ in own) for kind in range(len(KINDS))] for own in found], np.int64).reshape(-1, len(KINDS))
                named = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in own] for own in found]
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("row"), *(pa.array(count[:, k]) for k in range(len(KINDS))), pa.array(named, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "row", *(f"n_{k}" for k in KINDS), "base"],
                )

    return work


def _occurrences(shared):
    """Every place, outside base spans, of the terms in a bit array."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                c = Slice(part)
                word = np.flatnonzero(c.free & shared.value.has(c.words.hash))
                doc = c.of[word]
                yield pa.record_batch(
                    [part.column("doc_id").take(pa.array(doc)), part.column("row").take(pa.array(doc)), pa.array(c.words.hash[word].view(np.int64)), pa.array(c.start[word] - c.base[doc]), pa.array(c.end[word] - c.base[doc])],
                    names=["doc_id", "row", "term", "start", "end"],
                )

    return work


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row per row of docs: doc_id, row (hash of the text), n_email ... n_phone, base and terms (arrays of kind, start, end, ...).

    A term's action is `remove` or `generalise`: what `sanitise` does there, and the kind of its span in the query.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    base = arrow(rows, _spans(), f"doc_id long, row long, {counts}, base array<struct<kind: string, start: long, end: long>>")
    found = cut(disclosing(rows.select("text"), min_docs, generalise).groupBy("term").agg(F.max("disclosure").alias("disclosure"), F.max("n_t").alias("n_t")))
    shared = docs.sparkSession.sparkContext.broadcast(Bitmap.of(found, "term"))
    places = arrow(rows, _occurrences(shared), "doc_id long, row long, term long, start long, end long")
    places = lookup(places, found, "term", "n_t", "inner")  # hot words stay where they are
    terms = places.groupBy("doc_id", "row", "start", "end").agg(F.max("disclosure").alias("disclosure"))
    span = F.struct("start", "end", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise").alias("action"), "disclosure")
    terms = terms.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(span)).alias("terms")).withColumnsRenamed({"doc_id": "_id", "row": "_row"})
    joined = base.join(terms, (base["row"] == terms["_row"]) & base["doc_id"].eqNullSafe(terms["_id"]), "left").drop("_id", "_row")
    return joined.withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<start: long, end: long, action: string, disclosure: double>>")))


def _of(action: str):
    return lambda s: s["action"] == action


def _text(col, kind):
    return F.transform(col, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(documents(spark, sf_dir))
    base = _text("base", lambda s: s["kind"])
    # added spans too go by kind first
    terms = F.concat(*(_text(F.filter("terms", _of(kind)), lambda s: s["action"]) for kind in ("generalise", "remove")))
    return found.select(
        "doc_id",
        *(f"n_{k}" for k in KINDS),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, terms), ",").alias("spans"),
        F.size("terms").cast("long").alias("n_terms"),
        F.size(F.filter("terms", lambda s: s["action"] == "remove")).cast("long").alias("n_remove"),
        F.size(F.filter("terms", lambda s: s["action"] == "generalise")).cast("long").alias("n_generalise"),
    )


def redact(text: str, base: list[tuple[str, int, int]], terms: list[tuple[int, int, str]]) -> str:
    """The text with base spans and generalised words as `<KIND>`, removed words gone; of spans that overlap the first and longest counts."""
    spans = [(a, -b, f"<{kind.upper()}>") for kind, a, b in base]
    spans += [(a, -b, "" if action == "remove" else "<NUMBER>" if text[a:b].isdigit() else "<NAME>" if text[a : a + 1].isupper() else "<WORD>") for a, b, action in terms]
    out, done = [], 0
    for a, b, put in sorted(spans):
        if a >= done:
            out += [text[done:a], put]
            done = -b
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with their text redacted; all columns stay."""
    findable(docs.sparkSession)
    plain, (own_id, own_text) = masked(docs, id_col, text_col)
    found = find_spans(plain, own_id, own_text, **options).select("doc_id", "row", "base", "terms").dropDuplicates(["doc_id", "row"])
    joined = plain.join(found, (F.xxhash64(own_text) == F.col("row")) & F.col(own_id).cast("long").eqNullSafe(F.col("doc_id")), "left")

    @F.pandas_udf("string")
    def apply(text, base, terms):
        import pandas as pd

        return pd.Series([t if t is None else redact(t, [(s["kind"], s["start"], s["end"]) for s in b], [(s["start"], s["end"], s["action"]) for s in m]) for t, b, m in zip(text, base, terms, strict=True)])

    return joined.withColumn(own_text, apply(own_text, "base", "terms")).select(*plain.columns).toDF(*docs.columns)

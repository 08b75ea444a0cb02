"""N-gram Jaccard join (10): set-relation skipping over position-ordered lists.

A document's set is its distinct shingles of `n` words.  Two documents link
when their sets' Jaccard similarity reaches percent / 100; the result is each
document's component.

Sets are ordered by (how common a shingle is, its hash) and indexed under
their prefix only: two sets that link share a shingle among the first
size - ceil(t * size) + 1 of each, and k of them if prefixes are longer by
k - 1; sets that share fewer with sets in reach of their size are in no list.
How common a shingle is comes from counts
in slices of the input; any order gives the same links, so rare shingles
missing from that table cost nothing but time.

* Answers of similar sets.  The set with the fewest rarer shingles leads its
  list.  Every set is compared with the one leader that it resembles most by
  parity sketch; one that links and is highly similar (d times ALIKE is at most
  its size) takes it as its reference, with the exact size d of their symmetric
  difference.  That size is a metric, so what is known of
  two references r and q decides for their followers x and y: their difference
  lies within d(x) + d(y) of that of r and q.  Between components, references
  are compared once, and followers only where these bounds leave it open.
* Blocks that are skipped.  A list between components holds references, in
  blocks by size and by position of at most BLOCK rows.  A directory with the
  least and greatest sizes and the least position of each block tells which
  pairs of blocks can hold a link; only these are read, each as a unit of work
  of its own, so that a long list is spread over many tasks.  Pairs of single
  references that cannot link by sizes, positions or sketches are passed over.

All comparisons are by whole 64-bit hashes of shingles.

Equal sets are one class from the start, by a print of 64 bits; prints that two
sets with different second prints share give way to the second one, so classes
rest on 128 bits.  Null or wordless texts have no set
and stay alone.  A null doc_id sorts last.  Rows sharing a doc_id are
separate sets under one id; component_id is the least doc_id among all rows
that links reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfactor.llm import _words as W
from panelfactor.llm._spark import FLOOR, HEAVY, Bitmap, arrow, cut, documents, lookup, masked, null_id

#: shingles in the table of common ones; the rest rank as rare, by hash
COMMON = 200_000


def _sets(part: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, and n_docs + 1 offsets; each document's ascend."""
    w = W.words(part.column("text"), lower=True)
    starts, doc = W.starts_inside(w.first, n, len(w.hash))
    h = W.rolling(w.hash, n)[starts] if len(starts) else np.zeros(0, np.uint64)
    count = w.counts()
    for d in np.flatnonzero((count > 0) & (count < n)):  # the whole text is one shingle
        x = np.full(1, count[d], np.uint64)
        for v in w.hash[w.first[d] : w.first[d + 1]]:
            x = W.mix(x * np.uint64(3) + v)
        h, doc = np.append(h, x), np.append(doc, d)
    if len(doc) > 1 and (doc[1:] < doc[:-1]).any():
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    h = W.mix(h)
    _sort_each(h, np.searchsorted(doc, np.arange(part.num_rows + 1)))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(part.num_rows + 1))


def _sort_each(h: np.ndarray, off: np.ndarray) -> None:
    """Sort every document's stretch of h in place: much cheaper than one sort by two keys."""
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        h[a:b].sort()


@dataclass
class Prints:
    """Names of sets: a 64-bit print, or a second one where `shared` has the first."""

    shared: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    bits: int = 64

    def both(self, h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two prints of each set (0 for an empty one): sums over its shingles, finalised with its size."""
        size, out = np.diff(off), []
        for salt in (0xA5A5A5A5A5A5A5A5, 0x3C6EF372FE94F82B):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(h ^ np.uint64(salt)), dtype=np.uint64)])
            out.append(np.where(size > 0, W.mix(total[off[1:]] - total[off[:-1]] + size.astype(np.uint64)), 0))
        return out[0] >> np.uint64(64 - self.bits), out[1]

    def of(self, h: np.ndarray, off: np.ndarray) -> np.ndarray:
        one, two = self.both(h, off)
        return np.where(np.isin(one, self.shared), two, one)


#: words of a set's parity sketch in the lists, and at least of the one that pairs are tried by before sets move, which has a bit for each shingle
WORDS, WIDE = 2, 16
SKETCH = [f"g{k}" for k in range(WORDS)]


def _parities(h: np.ndarray, off: np.ndarray, words: int = WORDS) -> np.ndarray:
    """For each set the parity of its shingles in each of 64 * words buckets, as rows of `words` numbers.

    A shingle that only one of two sets has flips one bit, so the sketches of
    two sets differ in no more bits than the sets have different shingles.
    """
    n, bits = len(off) - 1, 64 * words
    bucket = (h >> np.uint64(20)).astype(np.int64) % bits
    doc = np.repeat(np.arange(n), np.diff(off))
    odd = (np.bincount(doc * bits + bucket, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1, bitorder="little").view("<i8").reshape(n, words)


def _wide(h: np.ndarray, off: np.ndarray) -> pa.ListArray:
    """Each set's parity sketch of WIDE words, doubled until there are as many bits as shingles.

    Two long sets that have little in common would look alike in a sketch of
    fixed size, and the pairs of long sets grow with the square of the input.
    """
    words = np.full(len(off) - 1, WIDE)
    while (short := words * 64 < np.diff(off)).any():
        words[short] *= 2
    start = np.concatenate([[0], np.cumsum(words)])
    doc = np.repeat(np.arange(len(words)), np.diff(off))
    bucket = (h >> np.uint64(20)).astype(np.int64) % (64 * words[doc])
    odd = (np.bincount(start[doc] * 64 + bucket, minlength=int(start[-1]) * 64) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(np.packbits(odd, bitorder="little").view("<i8")))


def _parts(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20):
    for batch in batches:
        yield from W.slices(batch, "text", limit)


def _classes(n: int, prints: Prints):
    def work(batches):
        for part in _parts(batches):
            h, off = _sets(part, n)
            g, wide, (one, two) = _parities(h, off), _wide(h, off), prints.both(h, off)
            yield pa.record_batch([part.column("id"), part.column("doc_id"), part.column("row"), pa.array(np.diff(off)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *(pa.array(np.ascontiguousarray(g[:, k])) for k in range(WORDS)), wide], names=["id", "doc_id", "row", "n_shingles", "one", "two", *SKETCH, "wide"])

    return work


def _counts(n: int, prints: Prints):
    """Shingles met in several different sets of a slice."""

    def work(batches):
        for part in _parts(batches, 32 << 20):
            h, off = _sets(part, n)
            _, one = np.unique(prints.of(h, off), return_index=True)
            keep = np.zeros(part.num_rows, bool)
            keep[one] = True
            value, count = np.unique(h[np.repeat(keep, np.diff(off))], return_counts=True)
            often = count > 2
            yield pa.record_batch([pa.array(value[often].view(np.int64)), pa.array(count[often])], names=["h", "n"])

    return work


#: how often sizes may grow by 100 / percent within a band
STEPS = 4


def _bands(percent: int) -> np.ndarray:
    """First sizes of bands: a set that links to a larger one has that one's band, or its `_reached` size has."""
    edges = [1]
    while edges[-1] < 1 << 60:
        up = edges[-1]
        for _ in range(STEPS):
            up = up * 100 // percent
        edges.append(max(up, edges[-1] * 3 // 2) + 1)
    return np.array(edges[:-1], np.int64)


def _reached(size: np.ndarray, percent: int) -> np.ndarray:
    """The largest size of a set that may link to one of `size`."""
    return size * 100 // percent


def _banded(token: np.ndarray, band: np.ndarray) -> np.ndarray:
    """64-bit hashes of tokens with bands; that two of them meet costs time only."""
    return W.mix(token ^ W.mix(band.astype(np.uint64) + np.uint64(1)))


#: shingles that a set needs in common with another one: 1, and one more for each MORE of those that links need
MORE = 18


def _least_shared(size: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that two linked sets share, the smaller one of this size, where prefixes are longer by all but one of them.

    A prefix of size - ceil(t * size) + k shingles leaves ceil(t * size) - k out.
    Linked sets have at least ceil(t * size) in common, of either one's size,
    and what lies in the prefix that ends first lies in both.
    """
    return 1 + (percent * size + 99) // 100 // MORE


def _prefixes(n: int, percent: int, prints: Prints, shared, met=None):
    """(key, fp) of every set's longer prefix, keys of tokens and bands.

    With `met`, a bit array, whole entries for the tokens of the prefix itself
    that have a key in it, of sets of whose longer prefix enough have.
    """
    edges = _bands(percent)

    def work(batches):
        common, rank = shared.value
        for part in _parts(batches):
            h, off = _sets(part, n)
            fp, size = prints.of(h, off), np.diff(off)
            _, one = np.unique(fp, return_index=True)  # equal sets of a slice are sent once
            keep = np.zeros(part.num_rows, bool)
            keep[one] = True
            keep &= size > 0
            g = _parities(h, off) if met is not None else None
            alike = (percent * size + 99) // 100
            length = np.where(keep, size - alike + _least_shared(size, percent), 0)
            doc = np.repeat(np.arange(part.num_rows), size)
            inside = keep[doc]
            h, doc = h[inside], doc[inside]
            at = np.searchsorted(common, h)
            at[at == len(common)] = 0
            weight = np.where(common[at] == h, rank[at], 0) if len(common) else np.zeros(len(h), np.int64)
            # a token is its weight and 57 bits of its hash: numbers in the order of the lists
            h = (weight.astype(np.uint64) << np.uint64(57)) | (h >> np.uint64(7))
            kept_size = np.where(keep, size, 0)
            _sort_each(h, np.concatenate([[0], np.cumsum(kept_size)]))
            pos = np.arange(len(h)) - np.repeat(np.cumsum(kept_size) - kept_size, kept_size)
            head = pos < length[doc]
            h, doc, pos = h[head], doc[head], pos[head]
            own, upper = (np.searchsorted(edges, x, "right")[doc] for x in (size, _reached(size, percent)))
            key, also = _banded(h, own), own != upper
            second = _banded(h[also], upper[also])
            if met is None:
                sent = np.concatenate([key, second]), np.concatenate([fp[doc], fp[doc[also]]])
                yield pa.record_batch([pa.array(x.view(np.int64)) for x in sent], names=["key", "fp"])
                continue
            head = met.value.has(key)
            head[also] |= met.value.has(second)
            enough = np.bincount(doc[head], minlength=part.num_rows) >= _least_shared(alike, percent)
            head &= enough[doc] & (pos <= (size - alike)[doc])
            h, doc, pos = h[head], doc[head], pos[head]
            columns = [pa.array(h.view(np.int64)), pa.array(fp[doc].view(np.int64)), pa.array(size[doc].astype(np.int32)), pa.array(pos.astype(np.int32)), *(pa.array(np.ascontiguousarray(g[doc, k])) for k in range(WORDS))]
            yield pa.record_batch(columns, names=["token", "fp", "size", "pos", *SKETCH])

    return work


def _members(n: int, prints: Prints, shared):
    """Whole sets of the prints in a bit array."""

    def work(batches):
        wanted = shared.value
        for part in _parts(batches):
            h, off = _sets(part, n)
            fp, size = prints.of(h, off), np.diff(off)
            _, one = np.unique(fp, return_index=True)
            keep = np.zeros(part.num_rows, bool)
            keep[one] = True
            keep &= (size > 0) & wanted.has(fp)
            tokens = h[np.repeat(keep, size)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int32)), pa.array(tokens.view(np.int64)))
            yield pa.record_batch([pa.array(fp[keep].view(np.int64)), lists], names=["fp", "tokens"])

    return work


#: links that one task may join up: 16 bytes each
FEW = 500_000


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of all links in the batches: roots are hooked to lesser ones and paths flattened until no link is open."""
    parts = [np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]) for b in batches if b.num_rows]
    if not parts:
        return
    node, at = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    x, y = at.reshape(2, -1)
    label = np.arange(len(node))
    while (label[x] != label[y]).any():
        low, new = np.minimum(label[x], label[y]), label.copy()
        for side in (x, y):
            np.minimum.at(new, label[side], low)
        while ((up := new[new]) != new).any():
            new = up
        label = new
    yield pa.record_batch([pa.array(node), pa.array(node[label])], names=["node", "label"])


def components(links: DataFrame, a: str = "a", b: str = "b", label: str = "root") -> DataFrame:
    """Connected components of the links (a, b): rows (node, label), label the least node of the component.

    Up to FEW links are joined up by one task.  Of more, each round every node
    takes the least label among its neighbours and then its label's own label,
    so that paths halve; rows stay one per node.  A round is some seven jobs,
    of each of which the driver keeps plans and classes.
    """
    pairs = cut(links.select(F.col(a).alias("x"), F.col(b).alias("y")).distinct())
    if pairs.count() <= FEW:
        return cut(arrow(pairs.coalesce(1), _joined_up, "node long, label long").withColumnRenamed("label", label))
    edges = cut(pairs.union(pairs.select("y", "x")).distinct())
    state = cut(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l"), F.count("*").alias("n")))
    while True:
        near = lookup(edges, state.withColumnRenamed("x", "y"), "y", "n", "inner").groupBy("x").agg(F.min("l").alias("m"))
        both = cut(state.join(near, "x"))
        # a node hands its new label to its old root, and then reads its root's
        up = both.where("m < l").groupBy(F.col("l").alias("x")).agg(F.min("m").alias("u"))
        low = cut(both.join(up, "x", "left").select("x", "n", F.least("l", "m", F.coalesce("u", "l")).alias("l"), (F.least("m", F.coalesce("u", "m")) < F.col("l")).alias("moved")))
        jump = low.groupBy("l").agg(F.count("*").alias("rows")).join(low.select(F.col("x").alias("l"), F.col("l").alias("ll")), "l")
        state = cut(lookup(low, cut(jump), "l", "rows").select("x", "n", F.least("l", "ll").alias("l"), (F.col("moved") | (F.coalesce("ll", "l") < F.col("l"))).alias("moved")))
        if state.where("moved").isEmpty():
            return state.select(F.col("x").alias("node"), F.col("l").alias(label))
        state = state.drop("moved")


#: a set is dealt in copies from this part of all pairs on, and this number of them
SHARE, SPLIT = 1000, 256


def _with_set(df: DataFrame, pairs: DataFrame, total: int, side: str, sets: DataFrame) -> DataFrame:
    """df, whose pairs are the `total` ones of pairs, with the set of column `side`.

    A set in more than 1 / SHARE of the pairs and more than SPLIT of them, so
    one of SHARE at most, is dealt in copies, 2 * SHARE in all at most.
    """
    most = max(total / SHARE, SPLIT)
    often = pairs.groupBy(side).agg(F.count("*").alias("n")).where(F.col("n") > most).select(side, F.ceil(F.col("n") / most).cast("int").alias("copies"))
    if often.isEmpty():
        return df.join(sets.withColumnsRenamed({"fp": side, "tokens": f"t{side}"}), side)
    often = F.broadcast(often)
    salted = df.join(often, side, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("a", "b"), F.col("copies")), F.lit(0)).cast("int")).drop("copies")
    own = pairs.select(side).distinct().join(sets.withColumnsRenamed({"fp": side, "tokens": f"t{side}"}), side)
    own = own.join(often, side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    return salted.join(own, [side, "salt"]).drop("salt")


def _overlaps(pairs: DataFrame, texts: DataFrame, n: int, prints: Prints) -> DataFrame:
    """The pairs (a, b) of prints, a materialised table, with their sets' sizes sa and sb and the size i of the intersection."""
    wanted = Bitmap.of(pairs.select(F.col("a").alias("v")).union(pairs.select(F.col("b").alias("v"))), "v")
    shared = texts.sparkSession.sparkContext.broadcast(wanted)
    sets = arrow(texts.select("text"), _members(n, prints, shared), "fp long, tokens array<long>").groupBy("fp").agg(F.first("tokens").alias("tokens"))
    both, total = pairs, pairs.count()
    for side in ("a", "b"):
        both = _with_set(both, pairs, total, side, sets)
    out = cut(both.select(*pairs.columns, F.size("ta").alias("sa"), F.size("tb").alias("sb"), F.size(F.array_intersect("ta", "tb")).alias("i")))
    shared.destroy()  # the result is written: nothing reads the bits again
    return out


def _reaches(percent: int):
    return 100 * F.col("i").cast("long") >= percent * (F.col("sa") + F.col("sb") - F.col("i"))


def _long(column: str):
    return F.col(column).cast("long")


def _can_link(percent: int):
    """Length and positional bounds for sets of sizes s1 and s2 that share a token at p1 and p2.

    The first token that two linked sets share has all their common ones at or
    after it, on either side, so every linked pair passes at that token.
    """
    s1, s2 = _long("s1"), _long("s2")
    return (100 * F.least(s1, s2) >= percent * F.greatest(s1, s2)) & ((100 + percent) * F.least(s1 - F.col("p1"), s2 - F.col("p2")) >= percent * (s1 + s2))


def _some_can_link(percent: int):
    """The same for groups of sets, of sizes from low to high and at places from p on: true if it may hold for some pair."""
    near = (100 * _long("high1") >= percent * _long("low2")) & (100 * _long("high2") >= percent * _long("low1"))
    return near & ((100 + percent) * F.least(_long("high1") - F.col("p1"), _long("high2") - F.col("p2")) >= percent * (_long("low1") + _long("low2")))


def _reach(percent: int):
    """A bound that holds at every token that two linked sets share, for single sets of sizes high* at places p*."""
    s1, s2 = _long("high1"), _long("high2")
    most = F.least("p1", "p2") + F.least(s1 - F.col("p1"), s2 - F.col("p2"))
    return (100 * F.least(s1, s2) >= percent * F.greatest(s1, s2)) & ((100 + percent) * most >= percent * (s1 + s2))


def _some_reach(percent: int):
    """The same for blocks of sets, at places from p to q: true if it may hold for some pair."""
    most = F.least("q1", "q2") + F.least(_long("high1") - F.col("p1"), _long("high2") - F.col("p2"))
    near = (100 * _long("high1") >= percent * _long("low2")) & (100 * _long("high2") >= percent * _long("low1"))
    return near & ((100 + percent) * most >= percent * (_long("low1") + _long("low2")))


def _enough_shared(percent: int):
    """Bound from all k tokens that two prefixes share, the last at places p1 and p2 of sets of sizes s1 and s2.

    Common shingles after that one lie behind the end of the prefix that ends
    first, so one side has only size - prefix length left for them.
    """
    left = [_long(f"s{k}") - F.col(f"p{k}") - 1 for k in (1, 2)]
    behind = [F.ceil(_long(f"s{k}") * percent / 100) - 1 for k in (1, 2)]
    most = F.col("k") + F.greatest(F.least(behind[0], left[1]), F.least(left[0], behind[1]))
    return (100 + percent) * most >= percent * (_long("s1") + _long("s2"))


def _bits():
    """In how many bits the sketches g* and h* differ: never more than the sets differ in shingles."""
    return sum((F.bit_count(F.col(g).bitwiseXOR(F.col(f"h{g[1:]}"))) for g in SKETCH), F.lit(0)).cast("long")


def _tried(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, sizes: their sum at most, slack: what followers may differ by) that wide sketches do not keep apart."""
    wide = [groups.select(F.col("fp").alias(side), F.col("wide").alias(f"w{side}")) for side in ("a", "b")]
    least = F.least(F.size("wa"), F.size("wb"))

    def folded(w: str):
        """The sketch in the other one's size: sizes are WIDE times powers of two, so words of one place are joined up."""
        word = f"aggregate(sequence(0, CAST(size({w}) div least(size(wa), size(wb)) AS INT) - 1), 0L, (x, j) -> x ^ element_at({w}, i + j * least(size(wa), size(wb))))"
        return F.when(F.size(w) > least, F.expr(f"transform(sequence(1, least(size(wa), size(wb))), i -> {word})")).otherwise(F.col(w))

    bits = F.aggregate(F.zip_with(folded("wa"), folded("wb"), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda n, x: n + x)
    return pairs.join(wide[0], "a").join(wide[1], "b").where(_close(bits - F.col("slack"), F.col("sizes"), percent)).select("a", "b")


def _close(difference, sizes, percent: int):
    """Whether sets whose sizes sum up to `sizes` link if they differ in `difference` shingles."""
    return (100 + percent) * difference <= (100 - percent) * sizes


#: references in a block of a list at most
BLOCK = 256
#: a set follows a reference from which it differs in at most 1 / ALIKE of its size
ALIKE = 25


def _side(df: DataFrame, k: int) -> DataFrame:
    """df with its columns but token numbered k, and the second side's sketch named h*."""
    names = {g: g if k == 1 else f"h{g[1:]}" for g in SKETCH}
    return df.toDF(*(c if c == "token" else names.get(c, f"{c}{k}") for c in df.columns))


def _block_pairs(units: DataFrame, percent: int) -> DataFrame:
    """Pairs of units of long lists, read by those pairs of blocks only that can hold a link."""
    units = cut(units.withColumn("at", F.floor(F.log2(F.col("p") + 1.0)).cast("int") * 1000 + F.floor(F.log("high") / math.log(100 / min(percent, 99))).cast("int")))
    large = units.groupBy("token", "at").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    units = lookup(units, cut(large), ["token", "at"], "n").withColumn("part", F.coalesce(F.pmod(F.xxhash64("ref"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    blocks = units.groupBy("token", "at", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("p").alias("p"), F.max("p").alias("q"), F.min("comp").alias("c"), F.max("comp").alias("d"))
    order = F.struct("at1", "part1") <= F.struct("at2", "part2")
    alone = (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2")) & (F.col("c1") == F.col("c2"))
    read = _side(blocks, 1).join(_side(blocks, 2), "token").where(order & ~alone & (_some_can_link(percent) | _some_reach(percent))).select("token", "at1", "part1", "at2", "part2")
    pairs = read.join(_side(units, 1), ["token", "at1", "part1"]).join(_side(units, 2), ["token", "at2", "part2"])
    same = (F.col("at1") == F.col("at2")) & (F.col("part1") == F.col("part2"))
    return pairs.where(~same | (F.col("ref1") < F.col("ref2"))).drop("at1", "part1", "at2", "part2")


def _open_pairs(units: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, slack, sizes) of references of different components that share a list and that no bound keeps apart.

    units: token, ref, comp, sizes low to high, least position p, greatest
    difference d from the reference, and the reference's sketch.
    """
    large = cut(units.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).withColumn("long", F.lit(True)))
    short = units
    if not large.isEmpty():
        units = lookup(units, large, "token", "n")
        short, long = units.where("long is null").drop("long"), units.where("long").drop("long")
    short = short.repartition("token")  # both sides are dealt at once
    pairs = _side(short, 1).join(_side(short, 2), "token").where(F.col("ref1") < F.col("ref2"))  # a list of one block
    if not large.isEmpty():
        pairs = pairs.unionByName(_block_pairs(long, percent))
    pairs = pairs.where(F.col("comp1") != F.col("comp2"))
    pairs = pairs.where(_close(_bits() - F.col("d1") - F.col("d2"), _long("high1") + _long("high2"), percent))
    single = F.col("d1") + F.col("d2") == 0  # no followers: sizes and places are those of the two sets
    pairs = pairs.where(F.when(single, _reach(percent)).otherwise(_some_can_link(percent)))
    # a row for every shared token of two sets, either one first
    swap = F.col("ref1") > F.col("ref2")
    pairs = pairs.select(
        F.least("ref1", "ref2").alias("a"),
        F.greatest("ref1", "ref2").alias("b"),
        *(F.when(swap, F.col(f"{c}{3 - k}")).otherwise(F.col(f"{c}{k}")).alias(f"{to}{k}") for c, to in (("high", "s"), ("p", "p")) for k in (1, 2)),
        (F.col("d1") + F.col("d2")).alias("slack"),
        _some_can_link(percent).alias("first"),
    )
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("k"), F.max("first").alias("first"), F.max("slack").alias("slack"), *(F.max(c).alias(c) for c in ("s1", "s2", "p1", "p2")))
    return pairs.where(F.col("first") & ((F.col("slack") > 0) | _enough_shared(percent))).select("a", "b", "slack", (_long("s1") + _long("s2")).alias("sizes"))


def _labels(links: DataFrame) -> DataFrame:
    return components(links).withColumnsRenamed({"node": "fp", "root": "comp"})


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id."""
    return _classed(docs, id_col, text_col, n, percent).select("doc_id", "n_shingles", "component_id")


def _led(entries: DataFrame) -> DataFrame:
    """Entries (fp, s1, p1, g*) with the leader (b, s2, p2, h*) of their list, of lists of several sets.

    A list's leader is its member with the fewest rarer shingles; ties go by
    print.  Entries are dealt by token once, for leaders and for the join; the
    lists that a task should not get whole, which only shingles of the table of
    common ones can have, stay where they are.
    """
    key = F.shiftleft(_long("pos"), 40) + F.shiftrightunsigned("fp", 24)

    def leaders(df: DataFrame) -> DataFrame:
        first = df.withColumn("key", key).groupBy("token").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), *(F.min_by(c, "key").alias(to) for c, to in (("fp", "b"), ("size", "s2"), ("pos", "p2"), *((g, f"h{g[1:]}") for g in SKETCH))))
        return first.where("low <> high").drop("low", "high")

    often = entries.where(F.shiftrightunsigned("token", 57) > 0).groupBy("token").agg(F.count("*").alias("n"))
    heavy = cut(often.where(F.col("n") > max(entries.count() / HEAVY, FLOOR)).select("token"))
    rest = [] if heavy.isEmpty() else [entries.join(F.broadcast(heavy), "token", "left_semi")]
    light = entries.join(F.broadcast(heavy), "token", "left_anti") if rest else entries
    # what the join asks for is asked for here, so that both sides are the same exchange
    light = light.where(" AND ".join(f"{c} IS NOT NULL" for c in light.columns)).repartition("token")
    out = light.join(leaders(light), "token")
    for hot in rest:
        out = out.unionByName(hot.join(F.broadcast(leaders(hot)), "token"))
    return out.withColumnsRenamed({"size": "s1", "pos": "p1"})


def _links(texts: DataFrame, groups: DataFrame, prints: Prints, n: int, percent: int) -> DataFrame:
    """Links (a, b) of prints under which sets are connected as all links connect them."""
    context = texts.sparkSession.sparkContext
    table = arrow(texts, _counts(n, prints), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    h = table.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    rank = np.minimum(np.ceil(np.log2(table.column("n").to_numpy() + 1.0) * 4), 127)  # seven bits
    shared = context.broadcast((h[order], rank.astype(np.int32)[order]))

    # tokens that several sets of like sizes have in their prefix, and the entries under them
    index = arrow(texts, _prefixes(n, percent, prints, shared), "key long, fp long")
    lists = index.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
    met = context.broadcast(Bitmap.of(lists, "key"))
    entries = cut(arrow(texts, _prefixes(n, percent, prints, shared, met), "token long, fp long, size int, pos int, " + ", ".join(f"{g} long" for g in SKETCH)))

    shared.destroy()
    met.destroy()

    pair = _led(entries).where("fp <> b").where(_can_link(percent) & _close(_bits(), _long("s1") + _long("s2"), percent))
    best = pair.withColumn("key", F.shiftleft(_bits(), 40) + F.shiftrightunsigned("b", 24)).groupBy("fp").agg(F.min_by("b", "key").alias("b"), F.min_by(_long("s1") + _long("s2"), "key").alias("sizes"))
    best = _tried(best.select(F.col("fp").alias("a"), "b", "sizes", F.lit(0).alias("slack")), groups, percent)
    found = _overlaps(cut(best), texts, n, prints).where(_reaches(percent))
    found = cut(found.select("a", "b", "sa", (F.col("sa") + F.col("sb") - 2 * F.col("i")).cast("long").alias("d")))
    links, found = found.select("a", "b"), found.where(F.col("d") * ALIKE <= F.col("sa")).drop("sa")

    # entries with their set's component and reference, and lists of references
    about = _labels(links).join(found.withColumnsRenamed({"a": "fp", "b": "ref"}), "fp", "left").withColumns({"ref": F.coalesce("ref", "fp"), "d": F.coalesce("d", F.lit(0).cast("long"))})
    about = cut(about.join(groups.select(F.col("fp").alias("ref"), *(F.col(g).alias(f"r{g}") for g in SKETCH)), "ref"))
    of_set = groups.select("fp", *SKETCH).join(about, "fp", "left")
    of_set = of_set.select("fp", F.coalesce("comp", "fp").alias("comp"), F.coalesce("ref", "fp").alias("ref"), F.coalesce("d", F.lit(0).cast("long")).alias("d"), *(F.coalesce(f"r{g}", g).alias(g) for g in SKETCH))
    named = entries.select("token", "fp", "size", "pos").join(of_set, "fp")
    # lists of one component are done with; rows of the others are in place by token, so that units take no further shuffle
    mixed = named.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token")
    units = named.join(mixed, "token").groupBy("token", "ref", "comp").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.min("pos").alias("p"), F.max("d").alias("d"), *(F.first(g).alias(g) for g in SKETCH))
    across = cut(_tried(_open_pairs(cut(units), percent), groups, percent))
    if across.isEmpty():
        return links
    across = _overlaps(across, texts, n, prints)
    links = cut(links.union(across.where(_reaches(percent)).select("a", "b")))

    # followers of references that are still apart, where their differences leave it open
    far = about.groupBy("ref").agg(F.max("d").alias("d"))
    label = _labels(links)

    def placed(df: DataFrame, side: str) -> DataFrame:
        df = df.join(far.select(F.col("ref").alias(side), F.col("d").alias(f"d{side}")), side, "left")
        return df.join(label.select(F.col("fp").alias(side), F.col("comp").alias(f"c{side}")), side, "left")

    undecided = placed(placed(across.withColumn("x", F.col("sa") + F.col("sb") - 2 * F.col("i")), "a"), "b")
    slack = F.coalesce("da", F.lit(0)) + F.coalesce("db", F.lit(0))
    apart = F.coalesce("ca", "a") != F.coalesce("cb", "b")
    # a follower is at most its difference larger than its reference
    undecided = undecided.where(apart & (slack > 0) & _close(F.col("x") - slack, F.col("sa") + F.col("sb") + slack, percent))
    undecided = cut(undecided.select("a", "b", "x"))
    if undecided.isEmpty():
        return links
    one = named.select("token", F.col("fp").alias("m1"), F.col("size").alias("s1"), F.col("pos").alias("p1"), F.col("ref").alias("a"), F.col("d").alias("d1"), *SKETCH).join(undecided, "a")
    two = named.select("token", F.col("fp").alias("m2"), F.col("size").alias("s2"), F.col("pos").alias("p2"), F.col("ref").alias("b"), F.col("d").alias("d2")).join(undecided.select("b").distinct(), "b", "left_semi")
    more = one.join(two, ["token", "b"]).where(_can_link(percent) & _close(F.col("x") - F.col("d1") - F.col("d2"), _long("s1") + _long("s2"), percent) & (F.col("d1") + F.col("d2") > 0))
    more = cut(more.select(F.col("m1").alias("a"), F.col("m2").alias("b")).distinct())
    return links.union(_overlaps(more, texts, n, prints).where(_reaches(percent)).select("a", "b"))


def _classed(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, bits: int = 64) -> DataFrame:
    """What join gives, with row (a hash of the text) and class (a print that names the component)."""
    rows = docs.select(null_id(id_col).alias("id"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    texts = rows.select("text")
    classes = cut(arrow(rows, _classes(n, Prints(bits=bits)), "id long, doc_id long, row long, n_shingles long, one long, two long, " + ", ".join(f"{g} long" for g in SKETCH) + ", wide array<long>"))
    # first prints of different sets: n * n / 2^65 of n sets
    clash = classes.groupBy("one").agg(F.min("two").alias("low"), F.max("two").alias("high")).where("low <> high").select("one").toArrow()
    prints = Prints(np.sort(clash.column("one").to_numpy().view(np.uint64)), bits)
    if clash.num_rows:
        shared = F.broadcast(classes.sparkSession.createDataFrame(clash).select(F.col("one").alias("shared")))
        classes = classes.join(shared, F.col("one") == F.col("shared"), "left").withColumn("fp", F.when(F.col("shared").isNotNull(), F.col("two")).otherwise(F.col("one")))
    else:
        classes = classes.withColumn("fp", F.col("one"))
    groups = cut(classes.where("n_shingles > 0").groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("id"), *(F.first(g).alias(g) for g in (*SKETCH, "wide"))))
    label = _labels(_links(texts, groups, prints, n, percent))

    named = cut(groups.select("fp", "n", "id").join(label, "fp", "left").select("fp", "n", "id", F.coalesce("comp", "fp").alias("class")))
    least = cut(named.groupBy("class").agg(F.min("id").alias("least"), F.count("*").alias("sets")))
    of_set = lookup(named.select("fp", "n", "class"), least, "class", "sets").select("fp", "n", "class", "least")
    out = lookup(classes.select("doc_id", "id", "row", "n_shingles", "fp"), cut(of_set), "fp", "n")
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("id"))
    return out.select("doc_id", "row", "class", "n_shingles", F.when(component != F.lit((1 << 63) - 1), component).alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One of each component: the rows of docs whose id is its least one.

    A row is judged by its own id and text, so rows that share an id (or lack
    one) do not share a fate; rows of a component that repeat its least id all
    stay.  Of a component without any id one row stays: that with the least
    hash of its text, and of rows with that same text any one.  Rows without
    words are in no component and stay.
    """
    plain, (own_id, own_text) = masked(docs, id_col, text_col)
    found = cut(_classed(plain, own_id, own_text, n, percent).where("n_shingles > 0").drop("n_shingles"))
    gone = found.where("component_id < doc_id or (doc_id is null and component_id is not null)").select("doc_id", "row")
    nameless = found.where("component_id is null")
    least = nameless.groupBy("class").agg(F.min("row").alias("least"))
    gone = gone.union(nameless.join(least, "class").where("row <> least").select("doc_id", "row")).distinct()
    kept = plain.withColumn("row", F.xxhash64(own_text)).join(gone.withColumnRenamed("row", "gone"), (F.col("row") == F.col("gone")) & F.col(own_id).cast("long").eqNullSafe(F.col("doc_id")), "left_anti")
    nameless = F.col(own_id).cast("long").isNull() & F.coalesce(F.col(own_text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return kept.where(~nameless).union(kept.where(nameless).dropDuplicates(["row"])).drop("row").toDF(*docs.columns)

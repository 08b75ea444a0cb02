"""Token files (12): ids of whole texts, Huffman coded in independent blocks.

1. Every text is encoded by the tokenizer library and ends with the id END.
   For a tokenizer that lowers case, drops white space and splits by SPLIT, a
   text's ids are those of its pieces one after the other.  Runs of letters and
   of signs in words of plain Latin text are cut and lowered over whole columns,
   and other words stay whole; the library then sees each of these once a slice,
   and up to KEPT are remembered, by 64-bit hashes.  Ids are stored as 16-bit
   numbers where the vocabulary allows it.
2. Counts of ids, combined in the tasks, give the code: lengths by package
   merge with at most LIMIT bits, so decoding is one look-up, and canonical
   codes, so the lengths alone describe it (one row, `codebook`).
3. Each piece (a document, or PIECE tokens of a longer one) becomes a bit string
   with a checkpoint, the bit offset, at every CHECK-th token.  Only these bit
   strings move: they are dealt to ranges of ids and packed in order into blocks.
4. A block is one row of `blocks`: its part and number, the tokens of the part
   before it, its tokens, and `data`.  data stands for itself: magic, number of
   pieces and checkpoint distance (3 x u32); of all pieces id (i64), row (i64),
   flags (u8; 1: the id is null, 2: one piece of several), piece (u32), tokens
   (u32), bytes (u32); the checkpoints but the first of each piece (u32); the bit
   strings, from whole bytes; CRC-32 of all before (u32).  Little endian.

Reading checks each block's sum and decodes all stretches between checkpoints
side by side: a step is one peek of LIMIT bits into the table for each stretch.
`span` decodes a part of a document from the nearest checkpoint.  A document's
place in the whole stream is what its block says, after the tokens of the parts
before, of which the driver holds one number for each part.

A null text is empty: its one token is END.  Ids that are null come first;
rows with one id keep the order in which they were read, and each has its own
ids and place.  An empty table has an empty code and no blocks.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfactor.llm import _crc, _spark
from panelfactor.llm import _words as W

END = 2
#: bits of a code, tokens between checkpoints, tokens of a piece, bytes of a block: at most
LIMIT, CHECK, PIECE, BLOCK = 20, 256, 1 << 18, 1 << 20
#: bytes of text that are cut together, strings that the library encodes together, and pieces and ids that a worker remembers, at most
SLICE, TOGETHER, KEPT, KEPT_IDS = 2 << 20, 1024, 2_000_000, 16_000_000
MAGIC = 0x31425448
TOKENS = "doc_id long, row long, piece int, several boolean, n int, ids binary"
BITS = "doc_id long, row long, piece int, several boolean, n int, bits binary, checks binary"
BLOCKS = "part int, block int, start long, n_tokens long, data binary"


# ids


# Fixed value: the pattern of tokenizers whose texts can be encoded piece by piece
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_pieces(spec: dict) -> bool:
    """Whether the tokenizer lowers case, drops white space and splits by SPLIT."""
    before, after = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = [(n.get("type"), n.get("pattern"), n.get("content")) for n in before.get("normalizers", [])]
    cuts = [(p["type"], p.get("pattern"), p.get("behavior"), p.get("invert"), p.get("add_prefix_space"), p.get("use_regex")) for p in after.get("pretokenizers", [])]
    lowered = steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
    return lowered and cuts == [("Split", {"Regex": SPLIT}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)] and not any(re.search(r"\s", t["content"]) or t["content"][0] in _SIGNS for t in spec.get("added_tokens", []))


#: signs that stand for themselves: not the apostrophe, which the pattern joins to letters, nor the bracket that begins special tokens
_SIGNS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
_LETTER, _SIGN, _OTHER = 0, 1, 2
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x61:0x7B] = _LETTER
_CLASS[list(_SIGNS.encode())] = _SIGN


class Pieces(NamedTuple):
    """Byte ranges of a column's pieces in `data`, each text's first one, and which have to be read as whole words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    whole: np.ndarray


def pieces(texts: pa.Array) -> Pieces:
    words = W.words(texts)
    data = words.data.copy()
    data[(data >= 0x41) & (data <= 0x5A)] += 32
    kind = _CLASS[data]
    # letters of two bytes, C3 80 to C3 BF but for the signs C3 97 and C3 B7; the first thirty are capitals
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    letters = (second != 0x97) & (second != 0xB7)
    kind[lead[letters]] = kind[lead[letters] + 1] = _LETTER
    capital = lead[letters & (second <= 0x9E)] + 1
    data[capital] += 32
    odd = np.append(0, np.cumsum(kind == _OTHER))
    whole = odd[words.end] > odd[words.start]
    # whole words get their own bytes back
    edge = np.zeros(len(data) + 1, np.int8)
    edge[words.start[whole]] += 1
    edge[words.end[whole]] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    data[inside] = words.data[inside]
    # cuts between letters and signs of the others
    change = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] < _OTHER) & (kind[:-1] < _OTHER) & ~inside[1:]) + 1
    marks = np.zeros((2, len(data) + 1), bool)
    marks[0, words.start] = marks[1, words.end] = True
    marks[:, change] = True
    start, end = np.flatnonzero(marks[0]), np.flatnonzero(marks[1])
    of = np.searchsorted(words.start, start, "right") - 1
    return Pieces(data, start, end, np.searchsorted(of, words.first), whole[of])


class Known:
    """Ids of pieces by the hashes of these, in sorted arrays: some 40 bytes a piece, of which KEPT are held at most."""

    def __init__(self):
        self.hash, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def missing(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes h that are not known."""
        at = np.searchsorted(self.hash, h)
        at[at == len(self.hash)] = 0
        return np.flatnonzero(self.hash[at] != h) if len(self.hash) else np.arange(len(h))

    def add(self, h: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Add the ascending hashes h, none of which is known."""
        at = np.searchsorted(self.hash, h)
        begin = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
        self.hash, self.begin, self.size = (np.insert(old, at, new) for old, new in ((self.hash, h), (self.begin, begin), (self.size, size)))
        self.ids = np.concatenate([self.ids, ids])


class Encoder:
    """The library's ids of a column of texts, as one array and the number for each text (END included)."""

    def __init__(self, spec: str, whole: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer

        own = json.loads(spec)
        self.tokenizer, self.by_pieces = Tokenizer.from_str(spec), not whole and by_pieces(own)
        # pieces are lowered and cut already
        self.plain = Tokenizer.from_str(json.dumps(own | {"normalizer": None, "added_tokens": [], "pre_tokenizer": own["pre_tokenizer"]["pretokenizers"][-1]})) if self.by_pieces else None
        self.known = Known()

    @staticmethod
    def _library(tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of each one's."""
        ids, size = array("I"), np.zeros(len(texts), np.int32)
        for k in range(0, len(texts), TOGETHER):
            made = tokenizer.encode_batch_fast(texts[k : k + TOGETHER], add_special_tokens=False)
            size[k : k + len(made)] = [len(e) for e in made]
            for e in made:
                ids.extend(e.ids)
        return np.frombuffer(ids, np.uint32) if ids else np.zeros(0, np.uint32), size

    def _learn(self, cut: Pieces, h: np.ndarray, first: np.ndarray) -> None:
        """Make the pieces with the ascending hashes h known, each of which is at one place in first."""
        new = self.known.missing(h)
        if len(self.known.hash) + len(new) > KEPT or len(self.known.ids) > KEPT_IDS:
            self.known, new = Known(), np.arange(len(h))
        data, whole = cut.data.tobytes(), cut.whole[first[new]]
        for kind, tokenizer in ((False, self.plain), (True, self.tokenizer)):
            some = new[whole == kind]
            texts = [data[a:b].decode() for a, b in zip(cut.start[first[some]].tolist(), cut.end[first[some]].tolist())]
            self.known.add(h[some], *self._library(tokenizer, texts))

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        if self.by_pieces:
            cut = pieces(texts)
            h, first, which = np.unique(W._hash(cut.data, cut.start, cut.end - cut.start), return_index=True, return_inverse=True)
            self._learn(cut, h, first)
            at = np.searchsorted(self.known.hash, h)
            flat, begin, size, per_text = self.known.ids, self.known.begin[at][which], self.known.size[at][which].astype(np.int64), cut.first
        else:
            flat, size = self._library(self.tokenizer, pc.fill_null(texts, "").to_pylist())
            size = size.astype(np.int64)
            begin, per_text = np.cumsum(size) - size, np.arange(len(size) + 1)
        done = np.cumsum(size)
        ids = flat[np.repeat(begin - (done - size), size) + np.arange(int(size.sum()))]
        stops = np.concatenate([[0], done])[per_text[1:]]
        return np.insert(ids, stops, np.uint32(end)), np.diff(stops, prepend=0) + 1


_encoders: dict[tuple[str, bool], Encoder] = {}


def _encode(shared, whole: bool, end: int, width: str, most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (shared.value, whole)
        if key not in _encoders:  # a worker keeps what it knows over its tasks
            _encoders.clear()
            _encoders[key] = Encoder(*key)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in W.slices(batch, "text", SLICE):
                ids, size = _encoders[key](part.column("text"), end)
                cells, at = [], 0
                for name, n in zip(part.column("doc_id").to_pylist(), size.tolist(), strict=True):
                    for k in range(0, n, most):
                        m = min(most, n - k)
                        cells.append((name, row, k // most, n > most, m, ids[at + k : at + k + m].astype(width).tobytes()))
                    at, row = at + n, row + 1
                yield _batch(cells, TOKENS)

    return work


_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(cells: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*cells) if cells else [[] for _ in fields]
    return pa.record_batch([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


# the code


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with `limit` bits at most; 0 where the count is 0.

    Package merge: each round pairs what the round before left, lightest first,
    and puts the pairs among the symbols; the 2n - 2 lightest of the last round,
    taken apart again, give how often each symbol counts.
    """
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.int64)
    pairs, single = np.zeros(0, np.int64), []
    for _ in range(limit):
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        single.append(np.cumsum(order < n))  # symbols among the first ones
        both = both[order]
        pairs = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * n - 2
    for symbols in reversed(single):
        own = int(symbols[take - 1]) if take else 0
        out[used[:own]] += 1
        take = 2 * (take - own)
    return out


class Book(NamedTuple):
    """A canonical code: of each id its code and length; of each `width` bits the first id in them and its length."""

    code: np.ndarray
    length: np.ndarray
    width: int
    peek_id: np.ndarray
    peek_length: np.ndarray


def book(lengths: np.ndarray) -> Book:
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    width = int(lengths.max(initial=1)) or 1
    share = np.int64(1) << (width - lengths[order].astype(np.int64))
    code = np.zeros(len(lengths), np.uint64)
    code[order] = ((np.cumsum(share) - share) // share).astype(np.uint64)
    rest = (1 << width) - int(share.sum())  # only a code of one symbol leaves bits unused
    peek_id = np.append(np.repeat(order, share), np.zeros(rest, np.int64)).astype(np.uint32)
    return Book(code, lengths.astype(np.int64), width, peek_id, lengths[peek_id].astype(np.int64) if len(lengths) else np.zeros(1 << width, np.int64))


def pack(code: np.ndarray, length: np.ndarray, at: np.ndarray, size: int) -> bytes:
    """`size` bytes with each code at bit `at`, the codes in order and apart."""
    out = np.zeros(size // 8 + 2, np.uint64)
    if len(code):
        word, room = at >> 6, 64 - (at & 63) - length
        part = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        begins = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[begins]] = np.bitwise_or.reduceat(part, begins)
        over = np.flatnonzero(room < 0)  # one for each word at most
        out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[:size]


def _few_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in parts of at most PIECE tokens."""
    for batch in batches:
        total = np.cumsum(batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PIECE, "right")))
            yield batch.slice(at, to - at)
            at = to


def _to_bits(shared, width: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        for batch in _few_tokens(batches):
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            ids = np.frombuffer(b"".join(x.as_buffer() for x in batch.column("ids")), width)
            length = code.length[ids]
            last = np.cumsum(n)
            total = np.cumsum(length)
            inside = total - length - np.repeat(np.append(0, total[last[:-1] - 1]), n)  # bits of the piece before each token
            size = (inside[last - 1] + length[last - 1] + 7) >> 3
            base = np.cumsum(size) - size
            packed = pack(code.code[ids], length, inside + np.repeat(base * 8, n), int(size.sum()))
            bits = [packed[a : a + k] for a, k in zip(base.tolist(), size.tolist())]
            checks = [inside[e - k : e : CHECK][1:].astype("<u4").tobytes() for e, k in zip(last.tolist(), n.tolist())]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "row", "piece", "several", "n")), pa.array(bits, pa.binary()), pa.array(checks, pa.binary())], names=[f.split()[0] for f in BITS.split(", ")])

    return work


# blocks


def pack_block(rows: list[tuple]) -> bytes:
    """data of a block from rows of BITS."""
    ids = np.array([r[0] or 0 for r in rows], "<i8")
    flags = np.array([(r[0] is None) + 2 * r[3] for r in rows], np.uint8)
    numbers = [np.array([r[k] for r in rows], kind) for k, kind in ((2, "<u4"), (4, "<u4"))]
    parts = [struct.pack("<III", MAGIC, len(rows), CHECK), ids, np.array([r[1] for r in rows], "<i8"), flags, *numbers, np.array([len(r[5]) for r in rows], "<u4")]
    out = b"".join([p if isinstance(p, bytes) else p.tobytes() for p in parts] + [r[6] for r in rows] + [r[5] for r in rows])
    return out + struct.pack("<I", zlib.crc32(out))


class Block(NamedTuple):
    ids: np.ndarray
    row: np.ndarray
    flags: np.ndarray
    piece: np.ndarray
    n: np.ndarray
    first: np.ndarray  # each piece's first byte in bits
    check: int
    checks: np.ndarray
    first_check: np.ndarray
    bits: memoryview


def open_block(data) -> Block:
    """The directory of a block, once its checksum is right."""
    data = memoryview(data)
    magic, count, check = struct.unpack_from("<III", data)
    if magic != MAGIC or zlib.crc32(data[:-4]) != struct.unpack_from("<I", data, len(data) - 4)[0]:
        raise ValueError("a damaged block of tokens")
    at, columns = 12, []
    for kind in ("<i8", "<i8", "u1", "<u4", "<u4", "<u4"):
        columns.append(np.frombuffer(data, kind, count, at))
        at += columns[-1].nbytes
    ids, row, flags, piece, n, size = columns
    n, size = n.astype(np.int64), size.astype(np.int64)
    more = (n - 1) // check
    checks = np.frombuffer(data, "<u4", int(more.sum()), at)
    return Block(ids, row, flags, piece, n, np.cumsum(size) - size, check, checks, np.cumsum(more) - more, data[at + checks.nbytes : -4])


def _stretches(bits, begin: np.ndarray, count: np.ndarray, code: Book) -> np.ndarray:
    """The tokens of stretches that begin at bits `begin` and have `count` tokens each, one after the other."""
    padded = bytes(bits) + bytes(8)
    words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    out = np.empty(int(count.sum()), np.uint32)
    order = np.argsort(-count, kind="stable")
    at, place, count = begin[order].astype(np.int64), (np.cumsum(count) - count)[order], count[order]
    live = np.searchsorted(-count, -np.arange(int(count.max(initial=0))), side="left")
    down = np.uint64(64 - code.width)
    for k, m in enumerate(live.tolist()):
        now = at[:m]
        peek = ((words[now >> 3].astype(np.uint64) << (now & 7).astype(np.uint64)) >> down).astype(np.int64)
        out[place[:m] + k] = code.peek_id[peek]
        at[:m] += code.peek_length[peek]
    return out


def decode(block: Block, code: Book) -> np.ndarray:
    """All tokens of a block, piece after piece."""
    lanes = -(-block.n // block.check)
    piece = np.repeat(np.arange(len(block.n)), lanes)
    k = np.arange(len(piece)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    begin = block.first[piece] * 8
    later = k > 0
    begin[later] += block.checks[block.first_check[piece[later]] + k[later] - 1]
    return _stretches(block.bits, begin, np.minimum(block.check, block.n[piece] - k * block.check), code)


def span(data, code: Book, piece: int, start: int, stop: int) -> np.ndarray:
    """Tokens start .. stop - 1 of a block's piece, read from the nearest checkpoint."""
    block = open_block(data)
    stop = min(stop, int(block.n[piece]))
    if start >= stop:
        return np.zeros(0, np.uint32)
    k = start // block.check
    begin = block.first[piece] * 8 + (int(block.checks[block.first_check[piece] + k - 1]) if k else 0)
    return _stretches(block.bits, np.array([begin]), np.array([stop - k * block.check]), code)[start - k * block.check :]


def _pack(most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start, rows, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def done():
            nonlocal block, start, rows, size
            n = sum(r[4] for r in rows)
            out = _batch([(part, block, start, n, pack_block(rows))], BLOCKS)
            block, start, rows, size = block + 1, start + n, [], 0
            return out

        for batch in batches:
            for row in zip(*(batch.column(f.split()[0]).to_pylist() for f in BITS.split(", "))):
                rows.append(row)
                size += len(row[5]) + len(row[6]) + 29
                if size >= most:
                    yield done()
        if rows:
            yield done()

    return work


# writing and reading


def write(docs: DataFrame, path: str, tokenizer: str, whole: bool = False, end: int = END, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, piece: int = PIECE, block: int = BLOCK) -> None:
    """Write the ids of docs in ascending order of id_col to path/codebook and path/blocks (Parquet).

    tokenizer is the path of a file of the library, read on the driver; with
    `whole` its texts are never cut into pieces.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    size = max(Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True), end + 1)
    width = "<u2" if size <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    _spark.arrow(rows, _encode(spark.sparkContext.broadcast(spec), whole, end, width, piece), TOKENS).write.option("compression", "zstd").parquet(f"{path}/tokens")
    tokens = spark.read.schema(TOKENS).parquet(f"{path}/tokens")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(x.as_buffer() for x in batch.column("ids")), width), minlength=size)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["id", "n"])

    table = _spark.arrow(tokens.select("ids"), count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[table.column("id").to_numpy()] = table.column("n").to_numpy()
    lengths = code_lengths(counts, limit)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")

    bits = _spark.arrow(tokens, _to_bits(spark.sparkContext.broadcast(book(lengths)), width), BITS)
    order = [F.asc_nulls_first("doc_id"), F.asc("row"), F.asc("piece")]
    _spark.arrow(bits.repartitionByRange(*order).sortWithinPartitions(*order), _pack(block), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    _spark.delete(spark, f"{path}/tokens")


def codebook(spark: SparkSession, path: str) -> Book:
    return book(np.frombuffer(spark.read.parquet(f"{path}/codebook").first().lengths, np.uint8))


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, row, piece, several, start (ids before it), n, crc (of its ids as u32), and its ids if asked for."""
    shared = spark.sparkContext.broadcast(codebook(spark, path))
    schema = "doc_id long, row long, piece int, several boolean, part int, place long, n long, crc long" + (", ids array<int>" if with_ids else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = open_block(batch.column("data")[k].as_buffer())
                tokens = decode(block, shared.value).astype("<u4")
                last, raw = np.cumsum(block.n), memoryview(tokens.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(last.tolist(), block.n.tolist())]
                cells = [
                    pa.array(block.ids, mask=block.flags & 1 == 1),
                    pa.array(block.row),
                    pa.array(block.piece.astype(np.int32)),
                    pa.array(block.flags & 2 == 2),
                    pa.array(np.full(len(block.n), batch.column("part")[k].as_py(), np.int32)),
                    pa.array(batch.column("start")[k].as_py() + last - block.n),
                    pa.array(block.n),
                    pa.array(crc, pa.int64()),
                ]
                if with_ids:
                    cells.append(pa.ListArray.from_arrays(pa.array(np.append(0, last), pa.int32()), pa.array(tokens.astype(np.int32))))
                yield pa.record_batch(cells, names=[f.split()[0] for f in schema.split(", ")])

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    before, offsets = 0, []
    for part, n in sorted(tuple(r) for r in blocks.groupBy("part").agg(F.sum("n_tokens")).collect()):  # a row for each part
        offsets.append((part, before))
        before += n
    table = F.broadcast(spark.createDataFrame(offsets, "part int, _before long"))
    pieces = _spark.arrow(blocks.select("part", "start", "data"), work, schema)
    return pieces.join(table, "part").select("doc_id", "row", "piece", "several", (F.col("_before") + F.col("place")).alias("start"), "n", "crc", *(["ids"] if with_ids else []))


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for pieces in batch.column("pieces").to_pylist():
            crc = 0
            for p in pieces:
                crc = _crc.combined(crc, p["crc"], 4 * p["n"])
            out.append(crc)
        yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(out, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens, ids_crc32."""
    pieces = read(spark, path)
    whole = pieces.where("NOT several").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    long = pieces.where("several").groupBy("doc_id", "row").agg(F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("piece", "n", "crc"))).alias("pieces"))
    return whole.unionByName(_spark.arrow(long.drop("row"), _join_pieces, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files stay in the shared folder, as the result reads them."""
    import public_tokenizers

    path = f"{_spark.shared_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write(_spark.documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return documents(spark, path)

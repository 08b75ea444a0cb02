"""Token counts (9): a byte-level BPE tokenizer compiled to transducers.

The first transducer cuts a text into pieces as the tokenizer's pattern does:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

It is deterministic over eleven character classes and eleven states.  The
look-aheads of the pattern become outputs that come late: a transition tells
whether a piece begins at its character, and whether one had begun at the
character before.  Texts are cut into chunks of CHUNK characters; every chunk's
map from each state at its start to the state at its end is computed side by
side, the maps are composed by a prefix scan, and with the start state of each
chunk known a second run gives all outputs.  One very long text thus costs no
more than many short ones.

The second transducer reads the bytes of a piece.  Its transitions carry how
the number of tokens changes: bytes that complete a longer token take back what
was emitted for its parts, so the sum along a path is the number of tokens of
the piece.  It rests on a property of byte-pair merges: a sequence of tokens is
the encoding of its text if each two neighbours encode to themselves.  So every
prefix has one last token, the longest that ends there and fits the last token
of what precedes it.  A state holds what later bytes can depend on: the suffix
that may still grow into a token, and at each of its places from which one may
grow the last token before and the difference in count.  States that agree in
this are one, so the machine is finite also over endless input; transitions are
determined from the merges when first taken, and when STATES states are
reached, also inside a piece, compilation starts again from the state at hand.  Equal pieces of a slice are read once, and
the sums of up to PATHS whole paths are kept.

The chunk maps are composed for the first transducer.  The second one reads a
piece byte by byte: its states are found while reading, so a chunk's map over
all of them cannot be known before, and pieces are short but for runs of one kind
of character, whose time is linear and whose states are bounded.

A special token in a text is one token and ends the pieces around it, the
library's default.  A null text is empty and has no tokens.  Rows stay as they
are, with any id, null and repeated ones too.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfactor.llm import _words as W
from panelfactor.llm._spark import arrow, documents

CHUNK = 256
#: states of the second transducer that are held at most (about 1 kB each)
STATES = 250_000
#: whole paths that are kept at most, and the bytes of their pieces
PATHS, KEPT = 500_000, 64

# character classes
STMD, R_V, ELL, E, LETTER, NUMBER, SPACE, BLANK, QUOTE, OTHER, END = range(11)
# states: what the current piece is so far
FRESH, LET, NUM, PUN, SP, SPS, WS, WSS, QUO, QUO_R, QUO_L = range(11)
N_STATES, N_CLASSES = 11, 11


@functools.cache
def class_table() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    # White_Space of Unicode
    for cp in [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        out[cp] = BLANK
    out[0x20], out[0x27] = SPACE, QUOTE
    for letters, kind in (("stmd", STMD), ("rv", R_V), ("l", ELL), ("e", E)):
        for c in letters:
            out[ord(c)] = kind
    return out


def _transition(state: int, kind: int) -> tuple[int, bool, bool]:
    """Next state; whether a piece began at the character before; whether one begins here."""
    letter, blank = kind <= LETTER, kind in (SPACE, BLANK)
    if kind == END:
        return FRESH, state in (QUO_R, QUO_L), True
    begun = LET if letter else {NUMBER: NUM, SPACE: SP, BLANK: WS, QUOTE: QUO, OTHER: PUN}[kind]
    joined = LET if letter else NUM if kind == NUMBER else PUN  # behind a space
    if state in (QUO_R, QUO_L):
        if kind == (E if state == QUO_R else ELL):
            return FRESH, False, False
        after, _, here = _transition(LET, kind)
        return after, True, here
    if state == QUO and letter:
        return {STMD: (FRESH, False, False), R_V: (QUO_R, False, False), ELL: (QUO_L, False, False)}.get(kind, (LET, False, True))
    if state in (SP, SPS, WS, WSS):
        if blank:
            return (SPS if kind == SPACE else WSS), False, False
        if state in (SP, SPS):
            return joined, state == SPS, False
        return begun, state == WSS, True
    if (state == LET and letter) or (state == NUM and kind == NUMBER):
        return state, False, False
    if state in (PUN, QUO) and kind in (QUOTE, OTHER):
        return PUN, False, False
    return begun, False, True


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and outputs (1: began before, 2: begins here), indexed by class * N_STATES + state."""
    step, out = np.zeros(N_CLASSES * N_STATES, np.uint8), np.zeros(N_CLASSES * N_STATES, np.uint8)
    for kind in range(N_CLASSES):
        for state in range(N_STATES):
            step[kind * N_STATES + state], before, here = _transition(state, kind)
            out[kind * N_STATES + state] = before + 2 * here
    return step, out


def piece_starts(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """For an array of classes that ends with END: whether a piece begins at each character."""
    step, out = tables()
    n = len(kinds)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, END, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T) * np.uint8(N_STATES)
    # every chunk's state map
    maps = np.broadcast_to(np.arange(N_STATES, dtype=np.uint8), (rows, N_STATES)).copy()
    for line in grid:
        maps = step[line[:, None] + maps]
    # inclusive prefix scan: maps[i] becomes the map of chunks 0 .. i
    shift = 1
    while shift < rows:
        maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift].astype(np.intp), axis=1)
        shift *= 2
    state = np.full(rows, FRESH, np.uint8)
    state[1:] = maps[:-1, FRESH]
    outputs = np.empty_like(grid)
    for k, line in enumerate(grid):
        at = line + state
        outputs[k] = out[at]
        state = step[at]
    outputs = outputs.T.reshape(-1)[:n]
    begins = outputs >= 2
    begins[:-1] |= (outputs[1:] & 1) == 1
    return begins


@functools.cache
def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in vocabulary files of this kind: itself, or the next free one from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Merges:
    """Byte-pair merges by rank, and what follows from them for tokens."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in merges}
        self.heads = {t[:n] for t in self.tokens for n in range(1, len(t))}
        self._halves = {a + b: (a, b) for a, b in reversed(merges)}
        self._edges: dict[bytes, tuple[tuple, tuple]] = {}

    def encode(self, data: bytes) -> list[bytes]:
        """The tokens of a short string, by the merges themselves: the lowest rank first, the leftmost of equals."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(pair, len(self.rank)) for pair in zip(parts, parts[1:])]
            low = min(ranks)
            if low == len(self.rank):
                break
            k = ranks.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def edges(self, token: bytes) -> tuple[tuple, tuple]:
        """What stands at the token's left and at its right end over time: (part, rank at which it merges into the next), short to long.

        Both are empty for a token that its own merges do not lead to.
        """
        known = self._edges.get(token)
        if known is None:
            sides: list[list] = [[], []]
            if self.encode(token) == [token]:
                for side in (0, 1):
                    part, until = token, len(self.rank)
                    while True:
                        sides[side].append((part, until))
                        if len(part) == 1:
                            break
                        halves = self._halves[part]
                        part, until = halves[side], self.rank[halves]
            known = self._edges[token] = (tuple(sides[0]), tuple(sides[1]))
        return known

    def fits(self, before: bytes, token: bytes) -> bool:
        """Whether `token` stays as it is after `before`; an empty `before` is the start of a piece.

        They stay apart unless a pair with a rank meets at their border while
        both of its parts are there: until either merges with what stands on
        its other side, which on the left comes first if ranks are equal.
        """
        left = self.edges(token)[0]
        if not before or not left:
            return bool(left)
        rank = self.rank.get
        for a, a_until in self.edges(before)[1]:
            for b, b_until in left:
                met = rank((a, b))
                if met is not None and met < a_until and met <= b_until:
                    return False
        return True


class State(dict):
    """A state of the second transducer: byte -> (next state, change of the number of tokens)."""

    __slots__ = ("machine", "places", "suffix")

    def __init__(self, machine: Machine, suffix: bytes, places: tuple):
        self.machine, self.suffix, self.places = machine, suffix, places

    def __missing__(self, byte: int) -> tuple[State, int]:
        self[byte] = out = self.machine.compile(self.suffix, self.places, byte)
        return out


class Machine:
    """The second transducer.

    `places` of a state are (length of the suffix from here on, last token
    before, tokens up to here less those up to the end), for each place where
    a later token may begin.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        self.states: dict[tuple, State] = {}
        self.paths: dict[bytes, int] = {}
        self.restart()

    def restart(self) -> None:
        """Forget all states: none is referred to any more but by those that a reader still holds."""
        self.states.clear()
        self.begin = State(self, b"", ((0, b"", 0),))
        self.states[self.begin.suffix, self.begin.places] = self.begin

    def state(self, suffix: bytes, places: tuple) -> State:
        key = (suffix, places)
        found = self.states.get(key)
        if found is None:
            if len(self.states) >= STATES:
                self.restart()
            found = self.states[key] = State(self, suffix, places)
        return found

    def compile(self, suffix: bytes, places: tuple, byte: int) -> tuple[State, int]:
        grown = suffix + bytes([byte])
        tokens, heads = self.merges.tokens, self.merges.heads
        for size, before, count in places:  # the longest token first
            token = grown[len(grown) - size - 1 :]
            if token in tokens and self.merges.fits(before, token):
                change = count + 1
                break
        else:
            raise ValueError("merges under which a prefix has no last token")
        live = [(size + 1, before, count - change) for size, before, count in places if grown[len(grown) - size - 1 :] in heads]
        live.append((0, token, 0))
        return self.state(grown[len(grown) - live[0][0] :], tuple(live)), change

    def __call__(self, piece: bytes) -> int:
        """The tokens of a piece; whole paths of pieces that were read before are kept."""
        total = self.paths.get(piece)
        if total is None:
            if len(self.paths) > PATHS:
                self.paths.clear()
            node, total = self.begin, 0
            for byte in piece:
                node, change = node[byte]
                total += change
            if len(piece) <= KEPT:
                self.paths[piece] = total
        return total


@functools.lru_cache(maxsize=2)
def _compiled(spec: str) -> tuple[Machine, re.Pattern | None]:
    own = json.loads(spec)
    before, model = own.get("pre_tokenizer") or {}, own["model"]
    plain = not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"))
    if model["type"] != "BPE" or not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or own.get("normalizer"):
        raise ValueError("only byte-level BPE without normaliser and prefix space can be compiled")
    byte_of = {letter: b for b, letter in byte_letters().items()}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    merges = [(bytes(byte_of[c] for c in a), bytes(byte_of[c] for c in b)) for a, b in pairs]
    special = [re.escape(t["content"]) for t in own.get("added_tokens", [])]
    return Machine(Merges(merges)), re.compile("|".join(sorted(special, key=len, reverse=True))) if special else None


def count_tokens(texts: list[str], spec: str) -> np.ndarray:
    """Tokens of each text."""
    machine, special = _compiled(spec)
    joined = "\x00".join(texts) + "\x00"
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size + 1) - 1
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kinds = class_table()[points]
    kinds[ends] = END
    extra = []
    for found in special.finditer(joined) if special else ():
        kinds[found.start() : found.end()] = END
        extra.append(found.start())
    start = np.flatnonzero(piece_starts(kinds))
    # pieces end where the next begins, or at an END, which always begins one
    at = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64)])
    offsets = np.append(at[start], at[-1])
    pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(joined.encode())]).dictionary_encode()
    each = np.fromiter(map(machine, pieces.dictionary.to_pylist()), np.int64, len(pieces.dictionary))
    counts = np.where(kinds[start] == END, 0, each[pieces.indices.to_numpy()])
    total = np.bincount(np.searchsorted(ends, start), weights=counts, minlength=len(texts)).astype(np.int64)
    if extra:
        total += np.bincount(np.searchsorted(ends, extra), minlength=len(texts))
    return total


def _count(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                texts = pc.fill_null(part.column("text"), "")
                n = count_tokens(texts.to_pylist(), shared.value)
                yield pa.record_batch([part.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    return work


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, by the tokenizer file at path `tokenizer` (read on the driver)."""
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow(rows, _count(shared), "doc_id long, n_bytes long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str, limit: int = 1024) -> DataFrame:
    import public_tokenizers

    counts = token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)

"""Secret scans (4): patterns and sliding-window entropy, in DataFrame operations.

Base spans come from patterns (assign, access, hex).  The method adds spans of
kind `entropy`: candidate strings, runs of MIN_LENGTH or more of letters, digits
and + / _ = -, in which some window of WINDOW characters has a Shannon entropy
of at least its class's threshold.  Classes are `hex` (hexadecimal digits only),
`letters` (letters and joiners only) and `mixed` (anything else).

The entropy of each window follows from the last one's by incremental counts:
a fold over the characters holds a count for each symbol, packed into a few
integers, and the sum of count * log2(count), from which the leaving
character's share is taken and to which the entering one's is added.  A step
costs the same whatever the alphabet, so a candidate's cost is its length.

Candidates of the allow-list are suppressed: words (lower-case, upper-case or
capitalised ones of three letters or more, joined or run together), plain
numbers, lower-case words and short numbers joined by single joiners, UUIDs,
and what base kinds already report.  A placeholder, or a run of the alphabet or
the digits in order, suppresses the windows that touch it only: what stands
between placeholders is judged as a candidate of its own.  No pattern repeats
a group, so none recurses on a long text.

Offsets are in code points.  Matches are placed by running sums over the gaps
and lengths of blocks of BLOCK matches, then over the blocks.  `_let` gives a
value a name inside an expression, so that it is computed once a row rather
than once a match.  Everything is an expression on one row: there is no
shuffle at all.

Defined cases: a null text is empty; rows stay as they are, with any id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfactor.llm._spark import documents

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
MIN_LENGTH, WINDOW, BLOCK = 20, 20, 128
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+"
ALPHABETS = {"hex": "0123456789abcdef", "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-", "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"}
#: bits for each character from which a window is suspect
THRESHOLDS = {"hex": 3.0, "letters": 3.8, "mixed": 3.8}
#: what is suppressed: a pattern that has to match, and one that must not
ALLOW = (
    (r"^[a-z_=/+-]+$", None),
    (r"^[A-Z_=/+-]+$", None),
    # capitalised words: no run of one or two letters but of such as `By` before another word
    (r"^[A-Za-z_=/+-]+$", r"(?<![A-Za-z])[a-z]{1,2}(?![a-z])|(?<=[A-Z])[a-z](?![a-z])(?![A-Z][a-z]{2})|(?<![A-Z])[A-Z]{2}(?![A-Z])"),
    (r"^[0-9+/_=-]+$", None),
    (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", None),
    # words and numbers of up to four digits, joined by single joiners
    (r"^[a-z0-9/_=+-]+$", r"[a-z][0-9]|[0-9][a-z]|[0-9]{5}|[/_=+-]{2}|^[/_=+-]|[/_=+-]$"),
    (r"^[0-9a-f]{24,}$", None),
    (r"^AKIA[A-Z0-9]{16,}$", None),
)
PLACEHOLDER = r"(?i)(?:abcdefgh|0123456789|123456789|example|placeholder|changeme|xxxxxxxx)"
KINDS = ("assign", "access", "hex", "entropy")
#: bits of a packed count, and counts in a 64-bit integer
BITS, PACKED = 5, 12


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for the row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern as an array of (start, end, value); null where there is none."""
    zero = F.lit(0).cast("long")
    pieces = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.split(text, pattern, -1),  # one gap before each match, and the rest of the text
        lambda value, gap: F.struct(F.length(gap).cast("long").alias("gap"), F.length(value).cast("long").alias("size"), value.alias("value")),
    )

    def append(a: Column, p: Column) -> Column:
        start = a["to"] + p["gap"]
        end = start + p["size"]
        return F.struct(F.concat(a["done"], F.array(F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value")))).alias("done"), end.alias("to"))

    def block(part: Column) -> Column:
        none = F.array().cast("array<struct<start: long, end: long, value: string>>")
        return F.aggregate(part, F.struct(none.alias("done"), zero.alias("to")), append)

    def shift(blocks: Column) -> Column:
        none = F.array().cast("array<bigint>")
        starts = F.aggregate(blocks, F.struct(none.alias("at"), zero.alias("to")), lambda a, b: F.struct(F.concat(a["at"], F.array(a["to"])).alias("at"), (a["to"] + b["to"]).alias("to")), lambda a: a["at"])
        moved = F.zip_with(blocks, starts, lambda b, by: F.transform(b["done"], lambda m: F.struct((m["start"] + by).alias("start"), (m["end"] + by).alias("end"), m["value"].alias("value"))))
        return F.flatten(moved)

    def place(rows: Column) -> Column:
        last = F.floor((F.size(rows) - 2) / BLOCK).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda b: block(F.slice(rows, b * BLOCK + 1, F.least(F.lit(BLOCK), F.size(rows) - 1 - b * BLOCK))))
        return _let(cut, shift)

    return F.when(text.rlike(pattern), _let(pieces, place))


def peak_entropy(value: Column, kind: str, window: int = WINDOW) -> Column:
    """The highest Shannon entropy of a window of `value`, in bits for each character, by incremental counts."""
    if window >= 1 << BITS:
        raise ValueError(f"a window has at most {(1 << BITS) - 1} characters")
    alphabet, words = ALPHABETS[kind], -(-len(ALPHABETS[kind]) // PACKED)
    codes = F.transform(F.split(F.lower(value) if kind == "hex" else value, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    share = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)))

    def symbol(code: Column) -> Column:
        """Where the count of a symbol is packed; a code under 0 is no symbol."""
        word = F.floor(code / PACKED).cast("int")
        return F.struct(word.alias("word"), ((code - word * PACKED) * BITS).alias("bit"))

    def count(packed: Column, s: Column) -> Column:
        return F.call_function("shiftrightunsigned", F.get(packed, s["word"]), s["bit"]).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def unit(s: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), s["bit"])

    def step(a: Column, pair: Column) -> Column:
        come, go, leaves = pair["come"], pair["go"], pair["go"]["word"] >= 0
        up = count(a["counts"], come)
        # the leaving symbol's count, with the entering one already in
        down = F.when(leaves, count(a["counts"], go) + F.when(come == go, 1).otherwise(0)).otherwise(F.lit(0))
        total = a["sum"] + F.element_at(share, up + 2) - F.element_at(share, up + 1) + F.when(leaves, F.element_at(share, down) - F.element_at(share, down + 1)).otherwise(F.lit(0.0))
        counts = F.transform(a["counts"], lambda x, k: x + F.when(k == come["word"], unit(come)).otherwise(F.lit(0).cast("long")) - F.when(k == go["word"], unit(go)).otherwise(F.lit(0).cast("long")))
        return F.struct(counts.alias("counts"), total.alias("sum"), (a["n"] + 1).alias("n"), F.when(a["n"] + 1 >= window, F.least(a["low"], total)).otherwise(a["low"]).alias("low"))

    def fold(codes: Column) -> Column:
        symbols = F.transform(codes, symbol)
        left = F.concat(F.array_repeat(symbol(F.lit(-1)), window), symbols)  # the symbol that leaves when one comes
        pairs = F.slice(F.arrays_zip(symbols.alias("come"), left.alias("go")), F.lit(1), F.size(codes))
        begin = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(window * math.log2(window)).alias("low"))
        return F.aggregate(pairs, begin, step, lambda a: F.lit(math.log2(window)) - a["low"] / window)

    return _let(codes, fold)


def allowed(value: Column) -> Column:
    """Whether the allow-list suppresses a candidate."""
    out = F.lit(False)
    for pattern, but in ALLOW:
        out = out | (value.rlike(pattern) & ~value.rlike(but) if but else value.rlike(pattern))
    return out


def suspicious(value: Column, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> Column:
    """Whether the candidate, or what it has between placeholders, is suspect."""

    def one(part: Column) -> Column:
        def high(kind: str) -> Column:
            return peak_entropy(part, kind, window) >= thresholds[kind] - 1e-9

        return F.when((F.length(part) < window) | allowed(part), False).when(part.rlike("^[0-9a-fA-F]+$"), high("hex")).when(part.rlike("^[A-Za-z+/_=-]+$"), high("letters")).otherwise(high("mixed"))

    return F.when(allowed(value), False).otherwise(F.exists(F.split(value, PLACEHOLDER, -1), one))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base and all (arrays of start, order, end, kind, value)."""
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE % MIN_LENGTH), strict=True))
    out = out.select("doc_id", *(spans(F.col("_text"), p).alias(k) for k, p in patterns.items()))
    secret = F.filter("assign", lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6)
    out = out.withColumns({"assign": secret, "entropy": F.filter("entropy", lambda s: suspicious(s["value"]))})

    def named(kind: str) -> Column:
        order = KINDS.index(kind)
        made = F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))
        return F.coalesce(made, F.array().cast("array<struct<start: long, order: int, end: long, kind: string, value: string>>"))

    out = out.withColumns({f"_{k}": named(k) for k in KINDS})
    counts = (F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS)
    base = F.array_sort(F.concat("_assign", "_access", "_hex"))
    return out.select("doc_id", *counts, base.alias("base"), F.array_sort(F.concat("_assign", "_access", "_hex", "_entropy")).alias("all"))


def _text(col: str) -> Column:
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_text("base"), 256).alias("base_sha256"), _text("all").alias("spans"), "n_entropy")

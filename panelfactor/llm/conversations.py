"""Conversation repair (11): cheapest edits that make the roles of a conversation alternate.

A well-formed conversation is empty, or has turns of user and assistant in
alternation, beginning with user and ending with assistant, after at most one
opening system turn.  Edits: Keep (0), Rerole to user or assistant (3), Delete
(4, and the only edit of a blank or repeated turn), Insert an empty turn of user
or assistant (3); a truncated turn that stays costs 3 more.

The repair is a weighted automaton: four states of the pattern, whose arcs are
the edits.  It is determinised lazily: the costs of the four states after some
turns, less their least (the offset), are one state of a deterministic
automaton; what a turn does depends on nothing else, so each pair of such a
state and a turn's kind is worked out once and kept in a transition table.
Reading a conversation is then one look-up a turn, and the offsets' sum is the
cost.  For the audit, tight arcs (those that lie on a cheapest path) are traced
back from the end, which leaves at each turn the states of cheapest paths; the
least audit follows from the front by taking the least edit letter among them.

Turns are ordered by number (nulls first), then by a hash of role and text.
Only kinds of turns, one byte each, are read by the automaton: the columns
(conversation, number, hash, kind) without texts are dealt to ranges and sorted,
so one huge conversation is spread over tasks, each of which sends the bytes of
its stretch; conversations that lie inside one task are finished there.  Texts
move once, to be hashed in order of the repaired conversation: a stream, as
SHA-256 is, in which no more than a batch is held.

Defined results: a null role or text stands as one space, and in `key` texts a
null id or number does too; rows whose conversation is null are one
conversation.  Roles count by their first letter; an empty role has none.  Equal
rows of one number are one turn and its repetitions.  A conversation without
turns has zeros and an empty audit.  An empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfactor.llm import _spark

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAR = 1 << 40  # the cost of a state that cannot be reached

# states of the pattern: nothing yet, after system, after user, after assistant
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: state -> role letter -> next state
STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: the state that an inserted or changed turn leads to, and its role
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}

# a turn's code, one byte: the place of its role letter, and bits for its first fault
LETTERS = "sua"
CUT, BLANK, AGAIN = 4, 8, 16
GONE = 8  # a code's kind is its letter and CUT, or this
_KIND = bytes(GONE if c & (BLANK | AGAIN) else c & 7 for c in range(256))
_LEGAL = np.zeros(16, bool)
_LEGAL[[0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]] = True  # su, ua, au
#: whole conversations that are kept at most, and their turns
TABLE, KEPT = 100_000, 32


def inserted(costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs after any insertions: three rounds reach every state."""
    best = list(costs)
    for _ in range(3):
        for q in range(4):
            best[NEXT[q]] = min(best[NEXT[q]], best[q] + INSERT)
    return tuple(best)


def edits(state: int, kind: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what a turn may become in a state, least letter first."""
    out = [("D", DELETE, state)]
    if kind != GONE:
        more = TRUNCATED if kind & CUT else 0
        letter = LETTERS[kind & 3 : (kind & 3) + 1]
        if letter in STEPS[state]:
            out.append(("K", KEEP + more, STEPS[state][letter]))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


class Automaton:
    """The determinised automaton as far as it was needed."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, str]] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.table: dict[int, tuple[int, int]] = {}  # state * 16 + kind -> next state, offset
        self.begin = self.state((0, FAR, FAR, FAR))[0]

    def state(self, costs: tuple[int, ...]) -> tuple[int, int]:
        """The automaton's state of costs, insertions taken in, and the offset.

        States that lose to another by more than they can gain are unreachable
        from here on, so vectors are finitely many: what follows ASSISTANT may
        also follow SYSTEM, and what follows NOTHING too but for one system
        turn, which can be deleted instead.
        """
        costs = list(inserted(costs))
        if costs[SYSTEM] > costs[ASSISTANT]:
            costs[SYSTEM] = FAR
        if costs[NOTHING] > costs[ASSISTANT] + DELETE:
            costs[NOTHING] = FAR
        least = min(costs)
        vector = tuple(FAR if c >= FAR else c - least for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], least

    def arc(self, state: int, kind: int) -> tuple[int, int]:
        found = self.table.get(state * 16 + kind)
        if found is None:
            new = [FAR] * 4
            for q, c in enumerate(self.vectors[state]):
                for _, cost, to in edits(q, kind):
                    new[to] = min(new[to], c + cost)
            found = self.table[state * 16 + kind] = self.state(tuple(new))
        return found

    def repair(self, kinds: bytes) -> tuple[int, str]:
        """Cost and audit of a conversation."""
        known = self.known.get(kinds)
        if known is None:
            known = self._repair(kinds)
            if len(kinds) <= KEPT:
                if len(self.known) > TABLE:
                    self.known.clear()
                self.known[kinds] = known
        return known

    def _repair(self, kinds: bytes) -> tuple[int, str]:
        state, cost, table = self.begin, 0, self.table
        path = np.empty(len(kinds) + 1, np.int32)
        path[0] = state
        for k, kind in enumerate(kinds, 1):
            state, offset = table.get(state * 16 + kind) or self.arc(state, kind)
            cost += offset
            path[k] = state
        last = self.vectors[state]
        cost += min(last[q] for q in ENDS)
        return cost, self._audit(kinds, path)

    def _audit(self, kinds: bytes, path: np.ndarray) -> str:
        """Back over tight arcs, then from the front by the least letter."""
        last = self.vectors[path[-1]]
        least = min(last[q] for q in ENDS)
        live = np.zeros(len(path), np.uint8)  # bit q: state q, insertions included, lies on a cheapest path
        live[-1] = self._before_insertions(last, sum(1 << q for q in ENDS if last[q] == least))
        for k in range(len(kinds) - 1, -1, -1):
            own, after, offset = self.vectors[path[k]], self.vectors[path[k + 1]], self.table[int(path[k]) * 16 + kinds[k]][1]
            mask = 0
            for q in range(4):
                if any(live[k + 1] >> to & 1 and own[q] + cost == after[to] + offset for _, cost, to in edits(q, kinds[k])):
                    mask |= 1 << q
            live[k] = self._before_insertions(own, mask)
        out, q = [], NOTHING
        for k in range(len(path)):
            own = self.vectors[path[k]]
            if k < len(kinds):
                after, offset = self.vectors[path[k + 1]], self.table[int(path[k]) * 16 + kinds[k]][1]
            while True:
                letter, to, moves = "", q, False
                if k < len(kinds):
                    for letter_, cost, to_ in edits(q, kinds[k]):
                        if live[k + 1] >> to_ & 1 and own[q] + cost == after[to_] + offset:
                            letter, to, moves = letter_, to_, True
                            break
                elif q in ENDS and own[q] == least:
                    break
                goes = NEXT[q]
                if letter != "D" and live[k] >> goes & 1 and own[q] + INSERT == own[goes]:
                    out.append("I")
                    q = goes
                    continue
                out.append(letter)
                q = to
                break
        return "".join(out)

    @staticmethod
    def _before_insertions(own: tuple[int, ...], mask: int) -> int:
        """The states from which insertions on a cheapest path lead to those of mask."""
        for _ in range(3):
            for q in range(4):
                if mask >> NEXT[q] & 1 and own[q] + INSERT == own[NEXT[q]]:
                    mask |= 1 << q
        return mask


_automaton = Automaton()


def judge(codes: bytes, turns: tuple[int | None, int | None, int]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost and audit of a conversation's codes and (least, greatest, distinct) numbers."""
    low, high, distinct = turns
    c = np.frombuffer(codes, np.uint8)
    letters = c & 3
    illegal = int((~_LEGAL[letters[:-1] * 4 + letters[1:]]).sum()) if len(c) else 0
    counts = [int((c & bit > 0).sum()) for bit in (BLANK, AGAIN, CUT)]
    return (0 if low is None else high - low + 1 - distinct, *counts, illegal, *_automaton.repair(codes.translate(_KIND)))


# rows


def damaged(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies: what the test of the operator makes of conversations, by a hash of their keys."""
    space = F.lit(" ")
    which = F.crc32(F.concat(F.coalesce(F.col("conv").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    return rows.select(
        "conv",
        "turn",
        F.when(which == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(which == 1, "").when(which == 2, F.translate(F.coalesce("text", space), ".!?", "")).otherwise(F.coalesce("text", space)).alias("text"),
        F.when(which == 0, 0).when(which == 3, 2).otherwise(1).alias("copies"),
    )


_SPACES = " \t\n\x0b\f\r"


def _hash() -> Column:
    """128 bits of role and text."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))


def _code() -> Column:
    letter = F.when(F.col("role") == "", 3).otherwise((F.instr(F.lit(LETTERS), F.substring("role", 1, 1)) + 3) % 4)
    last = F.right(F.rtrim("text", F.lit(_SPACES)), F.lit(1))
    return (letter + F.when(last == "", BLANK).when(last.isin(".", "!", "?"), 0).otherwise(CUT)).cast("int")


def turns(rows: DataFrame) -> DataFrame:
    """conv, turn, h, code, n, first: a row for each different turn of a number, without texts; n of them there, the first of its text or not."""
    groups = rows.select("conv", "turn", _hash().alias("h"), _code().alias("code"), "copies").groupBy("conv", "turn", "h").agg(F.max("code").alias("code"), F.sum("copies").alias("n"))
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    # texts under several numbers: the least one stays the first
    again = groups.where("n > 0").groupBy("conv", "h").agg(F.count("*").alias("k"), F.min(place)["turn"].alias("least")).where("k > 1").select(F.col("conv").alias("_conv"), F.col("h").alias("_h"), "least", "k")
    joined = groups.join(again, groups.conv.eqNullSafe(F.col("_conv")) & (groups.h == F.col("_h")), "left")
    return joined.select("conv", "turn", "h", "code", "n", (F.col("k").isNull() | F.col("turn").eqNullSafe(F.col("least"))).alias("first"))


_STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_OPEN = "part int, codes binary, low long, high long, n_turns long"


def _merged(a: tuple, b: tuple) -> tuple:
    """(codes, low, high, distinct) of two stretches of a conversation, one behind the other."""
    if b[1] is None or a[1] is None:
        kept = a if b[1] is None else b
        return (a[0] + b[0], *kept[1:])
    return a[0] + b[0], a[1], b[2], a[3] + b[3] - (a[2] == b[1])


def _stretches(batch: pa.RecordBatch) -> list[tuple]:
    """(conversation, (codes, low, high, distinct)) of each run of rows of one conversation."""
    runs = pc.run_end_encode(batch.column("conv"))
    ends = runs.run_ends.to_numpy().astype(np.int64)
    n = batch.column("n").to_numpy(zero_copy_only=False)
    code = batch.column("code").to_numpy(zero_copy_only=False).astype(np.uint8)
    repeated = np.where(code & BLANK, code, (code & 3) | AGAIN).astype(np.uint8)  # blank comes before duplicate
    stop = np.cumsum(n)
    codes = np.repeat(repeated, n)
    own = batch.column("first").to_numpy(zero_copy_only=False) & (n > 0)
    codes[(stop - n)[own]] = code[own]
    run = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    there = batch.column("turn").is_valid().to_numpy(zero_copy_only=False) & (n > 0)
    number, of = batch.column("turn").fill_null(0).to_numpy(zero_copy_only=False)[there], run[there]
    new = np.ones(len(of), bool)
    new[1:] = (number[1:] != number[:-1]) | (of[1:] != of[:-1])
    distinct = np.bincount(of[new], minlength=len(ends)).tolist()
    a, b = np.searchsorted(of, np.arange(len(ends)), "left").tolist(), np.searchsorted(of, np.arange(len(ends)), "right").tolist()
    at = np.concatenate([[0], stop[ends - 1]]).tolist()
    raw = codes.tobytes()
    return [(conv, (raw[at[k] : at[k + 1]], *((int(number[a[k]]), int(number[b[k] - 1])) if b[k] > a[k] else (None, None)), distinct[k])) for k, conv in enumerate(runs.values.to_pylist())]


def _read(conv_type: pa.DataType):
    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = [conv_type, *[pa.int64()] * 6, pa.string(), pa.int32(), pa.binary(), *[pa.int64()] * 3]
        names = ["conv", *(f.split()[0] for f in (_STATS + ", " + _OPEN).split(", "))]
        return pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out), kinds, strict=True)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            found = _stretches(batch)
            if held is not None and held[0] == found[0][0]:
                found[0] = (held[0], _merged(held[1], found[0][1]))
            elif held is not None:
                found.insert(0, held)
            held, out = found.pop(), []
            for conv, (codes, *numbers) in found:
                # a task's first and last conversations may go on in other tasks
                out.append((conv, *[None] * 7, part, codes, *numbers) if first else (conv, *judge(codes, numbers), *[None] * 5))
                first = False
            if out:
                yield rows_of(out)
        if held is not None:
            yield rows_of([(held[0], *[None] * 7, part, *held[1])])

    return work


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for parts in batch.column("parts").to_pylist():
            own = [(p["codes"], p["low"], p["high"], p["n_turns"]) for p in parts]
            whole = own[0]
            if len(own) > 1:
                numbers = (b"", *whole[1:])
                for p in own[1:]:
                    numbers = _merged(numbers, (b"", *p[1:]))
                whole = (b"".join(p[0] for p in own), *numbers[1:])
            out.append(judge(whole[0], whole[1:]))
        names = [f.split()[0] for f in _STATS.split(", ")]
        columns = zip(*out) if out else [[] for _ in names]
        kinds = [*[pa.int64()] * 6, pa.string()]
        yield pa.record_batch([batch.column("conv"), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], names=["conv", *names])


def repairs(rows: DataFrame) -> DataFrame:
    """Of each conversation of rows (conv, turn, role, text, copies): conv, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    kind = rows.schema["conv"].dataType.simpleString()
    light = _spark.cut(turns(rows))
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("h")]
    dealt = light.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "code", "n", "first")
    arrow_type = pa.from_numpy_dtype(np.int64) if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    read = _spark.cut(_spark.arrow(dealt, _read(arrow_type), f"conv {kind}, {_STATS}, {_OPEN}"))
    names = ["conv", *(f.split()[0] for f in _STATS.split(", "))]
    parts = F.sort_array(F.collect_list(F.struct(*(f.split()[0] for f in _OPEN.split(", "))))).alias("parts")  # one for each task at most
    ends = _spark.arrow(read.where("part IS NOT NULL").groupBy("conv").agg(parts), _finish, f"conv {kind}, {_STATS}")
    return read.where("part IS NULL").select(*names).unionByName(ends)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each conversation's row of results, then its turns in order: the results and the repaired text's hash."""
    results, done, audit, at, state, digest, lines = None, [], "", 0, NOTHING, None, 0
    schema: pa.Schema | None = None

    def line(role: str, text: str) -> None:
        nonlocal lines
        digest.update(f"\n{role}:{text}".encode() if lines else f"{role}:{text}".encode())
        lines += 1

    def insert() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state, at = NEXT[state], at + 1
            line(ROLE[state], "")

    for batch in batches:
        for row in batch.to_pylist():
            if row["audit"] is not None:
                if results is not None:
                    insert()
                    done.append((*results, digest.hexdigest()))
                results = [row[k] for k in names_of(batch)]
                audit, at, state, digest, lines = row["audit"], 0, NOTHING, hashlib.sha256(), 0
                continue
            for _ in range(row["copies"]):
                insert()
                letter, at = audit[at], at + 1
                if letter == "K":
                    state = STEPS[state][row["role"][:1]]
                    line(row["role"], row["text"])
                elif letter == "R":
                    state = NEXT[state]
                    line(ROLE[state], row["text"])
        schema = pa.schema([*(batch.schema.field(k) for k in names_of(batch)), pa.field("repaired_sha256", pa.string())])
        if done:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done), schema, strict=True)], schema=schema)
            done = []
    if results is not None:
        insert()
        yield pa.record_batch([pa.array([c], f.type) for c, f in zip((*results, digest.hexdigest()), schema, strict=True)], schema=schema)


def names_of(batch: pa.RecordBatch) -> list[str]:
    return ["conv", *(f.split()[0] for f in _STATS.split(", "))]


def repair(rows: DataFrame) -> DataFrame:
    """repairs() with repaired_sha256: of the repaired conversation's `role:text` lines."""
    kind = rows.schema["conv"].dataType.simpleString()
    names = [f.split()[0] for f in _STATS.split(", ")]
    results = repairs(rows).select("conv", *names, *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("h", "binary"), ("role", "string"), ("text", "string"), ("copies", "int"))))
    texts = rows.where("copies > 0").select("conv", *(F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in _STATS.split(", ")), "turn", _hash().alias("h"), "role", "text", "copies")
    both = results.unionByName(texts).repartition("conv")
    order = [F.asc_nulls_first("conv"), F.col("audit").isNull().asc(), F.asc_nulls_first("turn"), F.asc("h")]
    return _spark.arrow(both.sortWithinPartitions(*order).drop("h"), _repaired, f"conv {kind}, {_STATS}, repaired_sha256 string")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("conv"), F.col("turn").cast("long"), "role", "text")
    return repair(damaged(rows)).withColumnRenamed("conv", "conv_id")


#: the same in DuckDB SQL: the cheapest and then least audit of each state, turn by turn
SQL = r"""
WITH RECURSIVE bits AS (SELECT b, b AS s, 0 AS k FROM range(256) AS t(b) UNION ALL SELECT b, CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(s ORDER BY b) AS t FROM bits WHERE k = 8),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS x FROM conversations),
which AS (SELECT *, xor(list_reduce(list_transform(range(0, len(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS w FROM keyed, tab),
rows AS (SELECT conv_id, turn, CASE w WHEN 4 THEN 'user' ELSE role END AS role, CASE w WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, c
         FROM which, unnest(CASE w WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS t(c)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, c) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM rows),
marked AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
                  left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
                  count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM marked GROUP BY conv_id),
-- states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant
steps(q, r, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
turned(q, q2) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
inserts(q, q2, letters, more) AS (VALUES (0, 0, '', []), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']), (2, 3, 'I', ['assistant:']), (3, 2, 'I', ['user:'])),
arcs AS (SELECT m.conv_id, m.i, q, q2, 'K' AS letter, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS cost, [role || ':' || text] AS line FROM marked m JOIN steps USING (r) WHERE fault IN ('', 't')
         UNION ALL SELECT conv_id, i, q, q2, 'R', CASE WHEN fault = 't' THEN 6 ELSE 3 END, [CASE q2 WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] FROM marked, turned WHERE fault IN ('', 't')
         UNION ALL SELECT conv_id, i, q, q, 'D', 4, [] FROM marked, unnest([0, 1, 2, 3]) AS t(q)),
best AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM counts
         UNION ALL
         SELECT b.conv_id, b.i + 1, a.q2, b.cost + 3 * length(n.letters) + a.cost, b.audit || n.letters || a.letter, list_concat(list_concat(b.lines, n.more), a.line)
         FROM best b JOIN inserts n ON b.q = n.q JOIN arcs a ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND a.i = b.i + 1 AND a.q = n.q2
         QUALIFY row_number() OVER (PARTITION BY b.conv_id, b.i, a.q2 ORDER BY b.cost + 3 * length(n.letters) + a.cost, b.audit || n.letters || a.letter) = 1),
ends AS (SELECT b.conv_id, b.cost + 3 * length(letters) AS cost, b.audit || letters AS audit, list_concat(lines, more) AS lines FROM best b JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = c.n JOIN inserts n ON b.q = n.q AND n.q2 IN (0, 3)
         QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + 3 * length(letters), b.audit || letters) = 1)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN counts c ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON k.conv_id IS NOT DISTINCT FROM e.conv_id"""

"""Operators 11, 12 and 13."""

import hashlib
import heapq
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from panelfactor.llm import _crc, conversations, resampling, token_files
from tests.llm import brute

# checksums


def test_checksums_of_ranges():
    rng = np.random.default_rng(1)
    data = np.frombuffer(rng.bytes(5000), np.uint8)
    start = np.sort(rng.integers(0, 4000, 80))
    end = start + np.concatenate([rng.integers(0, 12, 40), rng.integers(60, 900, 40)])
    assert (_crc.checksum(_crc.registers(data, start, end), end - start) == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end)]).all()
    for n in (0, 1, 64, 65, 1000):
        a, b = rng.bytes(17), rng.bytes(n)
        assert _crc.combined(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


# conversations


def cheapest(kinds):
    """Cost and least audit by a shortest path over (place, state) with the audit as the second cost."""
    best, todo = {}, [(0, "", 0, 0)]
    while todo:
        cost, audit, k, q = heapq.heappop(todo)
        if (k, q) in best:
            continue
        best[k, q] = cost, audit
        heapq.heappush(todo, (cost + 3, audit + "I", k, conversations.NEXT[q]))
        if k < len(kinds):
            letter, cut = ("sua"[kinds[k] & 3 : (kinds[k] & 3) + 1], 3 * bool(kinds[k] & 4)) if kinds[k] != 8 else ("-", None)
            heapq.heappush(todo, (cost + 4, audit + "D", k + 1, q))
            if cut is not None:
                heapq.heappush(todo, (cost + 3 + cut, audit + "R", k + 1, conversations.NEXT[q]))
                if letter in conversations.STEPS[q]:
                    heapq.heappush(todo, (cost + cut, audit + "K", k + 1, conversations.STEPS[q][letter]))
    return min(best[len(kinds), q] for q in (0, 3))


KINDS = (0, 1, 2, 3, 4, 5, 6, 7, 8)


def test_every_short_conversation():
    own = conversations.Automaton()
    for n in range(5):
        for kinds in itertools.product(KINDS, repeat=n):
            assert own.repair(bytes(kinds)) == cheapest(kinds), kinds
    assert len(own.vectors) < 100


def test_long_conversations_need_no_more_states():
    rng, own = random.Random(2), conversations.Automaton()
    for n in (30, 200, 900):
        kinds = bytes(rng.choice(KINDS) for _ in range(n))
        assert own.repair(kinds) == cheapest(kinds)
    own.repair(bytes(rng.choice((0, 8)) for _ in range(50_000)))
    assert len(own.vectors) < 100


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        w = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if w:
            out += [(conv, turn, "user" if w == 4 else role, "" if w == 1 else text.translate({ord(c): None for c in ".!?"}) if w == 2 else text)] * (2 if w == 3 else 1)
    return out


def repaired(rows):
    """conv -> the contract's columns, in plain Python."""
    out = {}
    after = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        seen, kinds, faults = set(), [], Counter()
        for _, _, role, text in own:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            at = "sua".find(role[:1]) if role else -1
            kinds.append(8 if fault in ("blank", "duplicate") else (at if at >= 0 else 3) + 4 * (fault == "truncated"))
        numbers = [r[1] for r in own if r[1] is not None]
        initials = [r[2][:1] for r in own]
        cost, audit = cheapest(kinds)
        lines, q, rest = [], 0, list(own)
        for letter in audit:
            role, text = (None, "") if letter == "I" else rest.pop(0)[2:]
            if letter == "D":
                continue
            q = conversations.STEPS[q][role[0]] if letter == "K" else conversations.NEXT[q]
            lines.append(f"{role if letter == 'K' else conversations.ROLE[q]}:{text}")
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, brute.sha("\n".join(lines)))
    return out


@pytest.fixture(scope="module")
def talk():
    rng, rows = random.Random(3), []
    for conv in [*range(150), None]:
        for t in rng.sample([*range(12), None], rng.randint(0, 9)):
            rows.append((conv, t, rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice([f"x{t}.", f"y{t} ok!\n", f"z{t}", "", None, "same.", "  \t"])))
    rows += [(1000, t, rng.choice(["user", "assistant", "assistant", "system"]), f"line {t % 900}{rng.choice(['.', ''])}") for t in range(2000)]
    return rows


SCHEMA = "conv long, turn long, role string, text string, h int, audit string"


def test_conversations_against_brute_force(spark, talk):
    rows = spark.createDataFrame([(*r, 1, "x") for r in talk], SCHEMA).repartition(6)
    out = conversations.repair(conversations.damaged(rows)).collect()
    assert {r.conv: tuple(r)[1:] for r in out} == repaired(talk) and len(out) == len({r[0] for r in talk})


def test_one_conversation_over_many_tasks(spark, talk):
    """The long one's rows lie in several ranges; all of equal rows of a number are one turn and its repetitions."""
    rows = spark.createDataFrame([(*r, 1, "x") for r in talk if r[0] == 1000] + [(1001, 5, "user", "same.", 1, "x")] * 40, SCHEMA)
    light = conversations.turns(rows.withColumn("copies", F.lit(1)))
    assert light.where("conv = 1001").select("n", "first").collect() == [(40, True)]
    out = {r.conv: r for r in conversations.repair(rows.withColumn("copies", F.lit(1))).collect()}
    assert out[1001].duplicate == 39 and out[1001].audit == "K" + "D" * 39 + "I" and out[1001].illegal == 39
    assert out[1000].repaired_sha256 == conversations.repair(rows.withColumn("copies", F.lit(1)).coalesce(1)).where("conv = 1000").first().repaired_sha256


def test_no_conversations(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(conversations.damaged(rows)).count() == 0


# token files


def test_lengths_are_optimal_and_bounded():
    def free(counts):
        heap = [(c, i, [i]) for i, c in enumerate(counts) if c]
        heapq.heapify(heap)
        size, k = [0] * len(counts), len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in a[2] + b[2]:
                size[i] += 1
            heapq.heappush(heap, (a[0] + b[0], k, a[2] + b[2]))
            k += 1
        return np.array(size)

    rng = np.random.default_rng(5)
    for n in (2, 3, 17, 300):
        counts = rng.integers(0, 1000, n) + (rng.random(n) < 0.5)
        counts[:2] += 1
        assert (token_files.code_lengths(counts).astype(int) * counts).sum() == (free(counts) * counts).sum()
    bounded = token_files.code_lengths(np.array([2**k for k in range(40)]), 7)
    assert bounded.max() == 7 and sum(2.0 ** -int(x) for x in bounded) == 1
    # the best of all complete codes of 3 bits, by trial
    counts = np.array([50, 20, 3, 2, 1])
    trial = min(sum(c * x for c, x in zip(counts, s)) for s in itertools.product((1, 2, 3), repeat=5) if sum(2.0**-x for x in s) <= 1)
    assert (token_files.code_lengths(counts, 3).astype(int) * counts).sum() == trial
    assert token_files.code_lengths(np.array([0, 0, 9])).tolist() == [0, 0, 1] and not token_files.code_lengths(np.zeros(4, int)).any()
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(9, int), 3)


def test_codes_are_canonical():
    book = token_files.book(np.array([2, 0, 1, 3, 3], np.uint8))
    assert [format(int(book.code[i]), f"0{book.length[i]}b") for i in (2, 0, 3, 4)] == ["0", "10", "110", "111"]


@pytest.fixture
def written(spark, docs, tmp_path):
    path = f"file://{tmp_path}/files"
    token_files.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), piece=500, block=3000)
    return path


def library(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [e.ids + [2] for e in own.encode_batch(texts, add_special_tokens=False)]


def test_files_hold_what_the_library_gives(spark, written, corpus):
    out = token_files.documents(spark, written).collect()
    rows = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = library([r[1] or "" for r in rows])
    total, want = 0, Counter()
    for r, own in zip(rows, ids):
        want[r[0], total, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
        total += len(own)
    # repeated rows are equal, so each place has its row
    assert Counter(tuple(r) for r in out) == want
    assert spark.read.parquet(f"{written}/blocks").count() > 10
    pieces = token_files.read(spark, written, with_ids=True).where("doc_id = 128").orderBy("piece").collect()
    assert len(pieces) > 1 and sum((p.ids for p in pieces), []) == next(own for r, own in zip(rows, ids) if r[0] == 128)


def test_spans_begin_at_checkpoints(spark, written):
    row = spark.read.parquet(f"{written}/blocks").orderBy(F.desc("n_tokens")).first()
    code, block = token_files.codebook(spark, written), token_files.open_block(bytes(row.data))
    tokens = token_files.decode(block, code)
    piece = int(block.n.argmax())
    own = tokens[block.n[:piece].sum() :][: block.n[piece]]
    assert len(own) > token_files.CHECK
    for a, b in ((0, 5), (250, 260), (256, 257), (300, 10_000), (9, 9)):
        assert token_files.span(bytes(row.data), code, piece, a, b).tolist() == own[a:b].tolist()
    damaged_block = bytearray(row.data)
    damaged_block[-9] ^= 1
    with pytest.raises(ValueError):
        token_files.open_block(bytes(damaged_block))


def test_whole_texts_and_words_give_the_same(spark, docs, tmp_path):
    odd = spark.createDataFrame([(1, "Ünïcodé Å Σίσυφοσ ΟΔΟΣ \x85x y z 'S I'LL don't <|endoftext|> <|startoftext|>x 12345\t\v\f\r\nq\x1fw"), (2, "́a  ̈b")], "doc_id long, text string")
    both = odd.unionByName(docs.select("doc_id", "text"))
    got = []
    for whole in (True, False):
        path = f"file://{tmp_path}/{whole}"
        token_files.write(both, path, public_tokenizers.path("word_bpe_49k.json"), whole=whole)
        got.append(Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.documents(spark, path).collect()))
    assert got[0] == got[1]


def test_no_documents(spark, nothing, tmp_path):
    token_files.write(nothing, f"file://{tmp_path}/none", public_tokenizers.path("word_bpe_49k.json"))
    assert token_files.documents(spark, f"file://{tmp_path}/none").count() == 0


# resampling


def features(text):
    w = brute.ALNUM.findall((text or "").translate(brute.LOWER))
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1))


def resampled(rows, target):
    have, want, own = Counter(), Counter(), []
    for i, text in rows:
        n, c = features(text)
        have.update(c)
        own.append((i, n, c))
    for text in target:
        want.update(features(text)[1])
    s, t = sum(have.values()), sum(want.values())
    gain = [math.floor(1000 * math.log(((want[k] + 1) * (s + 10_000)) / ((have[k] + 1) * (t + 10_000)))) for k in range(10_000)]
    out = []
    for i, n, c in own:
        w = sum(gain[k] * v for k, v in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, sum(c.values()), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


TARGET = ["abc def one two three", "Subscribe to our newsletter", None, "la la la"]


def test_blocks_of_any_size_give_the_same(spark, docs, tmp_path):
    gain = np.arange(10_000) * 7 - 35_000
    got = []
    for k, n in enumerate((4096, 7)):
        blocks = resampling.matrix(docs, f"file://{tmp_path}/{k}", block_rows=n)
        got.append((Counter(map(tuple, resampling.weights(blocks, gain).collect())), resampling.column_sums(blocks).tolist(), blocks.count()))
    assert got[0][:2] == got[1][:2] and got[1][2] > got[0][2]


def test_matrix_is_written_in_small_row_groups(spark, tmp_path):
    # readers unpack a row group's blocks together: a task's blocks must not be one
    words = "concat_ws(' ', transform(sequence(1, 4000), k -> substr(md5(concat(id, ':', k)), 1, 8)))"
    docs = spark.range(0, 600, 1, 1).selectExpr("id AS doc_id", f"{words} AS text")
    resampling.matrix(docs, f"file://{tmp_path}/wide")
    groups = [m.row_group(k) for f in tmp_path.glob("wide/*.parquet") for m in [pq.ParquetFile(f).metadata] for k in range(m.num_row_groups)]
    assert sum(g.total_byte_size for g in groups) > 24e6 > max(g.total_byte_size for g in groups)


def test_resampling_against_brute_force(spark, docs, corpus):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    out = resampling.resample(docs, target, percent=30).collect()
    want = resampled([(r[0], r[1]) for r in corpus], TARGET)
    assert Counter(tuple(r)[:5] for r in out) == Counter(want)
    able = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], 1 << 63 if r[0] is None else r[0]))
    drawn = sorted((r for r in out if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 30 * len(able) // 100 + 1))
    assert [tuple(r)[:5] for r in drawn] == able[: len(drawn)]


def test_ranks_with_one_score(spark):
    """Ties go to smaller ids, also where the quantile bounds nothing."""
    rows = spark.createDataFrame([(k, 20, 1, 0, 7) for k in range(500)] + [(None, 30, 1, 0, 7), (1000, 19, 1, 0, 99)], "id long, n_words long, n_features long, weight long, score long").repartition(4)
    out = resampling.drawn(rows, percent=10).where("rank IS NOT NULL").orderBy("rank").collect()
    assert [(r.id, r["rank"]) for r in out] == [(k, k + 1) for k in range(50)]
    assert resampling.drawn(rows).count() == 502


def test_nothing_to_resample(spark, docs, nothing):
    assert resampling.resample(nothing, nothing).count() == 0
    out = resampling.resample(docs.limit(5), nothing).collect()
    assert len(out) == 5 and all(r["rank"] is None for r in out)


def test_pieces_are_encoded_once(monkeypatch):
    """op12: a worker's memory holds the pieces of a large vocabulary; where it is too small, it forgets and is right still."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    encoder, asked, library = token_files.Encoder(spec), [], token_files.Encoder._library
    monkeypatch.setattr(token_files.Encoder, "_library", staticmethod(lambda tokenizer, texts: asked.append(len(texts)) or library(tokenizer, texts)))
    words = ["".join(chr(97 + k // 26**j % 26) for j in range(4)) for k in range(420_000)]
    for at in (*range(0, len(words), 70_000), 0):
        before = sum(asked)
        encoder(pa.array([" ".join(words[at : at + 70_000])]), 2)
    assert sum(asked) == before == len(words)

    texts = pa.array(["Some words, ÀÉ and naïve ones: don't 12x", None, "", "some OTHER words Ⅷ and <s> signs", "Some words, again"] * 3)
    want = token_files.Encoder(spec, whole=True)(texts, 2)
    monkeypatch.setattr(token_files, "KEPT", 4)
    small = token_files.Encoder(spec)
    for _ in range(2):
        for part in (texts, texts[:1], texts[3:4]):
            ids, n = small(part, 2)
            at = 3 if len(part) == 1 and part[0] == texts[3] else 0
            start = int(want[1][:at].sum())
            assert n.tolist() == want[1][at : at + len(part)].tolist() and ids.tolist() == want[0][start : start + int(n.sum())].tolist()

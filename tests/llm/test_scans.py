"""Operators 2, 3, 4 and 9."""

import hashlib
import random
import string
import struct
import time
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelfactor.llm import media_ogg, pii, secret_scan, token_counts
from tests.llm import brute

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def key(r):
    return tuple((x is None, str(x)) for x in r)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


# 2


def test_base_spans(docs, corpus):
    out = pii.find_spans(docs).collect()
    want = []
    for r in corpus:
        spans = brute.pii(r[1])
        want.append((r[0], *(sum(k == s[0] for s in spans) for k in pii.KINDS), brute.spans_text(spans)))
    same([(r.doc_id, *(r[f"n_{k}"] for k in pii.KINDS), brute.spans_text([(s.kind, s.start, s.end) for s in r.base])) for r in out], want)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@12567890- +().%_é", max_size=70))
def test_base_spans_of_any_text(text):
    assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == brute.pii(text)


def test_long_runs_cost_little_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1" + "(" * 200_000, "1 " * 150_000):
        pii.base_spans(text)


def test_disclosing_words(spark):
    rng = random.Random(1)
    words = [f"word{k}" for k in range(50)]
    rows = []
    for k in range(200):
        text = [rng.choice(words) for _ in range(30)]
        if k % 20 == 0:  # one address that always has a rare word beside it, and a common one
            text[10:13] = ["Zorblax", "jo@corp.example", "word1"]
        rows.append((k, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = pii.find_spans(df).where("size(terms) > 0").collect()
    assert {r.doc_id for r in found} == set(range(0, 200, 20))
    by_id = dict(rows)
    assert {by_id[r.doc_id][t.start : t.end] for r in found for t in r.terms} == {"Zorblax"}
    assert all(t.action == "remove" and t.disclosure == pytest.approx(1.0) for r in found for t in r.terms)
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "Zorblax" not in clean[0] and "jo@corp" not in clean[0] and "<EMAIL>" in clean[0] and clean[1] == by_id[1]


def test_disclosing_words_far_from_the_entity(spark, monkeypatch):
    """Letterheads 60 words off, and a word in a document that does not name the entity, against counts of all pairs."""
    monkeypatch.setattr(pii, "PAIRS", 50)
    rng = random.Random(2)
    words = [f"word{k}" for k in range(80)]
    rows = []
    for k in range(240):
        text = [rng.choice(words) for _ in range(100)]
        if k % 20 == 0:
            text[0], text[60], text[99] = "Quuxco", f"jo@corp.example, ip 10.0.0.{k % 40}", "Quuxco"
        if k % 30 == 1:
            text[5], text[90] = "+49 30 1234567", "Blarney"
        rows.append((k, " ".join(text)))
    rows.append((500, "the word Quuxco alone"))
    docs = {i: (t.split(), pii.base_spans(t), t) for i, t in rows}
    owners = {i: {pii.entity(k, t[a:b]) for k, a, b in base} for i, (_, base, t) in docs.items()}
    free = {}
    for i, (_, base, t) in docs.items():
        free[i] = {m[0].lower() for m in brute.re.finditer("[A-Za-z0-9]+", t) if not any(m.start() < b and a < m.end() for _, a, b in base)}
    every = {i: {m.lower() for m in brute.re.findall("[A-Za-z0-9]+", t)} for i, (_, _, t) in docs.items()}
    n, want = len(rows), set()
    for e in set().union(*owners.values()):
        n_e = sum(e in o for o in owners.values())
        for t in set().union(*free.values()):
            n_et = sum(e in owners[i] and t in free[i] for i in docs)
            if n_e >= 3 and n_et >= 3:
                pmi = brute.math.log2(n * n_et / (n_e * sum(t in x for x in every.values())))
                if pmi / brute.math.log2(n / n_e) >= pii.GENERALISE:
                    want.add(t)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.doc_id: r.terms for r in pii.find_spans(df).where("size(terms) > 0").collect()}
    assert want >= {"quuxco", "blarney"} and len(want) < 40
    assert {i: {(t.start, t.end) for t in out.get(i, [])} for i in docs} == {i: {m.span() for m in brute.re.finditer("[A-Za-z0-9]+", t) if m[0].lower() in want and not any(m.start() < b and a < m.end() for _, a, b in base)} for i, (_, base, t) in docs.items()}
    assert len([t for t in out[20] if docs[20][2][t.start : t.end] == "Quuxco"]) == 2 and out[500]


def test_redaction():
    assert pii.redact("Ann 12 a@b.cd x", [("email", 7, 13)], [(0, 3, "generalise"), (4, 6, "generalise"), (14, 15, "remove")]) == "<NAME> <NUMBER> <EMAIL> "


# 3


def slow_crc(data):
    r = 0
    for byte in data:
        r ^= byte << 24
        for _ in range(8):
            r = (r << 1 ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
    return r


def test_page_checksum():
    for data in (b"", b"a", bytes(range(256)) * 3):
        assert media_ogg.crc(data) == slow_crc(data)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 3999, 4000, 4001, 8000, 12_345, 100_000])
def test_round_trip(n):
    data = random.Random(n).randbytes(n)
    payload = media_ogg.payload_of(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(data)
    media = media_ogg.read(media_ogg.write(payload))
    assert media.damaged == 0 and len(media.streams) == 2 and all(s.ended and not s.lost for s in media.streams.values())
    blocks = media_ogg.timeline(media)
    assert b"".join(b for _, _, b in blocks) == payload
    assert [a for a, _, _ in blocks] == list(range(0, len(payload), media_ogg.BLOCK)) and blocks[-1][1] == len(payload)


def test_packets_over_pages_and_damage():
    w = media_ogg.Writer(5, segments=3)
    big, small = bytes(range(256)) * 9, b"tail"
    pages = [*w.pages(b"head", 0), *w.pages(big, 100), *w.pages(b"", 150), *w.pages(small, 200, True)]
    assert len(pages) == 1 + 4 + 1 + 1
    media = media_ogg.read(b"junk" + b"".join(pages) + b"more")
    assert media.streams[5].packets == [(b"head", 0), (big, 100), (b"", 150), (small, 200)]
    bad = bytearray(b"".join(pages))
    bad[len(pages[0]) + 40] ^= 1  # in the first page of the long packet
    media = media_ogg.read(bytes(bad))
    assert media.damaged == 1 and media.streams[5].packets == [(b"head", 0), (b"", 150), (small, 200)] and media.streams[5].lost >= 1
    one = media_ogg.page(media_ogg.FIRST, 7, 9, 0, bytes([2, 3]), b"aabbb")  # two packets on one page
    assert media_ogg.read(one).streams[9].packets == [(b"aa", -1), (b"bbb", 7)]
    assert media_ogg.read(b"").pages == 0 and media_ogg.read(pages[0][:20]).pages == 0


def test_media_columns(spark, docs, corpus):
    got = {}
    for r in docs.select("doc_id", "text").collect():
        b = (r.text or "").encode()
        row = media_ogg.measure(b)
        p = b + bytes(-len(b) % 64 if b else 64)
        assert row[:4] == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert got.setdefault(b, row) == row
    df = media_ogg.encode(docs.where("doc_id in (1, 122)").select("doc_id", "text"), "text").drop("text")
    out = media_ogg.packets(df).collect()
    assert {r.doc_id for r in out} == {1} and {r.damaged for r in out} == {0}
    assert max(r.time_ms for r in out) == len(media_ogg.payload_of(corpus[1][1].encode())) // 8
    assert struct.calcsize("<4sBBqIIIB") == 27


def test_stored_form_by_another_reader(spark, tmp_path):
    """The query's rows against a second reader of the stored bytes, and its feature from the payload."""
    texts = ["", "a", "é" * 70, "word " * 900, "x" * 8000, None, "long " * 4000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in media_ogg.op3_media_ogg(spark, str(tmp_path)).collect()}
    crossing = 0
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media_ogg.write(media_ogg.payload_of(raw))
        payload, rate, streams, pages, packets, spread = brute.ogg_media(stored)
        crossing += spread
        assert payload == want
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        loud = [x >= 128 for x in want]
        facts = {"streams": streams, "pages": pages, "damaged": 0, "packets": packets, "end_ms": len(want) * 1000 // rate, "mean_milli": sum(want) * 1000 // len(want), "square_mean": sum(x * x for x in want) // len(want), "peak": max(want), "crossings": sum(a != b for a, b in zip(loud, loud[1:], strict=False))}
        assert r.feature == ";".join(f"{name}={value}" for name, value in facts.items())
    assert crossing > 3


def test_times_come_from_the_header(spark):
    stored = [(1, media_ogg.write(bytes(9000), rate=16_000)), (2, media_ogg.page(media_ogg.FIRST, 7, 9, 0, bytes([2, 3]), b"aabbb")), (3, None)]
    out = media_ogg.packets(spark.createDataFrame(stored, "k long, media binary")).collect()
    assert max(r.time_ms for r in out if r.k == 1) == 9000 * 1000 // 16_000
    assert [(r.granule, r.time_ms, bytes(r.bytes)) for r in out if r.k == 2] == [(None, None, b"aa"), (7, None, b"bbb")]
    head = media_ogg.MAGIC + media_ogg._FORMAT.pack(0, 1000, 4)
    pages = [media_ogg.page(media_ogg.FIRST, 0, 3, 0, bytes([len(head)]), head), media_ogg.page(media_ogg.LAST, 12, 3, 1, bytes([4, 4, 4]), b"aaaabbbbcccc")]
    own = media_ogg.packets(spark.createDataFrame([(1, b"".join(pages))], "k long, media binary")).collect()
    assert [r.time_ms for r in own] == [0, 4, 8, 12]


# 4


def secrets_of(df):
    return [(r.doc_id, r.n_assign, r.n_access, r.n_hex, brute.sha(_text(r.base)), _text(r.all)) for r in df.collect()]


def _text(spans):
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def test_secrets(spark, docs, corpus):
    want = [(r[0], *brute.secrets(r[1])) for r in corpus]
    same(secrets_of(secret_scan.scan(docs)), want)


def test_secrets_of_random_texts(spark):
    rng = random.Random(11)

    def run(chars, low, high):
        return "".join(rng.choice(chars) for _ in range(rng.randint(low, high)))

    parts = ["password: ", "token=", 'api_key = "', "Secret:", "é ", "\U0001f600", " ", "\n", "PASSWD='", "abcABC12" * 4, "token: token: abcdef"]
    rows = []
    for k in range(300):
        pick = [rng.choice([*parts, run("0123456789abcdef", 1, 60), run("0123456789ABCDEF", 18, 30), run(string.ascii_letters + string.digits + "+/_=-.", 1, 60), "AKIA" + run(string.ascii_uppercase + string.digits, 5, 25)]) for _ in range(rng.randint(0, 12))]
        rows.append((k, "".join(pick)))
    rows.append((900, "token=abcdef " * 700))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = secret_scan.scan(df)
    want = [(i, *brute.secrets(t)) for i, t in rows]
    same(secrets_of(got), want)
    assert any("entropy" in w[5] for w in want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan


def test_letter_keys_and_keys_beside_placeholders(spark):
    key, letters = "q7Zp2LxV9bTn4RkW8sYd", "qWzPaLxVubTneRkWosYd"
    found = [key, letters, f"EXAMPLE_TOKEN={key}", f"example/{key}", f"{letters}/changeme"]
    clean = ["EXAMPLE_TOKEN=changeme-placeholder", "getUserAccountDetailsByNameAndEmail", "THIS_CONSTANT_NAME_READS_AS_WORDS", "some/path/with/ThingsAndOthers", "abcdefghijklmnopqrstuvwxyz", "q7Zp2LxV9bexampleTn4RkW8sYd"]
    df = spark.createDataFrame(list(enumerate(found + clean)), "doc_id long, text string")
    got = {r.doc_id for r in secret_scan.scan(df).collect() if any(s.kind == "entropy" for s in r.all)}
    assert got == set(range(len(found)))


def test_long_secrets_cost_their_length(spark):
    """A megabyte each of what once recursed or cost its square: joined segments, base64, assignments."""
    rng = random.Random(5)
    chars = string.ascii_letters + string.digits + "+/"
    rows = [
        (0, "a-1" + "-a" * 500_000),
        (1, "".join(rng.choice(chars) for _ in range(1_000_000))),
        (2, " ".join(f"token = {''.join(rng.choice(chars) for _ in range(40))}" for _ in range(20_000))),
        (3, "".join(rng.choice(string.ascii_letters) for _ in range(300_000))),
        (4, "0123456789abcdef" * 60_000),
        (5, "Ab" * 500_000),
        (6, "key=" * 250_000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    began = time.monotonic()
    got = secrets_of(secret_scan.scan(df))
    assert time.monotonic() - began < 60
    same(got, [(i, *brute.secrets(t)) for i, t in rows])


# 9


def test_tokens(docs, corpus):
    library = Tokenizer.from_file(TOKENIZER)
    got = token_counts.token_counts(docs, TOKENIZER).collect()
    same(got, [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in corpus])


ALPHABET = ["'", "s", "t", "r", "e", "v", "l", "d", "m", " ", "  ", "\n", "\t", "a", "Z", "é", "1", "²", "!", "-", "<|endoftext|>", "<|endo", "中", "́", "\U0001f600", "\x00", "\x85", "​", "　"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join), min_size=1, max_size=4))
def test_tokens_of_any_text(texts):
    with open(TOKENIZER, encoding="utf-8") as f:
        spec = f.read()
    library = Tokenizer.from_str(spec)
    assert token_counts.count_tokens(texts, spec).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_compiled_merges_follow_the_library(monkeypatch):
    """Pieces of one kind of character, long ones too, with states and paths thrown away often; the library counts no token of the result."""
    rng = random.Random(3)
    with open(TOKENIZER, encoding="utf-8") as f:
        spec = f.read()
    monkeypatch.setattr(token_counts, "STATES", 300)
    monkeypatch.setattr(token_counts, "PATHS", 50)
    library = Tokenizer.from_str(spec)
    alphabets = [string.ascii_lowercase, "ab", "aetionrsh", string.ascii_letters, "=-*#", "0123456789", "éüßñ", "中文字"]
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (1, 2, 3, 7, 20, 60, 400)]
    texts += ["x" * 5000, "=" * 3000, "ab" * 2000, " " * 999, "<|endoftext|>" * 40, "the" * 500]
    assert token_counts.count_tokens(texts, spec).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    machine = token_counts._compiled(spec)[0]
    for t in rng.sample(texts, 20):
        assert machine(t.encode()[:30]) == len(machine.merges.encode(t.encode()[:30]))


def test_one_long_piece_is_bounded(monkeypatch):
    """A piece without repeats needs new states all the time: there are never more than STATES, and the count is the library's."""
    from tokenizers import Tokenizer

    with open(TOKENIZER) as f:
        spec = f.read()
    monkeypatch.setattr(token_counts, "STATES", 5000)
    machine, _ = token_counts._compiled(spec)
    machine.restart()
    most, made = 0, machine.compile

    def counted(*args):
        nonlocal most
        out = made(*args)
        most = max(most, len(machine.states))
        return out

    monkeypatch.setattr(machine, "compile", counted)
    rng = random.Random(6)
    text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöü漢字", k=400_000))
    assert token_counts.count_tokens([text], spec).tolist() == [len(Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids)]
    assert 0 < most <= 5000


def test_long_runs_reach_a_finite_number_of_states():
    with open(TOKENIZER, encoding="utf-8") as f:
        machine = token_counts._compiled(f.read())[0]
    machine(b"z" * 3000)
    before = len(machine.states)
    machine(b"z" * 90_000)
    assert len(machine.states) == before


def test_chunk_size_does_not_matter():
    import numpy as np

    rng = np.random.default_rng(2)
    kinds = np.append(rng.integers(0, token_counts.END + 1, 5000), token_counts.END).astype(np.uint8)
    whole = token_counts.piece_starts(kinds, 10_000)
    for chunk in (1, 2, 7, 256):
        assert (token_counts.piece_starts(kinds, chunk) == whole).all()


def test_other_tokenizers_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError, match="byte-level"):
        token_counts.count_tokens(["a"], f.read())


def test_empty_tables(nothing):
    assert pii.find_spans(nothing).count() == 0
    assert secret_scan.scan(nothing).count() == 0
    assert token_counts.token_counts(nothing, TOKENIZER).count() == 0
    assert media_ogg.packets(media_ogg.encode(nothing.select("doc_id", "text"), "text").drop("text")).count() == 0

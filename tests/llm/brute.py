"""The operators' contracts once more, in plain Python."""

import hashlib
import math
import re
from collections import defaultdict

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LAST = (1 << 63) - 1


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def spans_text(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def repeats(rows, size=20):
    """(doc_id, text) rows to (doc_id, n_words, n_removed, kept_sha256)."""
    first = {}
    for i, text in rows:
        w = SPACED.findall(text or "")
        for k in range(len(w) - size + 1):
            key, place = tuple(w[k : k + size]), (LAST if i is None else i, k)
            first[key] = min(first.get(key, place), place)
    gone_by_id = defaultdict(set)
    for i, text in rows:
        w = SPACED.findall(text or "")
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < (LAST if i is None else i, k):
                gone_by_id[i] |= set(range(k, k + size))
    out = []
    for i, text in rows:
        w = SPACED.findall(text or "")
        kept = [x for k, x in enumerate(w) if k not in gone_by_id[i]]
        out.append((i, len(w), len(w) - len(kept), sha(" ".join(kept))))
    return out


def shingles(text, n):
    w = SPACED.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def components(rows, n=3, percent=90):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                i = len(sets[a] & sets[b])
                if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                    parent[find(a)] = find(b)
    least = defaultdict(lambda: LAST)
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least[find(k)], LAST if i is None else i)
    return [(i, len(sets[k]), None if least[find(k)] == LAST else least[find(k)]) for k, (i, _) in enumerate(rows)]


def contamination(rows, items, size=10):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        if w:
            n = min(size, len(w))
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(i)
    lengths = {len(k) for k in windows}
    out = []
    for d, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        found.discard(None)
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii(text):
    def fits(kind, value):
        digits = [int(c) for c in value if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
            return 16 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [(kind, m.start(), m.end()) for kind, p in PII.items() for m in re.finditer(p, text or "") if fits(kind, m[0])]


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


#: candidates that are no secrets
HARMLESS = (
    r"[a-z_=/+-]+",
    r"[A-Z_=/+-]+",
    r"[0-9+/_=-]+",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9a-f]{24,}",
    r"AKIA[A-Z0-9]{16,}",
)


def harmless(v):
    if any(re.fullmatch(p, v) for p in HARMLESS):
        return True
    segments = re.split("[-_/=+]", v)
    if all(re.fullmatch("[a-z]+|[0-9]{1,4}", x) for x in segments):
        return True
    if not re.fullmatch("[A-Za-z_=/+-]+", v):
        return False
    for x in segments:  # words that begin with a capital, or runs of capitals
        for m in re.finditer("[a-z]+|[A-Z]+", x):
            after = x[m.end() : m.end() + 3]
            if m[0].islower() and m.start() == 0 and len(m[0]) <= 2:
                return False
            if m[0].islower() and m.start() > 0 and len(m[0]) == 1 and not re.match("[A-Z][a-z]{2}", after):
                return False
            if m[0].isupper() and len(m[0]) == 2:
                return False
    return True


def entropy(part):
    return -sum(part.count(c) / len(part) * math.log2(part.count(c) / len(part)) for c in set(part))


def suspect(v, window=20):
    if harmless(v):
        return False
    for x in re.split("(?i)abcdefgh|0123456789|123456789|example|placeholder|changeme|xxxxxxxx", v):
        if len(x) < window or harmless(x):
            continue
        low = 3.8
        if re.fullmatch("[0-9a-fA-F]+", x):
            x, low = x.lower(), 3.0
        if any(entropy(x[k : k + window]) >= low - 1e-9 for k in range(len(x) - window + 1)):
            return True
    return False


def secrets(text):
    text = text or ""
    base = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    more = [(m.start(), 3, m.end(), "entropy") for m in re.finditer("[A-Za-z0-9+/_=-]+", text) if len(m[0]) >= 20 and suspect(m[0])]
    counts = [sum(s[1] == k for s in base) for k in range(3)]

    def text_of(spans):
        return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))

    return (*counts, sha(text_of(base)), text_of(base + more))


def boilerplate(rows, min_sites):
    """(doc_id, text, site) rows to (doc_id, n_lines, n_removed, kept_sha256)."""
    sites = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(" ") and s is not None:
                sites[line.strip(" ")].add(s)
    out = []
    for i, t, _ in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if len(sites.get(x.strip(" "), ())) < min_sites]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def ogg_pages(data):
    """(flags, granule, serial, number, segments, body) of each page of a file without damage, checked bit by bit."""
    at, out = 0, []
    while at < len(data):
        assert data[at : at + 5] == b"OggS\0"
        n = data[at + 26]
        lacing = list(data[at + 27 : at + 27 + n])
        end = at + 27 + n + sum(lacing)
        check = 0
        for byte in data[at : at + 22] + bytes(4) + data[at + 26 : end]:
            check ^= byte << 24
            for _ in range(8):
                check = (check << 1 ^ 0x04C11DB7 if check >> 31 else check << 1) & 0xFFFFFFFF
        assert check == int.from_bytes(data[at + 22 : at + 26], "little")
        number = [int.from_bytes(data[at + a : at + b], "little", signed=s) for a, b, s in ((6, 14, True), (14, 18, False), (18, 22, False))]
        out.append((data[at + 5], *number, lacing, data[at + 27 + n : end]))
        at = end
    return out


def ogg_media(data):
    """(payload, rate, streams, pages, packets, packets over several pages) of a stored form."""
    pages = ogg_pages(data)
    packets = defaultdict(list)
    part, spread, parts = {}, 0, {}
    for flags, granule, serial, number, lacing, body in pages:
        assert number == sum(1 for p in pages[: pages.index((flags, granule, serial, number, lacing, body))] if p[2] == serial)
        assert bool(flags & 2) == (number == 0) and bool(flags & 1) == bool(part.get(serial))
        at = 0
        fresh = True
        for x in lacing:
            parts[serial] = parts.get(serial, 0) + fresh
            fresh = False
            part[serial] = part.get(serial, b"") + body[at : at + x]
            at += x
            if x < 255:
                spread += parts[serial] > 1
                packets[serial].append((part[serial], granule))
                part[serial], parts[serial], fresh = b"", 0, True
            else:
                part[serial] = part[serial] or b""
    headers = {s: p[0][0] for s, p in packets.items()}
    assert all(h[:5] == b"PCM8\x01" and len(h) == 14 for h in headers.values())
    blocks = sorted((g, b) for own in packets.values() for b, g in own[1:] if b)
    done = 0
    for granule, b in blocks:
        done += len(b)
        assert granule == done
    rates = {int.from_bytes(h[6:10], "little") for h in headers.values()}
    return b"".join(b for _, b in blocks), rates.pop(), len(packets), len(pages), sum(map(len, packets.values())), spread

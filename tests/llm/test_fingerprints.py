import hashlib
import re

import xxhash

from llm_cases import prose
from sensorcal.llm.fingerprints import K, S, SIZE, fingerprints

WORD = re.compile(r"[^\x20\x09-\x0d]+")
MASK = (1 << 64) - 1


def chained(values, seed=42):
    h = seed
    for v in values:
        h = xxhash.xxh64_intdigest((v & MASK).to_bytes(8, "little"), seed=h)
    return h


def brute(text):
    w = WORD.findall(text)
    if not w:
        return ""
    found = []
    if len(w) < K:
        h = 42
        for x in w:
            h = xxhash.xxh64_intdigest(x.encode(), seed=h)
        h = xxhash.xxh64_intdigest(K.to_bytes(4, "little"), seed=h)
        found.append((h >> 33, 0))
    else:
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in w]
        m = [chained(h[i : i + S]) for i in range(len(w) - S + 1)]
        signed = [x - (1 << 64) if x >> 63 else x for x in m]
        for i in range(len(w) - K + 1):
            inner = signed[i : i + K - S + 1]
            if min(inner) in (inner[0], inner[-1]):
                found.append((chained(m[i : i + K - S + 1]) >> 33, i))
    first = {}
    for a, i in found:
        first.setdefault(a, i)
    return "".join(f"{a << 32 | i:016X}" for a, i in sorted(first.items())[:SIZE])


def check(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        want.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), brute(t), brute(e)))
    assert sorted(want) == sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got)


def test_against_brute_force(docs):
    rows = [(i * 3, prose(i, 1 + 13 * i)) for i in range(40)] + [(200, "ä𝒳 " * 50), (201, "\n"), (202, "one two")]
    got = fingerprints(docs(rows)).collect()
    check(rows, got)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long_ = [r for r in got if 60 < r.doc_id < 120]
    assert all(r.near_edited > 0.2 and r.near_next == 0 for r in long_)


def test_odd_rows(odd, docs):
    got = fingerprints(odd).collect()
    check([(r.doc_id, r.text) for r in odd.collect()], got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[4][0].fingerprint == by[5][0].fingerprint and by[5][0].near_next == 1.0
    assert fingerprints(docs([])).count() == 0
    one = fingerprints(docs([(1, prose(1, 50))])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0

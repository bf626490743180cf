import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from hypothesis import given, settings, strategies as st

from sensorcal.llm import importance as I

ODD = [None, "", " ", "a", "One", "É È é A", "a1-b2_c3\x00d\ne", "日本 語,日本", "x" * 3000 + " y", "\x7f\x80 z", "end.  "]


def lowered(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text or ""))


def features(text):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def buckets(text):
    return [crc32(f.encode()) % 10_000 for f in features(text)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=20), max_size=12))
def test_window_hashes(some):
    want = [crc32(b" ".join(some[i : i + k])) for k in (1, 2, 3) for i in range(len(some) - k + 1)]
    assert I.window_hashes([b" " + w for w in some]).tolist() == want


def test_window_hashes_of_very_long_words():
    some = [b"a" * n for n in (254, 255, 256, 5000, 1, 70_000)]
    want = [crc32(b" ".join(some[i : i + k])) for k in (1, 2, 3) for i in range(len(some) - k + 1)]
    assert I.window_hashes([b" " + w for w in some]).tolist() == want


def test_words_and_offsets():
    for text in ODD:
        low = I.ascii_lower(text or "")
        found = I.words_with_offsets(low)
        assert low == lowered(text or "") and [w for w, _ in found] == words(text) and all(low[a:b] == w for w, (a, b) in found)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("aZ9 .-\né日\x00　ß")), max_size=60))
def test_buckets_of_any_text(text):
    n, got = I.text_buckets(text)
    assert n == len(words(text)) and sorted(got.tolist()) == sorted(buckets(text))


def brute(docs, target, percent=5, least=20):
    s, t = Counter(b for _, x in docs for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)}
    out = []
    for i, x in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets(x))
        out.append((i, len(words(x)), len(features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    place = {}
    for k, r in enumerate(able[: percent * len(able) // 100]):
        place.setdefault(r[0], []).append(k + 1)
    return out, place


@pytest.mark.parametrize("percent", [5, 30, 100])
def test_resample_equals_brute_force(spark, percent):
    """Odd texts, repeated rows, a null id, columns with clashing names."""
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(300)]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(10, 60)))) for k in range(200)]
    docs += [(1000 + k, t) for k, t in enumerate(ODD)] + [(None, docs[3][1]), docs[5], docs[5]]
    target = [" ".join(rng.choices(vocabulary[:30], k=20)) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, _id int, _score string")
    got = I.resample(df, spark.createDataFrame([(t, 1) for t in target], "text string, _id int"), "doc_id", "text", "text", percent).collect()
    want, place = brute(docs, target, percent)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    ranks = {}
    for r in got:
        if r._rank:
            ranks.setdefault(r._id, []).append(r._rank)
    assert {i: sorted(r) for i, r in ranks.items()} == place


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert I.resample(none, some, "doc_id", "text", "text").count() == 0
    assert I.resample(some, none, "doc_id", "text", "text", 100).first()._rank == 1


def test_more_buckets_than_16_bits(spark):
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    counts = I.bucket_counts(I.bucketed(some, "doc_id", "text", 1 << 20), 1 << 20)
    assert {i: int(counts[i]) for i in counts.nonzero()[0].tolist()} == Counter(crc32(f.encode()) % (1 << 20) for f in features("a b c"))

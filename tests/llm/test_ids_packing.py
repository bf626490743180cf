import heapq
import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from llm_cases import prose
from sensorcal.llm.common import tokens_path
from sensorcal.llm.ids import canonical, code_lengths, decode_block, encode_block, ids_round_trip
from sensorcal.llm.packing import nnls_counts, combinations, pack, places, plan
from sensorcal.llm.tokens import WordIds, slices

TEXTS = [None, "", " ", "The, a. don't i'll e-mail 3,14 X.Y. ..., ,. A.", "İstanbul ΣΑΣ ﬁ ǅ कख़ e\u0301 \u0301x a\u00a0b c\u2003d\x1ce\x85f", "<|endoftext|>x <|startoftext|> y", "ünlü Straße. Ÿ", prose(3, 5000), "x" * 30_000, "\r\n\t tab\tbed"]


def encoded(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens_path())
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]


def test_pieces_give_the_tokenizers_ids():
    w = WordIds(tokens_path())
    for text, ids in zip(TEXTS, encoded(TEXTS)):
        assert w.encode(text) == ids[:-1].tobytes(), text


def test_texts_of_a_batch_are_encoded_together():
    texts = [*TEXTS, None, "word### ... a.b!?", "e.g., x'' l'art- abc!'s", "a<|endoftext|>b<| Stra$ß$ x~^`_{}|", ""]
    column = pa.array(texts, pa.string())
    want = [ids[:-1].tolist() for ids in encoded(texts)]
    w = WordIds(tokens_path())
    for size in (1, 50, 1 << 23):
        cuts = slices(column, size)
        assert [i for a, b in cuts for i in range(a, b)] == list(range(len(texts)))
        got = []
        for a, b in cuts:
            ids, n = w.encode_all(column.slice(a, b - a))
            got += [part.tolist() for part in np.split(ids, np.cumsum(n)[:-1])]
        assert got == want
    assert slices(pa.array([], pa.string())) == []


def huffman_cost(counts):
    heap, cost = [c for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        cost += s
        heapq.heappush(heap, s)
    return cost


def test_code_lengths():
    rng = random.Random(1)
    for n in (2, 3, 7, 50, 300):
        counts = np.array([rng.randrange(0, 1000) for _ in range(n)] + [1, 5])
        bits = code_lengths(counts, 24)
        assert (bits[counts > 0] > 0).all() and not bits[counts == 0].any()
        assert sum(2.0 ** -int(b) for b in bits if b) <= 1 and (counts * bits).sum() == huffman_cost(counts)
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    bits = code_lengths(np.array(fib), 8)
    assert bits.max() == 8 and sum(2.0 ** -int(b) for b in bits) <= 1
    assert code_lengths(np.array([0, 9])).tolist() == [0, 1] and not code_lengths(np.zeros(3, int)).any()
    with pytest.raises(ValueError):
        code_lengths(np.ones(300, int), 8)


@pytest.mark.parametrize("sizes", [[1], [255], [256], [257, 1, 1], [1000, 1, 5000, 3]])
def test_block_round_trip(sizes):
    rng = np.random.default_rng(2)
    docs = [np.minimum(rng.geometric(0.01, n) - 1, 999).astype("<u2") for n in sizes]
    code = canonical(code_lengths(np.bincount(np.concatenate(docs), minlength=1000)))
    assert all((a == b).all() for a, b in zip(docs, decode_block(code, encode_block(code, docs)), strict=True))


def test_files_give_back_every_document(docs):
    order = [5, 3, None, 9, 1, 7, 2, 8, 6, 4]
    rows = [(i, t) for i, t in zip(order, TEXTS)] + [(4, "twice"), (4, "twice")]
    got = sorted(ids_round_trip(docs(rows)).collect(), key=lambda r: r.start)
    want = {}
    for (i, _), ids in zip(rows, encoded([t for _, t in rows])):
        want.setdefault(i, []).append(ids.tobytes())
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at and bytes(r.ids) in want[r.doc_id]
        want[r.doc_id].remove(bytes(r.ids))
        at += len(r.ids) // 4
    assert ids_round_trip(docs([])).count() == 0


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(4)
    for full in (8, 64, 512):
        h = np.concatenate([[0], rng.poisson(20, full)])
        h[rng.integers(1, full + 1)] += 5000
        patterns = plan(h)
        assert all(sum(c * m for c, m in p) <= full for p, _ in patterns)
        assert sum((np.bincount([c for c, m in p for _ in range(m)], minlength=full + 1) * n for p, n in patterns)).tolist() == h.tolist()
        assert set(places(patterns)["cls"]) == set(np.flatnonzero(h))
    combos = combinations(np.arange(1, 17), 16)
    x = nnls_counts(np.array([0] + [100] * 16), combos)
    assert (x >= 0).all() and abs((x[:, None] * (combos > 0)).sum() - 1600) < 40


def test_packing(docs, odd):
    rng = random.Random(6)
    rows = [(i, prose(i, rng.choice([3, 40, 700, 700, 1500, 3000]))) for i in range(150)] + [(7, prose(7, 3)), (7, prose(7, 3))]
    for df, least in ((docs(rows), 0.93), (odd, 0.0)):
        given = df.collect()
        got = pack(df).collect()
        ids = {r.text: a for r, a in zip(given, encoded([r.text for r in given]))}
        by_copy = {}
        for r in got:
            by_copy.setdefault(r.copy, []).append(r)
        assert len(by_copy) == len(given)
        want = sorted((str(r.doc_id), crc32(ids[r.text].tobytes()), len(ids[r.text])) for r in given)
        known = {crc32(a[s : s + n].tobytes()): a for a in ids.values() for s in range(0, len(a), 4096) for n in [min(4096, len(a) - s)]}
        made = []
        for parts in by_copy.values():
            parts.sort(key=lambda r: r.start)
            assert [r.start for r in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
            a = known[parts[0].ids_crc32]
            assert all(r.ids_crc32 == crc32(a[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(a) for r in parts)
            made.append((str(parts[0].doc_id), crc32(a.tobytes()), len(a)))
        assert sorted(made) == want
        windows = {}
        for r in got:
            windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places_ in windows.values():
            places_.sort()
            assert [o for o, _ in places_] == [sum(n for _, n in places_[:k]) for k in range(len(places_))]
            assert sum(n for _, n in places_) <= 4096
        assert sum(r.length for r in got) >= least * 4096 * len(windows)
    assert pack(docs([])).count() == 0

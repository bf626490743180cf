import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from sensorcal.llm import codes
from sensorcal.llm.codes import compress, nearest


def brute(rows, entries):
    far = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
    return far.argmin(axis=1), far.min(axis=1)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 5), st.integers(1, 9), st.integers(1, 4), st.sampled_from([1, 2, 7, 1024]))
def test_trie_equals_all_distances(seed, n, dims, k, span, block):
    rng = np.random.default_rng(seed)
    rows = rng.integers(-span, span + 1, (n, dims))
    entries = rng.integers(-span, span + 1, (k, dims))
    for given_rows in (np.unique(rows, axis=0), rows):
        got = nearest(given_rows.astype(np.int64), entries.astype(np.int64), block)
        np.testing.assert_array_equal(got, brute(given_rows, entries))


def reference(vectors, parts, k, rounds):
    """Plain rounds over (id, label, integers)."""
    rows = sorted((v for v in vectors), key=lambda r: (r[0] is None, r[0], r[2]))
    x = np.array([r[2] for r in rows], np.int64)
    cut, books = np.split(x, parts, axis=1), []
    for p in cut:
        book = p[:k].copy()
        for _ in range(rounds):
            index, _ = brute(p, book)
            for e in set(index.tolist()):
                book[e] = [sum(c) // len(c) for c in p[index == e].T.tolist()]
        books.append(book)
    found = [brute(p, b) for p, b in zip(cut, books)]
    return books, [(r[0], r[1], bytes(int(f[0][i]) for f in found), sum(int(f[1][i]) for f in found)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("n, hot", [(3, 0), (400, 0), (900, 300)])
def test_rounds_equal_brute_force(spark, n, hot):
    rng = np.random.default_rng(n)
    ids = rng.permutation(n).tolist()
    data = [(int(i), [None, 1, 2][i % 3], [float(v) for v in (np.full(8, 0.5) if k < hot else rng.normal(0, 0.01, 8))]) for k, i in enumerate(ids)]
    out, books = compress(spark.createDataFrame(data, "i long, l int, v array<double>"), "i", "v", "l", entries=16)
    want_books, want = reference([(i, l, [int(np.floor(1024 * c)) for c in v]) for i, l, v in data], 4, 16, 4)
    for a, b in zip(books.entries, want_books, strict=True):
        np.testing.assert_array_equal(a, b)
    label_sums = {}
    for _, label, _, error in want:
        label_sums[label] = label_sums.get(label, 0) + error
    got = sorted((r._id, r._label or 0, bytes(r._code), r._error, r._label_error) for r in out.collect())
    assert got == sorted((i, l or 0, c, e, label_sums[l]) for i, l, c, e in want)


def test_odd_rows(spark):
    """Unusable vectors go; ids repeat and are null; other columns and their names do not matter."""
    nan, inf = float("nan"), float("inf")
    good = [0.1, 0.2, 0.3, 0.4]
    rows = [
        (1, None, 1, "x"), (2, [], 1, "x"), (3, [0.1, None, 0.3, 0.4], 1, "x"), (4, [0.1, nan, 0.3, 0.4], 1, "x"), (5, [0.1, -inf, 0.3, 0.4], 1, "x"),
        (6, good, 1, "x"), (6, good, 1, "x"), (7, [1e30, 0.0, 0.0, 0.0], None, None), (None, good, None, "x"), (8, good + good, 1, "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, label int, _v string").withColumnRenamed("label", "_code")
    out, books = compress(df, "vec_id", "v", "_code")
    assert sorted((r._id or -1, r._error) for r in out.collect()) == [(-1, 0), (6, 0), (6, 0), (7, 0)]
    assert [len(b) for b in books.entries] == [4] * 4 and books.entries[0].max() == codes.LARGEST
    for none in (df.where("false"), df.where("vec_id < 6"), df.where("vec_id = 6").selectExpr("vec_id", "array(1D, 2D, 3D) AS v", "_code")):
        out, books = compress(none, "vec_id", "v", "_code")
        assert out.count() == 0 and books.entries == ()


def test_two_bytes_for_large_codebooks(spark):
    df = spark.range(300).selectExpr("id", "array(id / 1024D, 0D, 0D, 0D) AS v", "1 AS l")
    out, _ = compress(df, "id", "v", "l", entries=300)
    assert {r._id: int.from_bytes(r._code[:2]) for r in out.collect()} == {i: i for i in range(300)}

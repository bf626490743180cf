import difflib
import random

from pyspark.sql import functions as F

from llm_cases import prose
from sensorcal.llm.lines import line_dedup, patience, repeated_lines, runs, without_lines


def deduped(df):
    return line_dedup(df).withColumn("left", without_lines(F.col("text"), F.col("_removed")))


def test_alignment_is_increasing_and_finds_unique_lines():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randrange(12) for _ in range(rng.randrange(15))]
        b = [rng.randrange(12) for _ in range(rng.randrange(15))]
        met = patience(a, b)
        assert all(a[i] == b[j] for i, j in met)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(met, met[1:]))
    # Without repeats and in one order, it finds all that a longest common subsequence has.
    for _ in range(100):
        a = sorted(rng.sample(range(40), 15))
        b = sorted(rng.sample(range(40), 15))
        size = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert len(patience(a, b)) == size == len(set(a) & set(b))


def test_blocks_need_words():
    assert repeated_lines([1, 2, 3], [9, 1, 2, 8], [5, 6, 6, 5]) == [1, 2]
    assert repeated_lines([1, 2, 3], [9, 1, 8, 2], [5, 6, 6, 5]) == []


def test_against_brute_force(docs):
    """Every line with enough words that an earlier document has goes, where order is kept; first holders keep theirs."""
    rng = random.Random(5)
    pool = [prose(k, 11) for k in range(30)]
    rows = [(i, "\n".join(pool[k] for k in sorted(rng.sample(range(30), rng.randrange(1, 8))))) for i in range(60)]
    seen, want = set(), {}
    for i, text in rows:
        want[i] = "\n".join(x for x in text.split("\n") if x not in seen)
        seen |= set(text.split("\n"))
    got = {r.doc_id: r.left for r in deduped(docs(rows)).collect()}
    assert got == want


def test_copies_whose_lines_others_hold_first(docs):
    a, b = prose(1, 6), prose(2, 6)
    rows = [(1, f"{a}\n{prose(3, 20)}"), (2, f"{b}\n{prose(4, 20)}"), (3, f"{a}\n{b}"), (4, f"{a}\n{b}"), (5, f"{a}\n{b}")]
    got = {r.doc_id: r.left for r in deduped(docs(rows)).collect()}
    assert got == {**dict(rows), 4: "", 5: ""}


def _all_earlier(texts):
    """Positions that go if each text is aligned with every earlier one."""
    cut = [[x.strip() for x in t.split("\n")] for t in texts]
    words = [[len(x.split()) for x in t] for t in cut]
    return [sorted({p for e in cut[:i] for p in repeated_lines(e, cut[i], words[i])}) for i in range(len(cut))]


def test_short_lines_in_any_order_against_all_earlier_documents(docs):
    rng = random.Random(11)
    pool = [prose(k, 1 + k % 7) for k in range(25)] + ["", " "]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(80)]
    for i in range(20):
        lines = texts[rng.randrange(80)].split("\n")
        at = rng.randrange(len(lines))
        texts.append("\n".join(lines[at:] + lines[:at]) if i % 2 else "\n".join([prose(900 + i, 9), *lines]))
    want = _all_earlier(texts)
    table = docs(list(enumerate(texts)))
    every = {r.doc_id: r._removed or [] for r in line_dedup(table, rare=1000).collect()}
    assert [every[i] for i in range(100)] == want and sum(map(bool, want)) > 20
    # With common runs, what goes is part of that, and each run that an earlier document holds has met one that holds it.
    some = {r.doc_id: r._removed or [] for r in line_dedup(table, rare=2).collect()}
    assert all(set(some[i]) <= set(want[i]) for i in range(100)) and sum(map(len, some.values())) > 0.8 * sum(map(len, want))


def test_runs():
    assert len(runs([1, 2, 3], [5, 4, 3])) == 1 and len(runs([1, 2], [10, 10])) == 2 and len(runs([1], [9])) == 0
    # A run's hash is the same wherever it stands, and blank lines start none.
    assert set(runs([1, 2], [5, 5])) < set(runs([9, 1, 2, 7], [9, 5, 5, 0]))
    assert set(runs([2, 1], [5, 5])).isdisjoint(runs([1, 2], [5, 5]))


def test_an_early_document_with_many_pairs_is_dealt_out(docs, monkeypatch):
    from sensorcal.llm import lines

    monkeypatch.setattr(lines, "LOT", 7)
    shared = prose(0, 30)
    got = {r.doc_id: r._removed for r in line_dedup(docs([(i, f"{shared}\n{prose(i + 1, 5)}") for i in range(100)])).collect()}
    assert got == {0: None} | {i: [0] for i in range(1, 100)}


def test_common_line_in_most_documents(docs):
    shared = prose(0, 60)
    rows = [(i, f"{prose(i + 1, 15)}\n{shared}") for i in range(300)]
    got = {r.doc_id: r.left for r in deduped(docs(rows)).collect()}
    assert shared in got[0] and not any(shared in got[i] for i in range(1, 300))
    assert all(prose(i + 1, 15) in got[i] for i in range(300))


def test_odd_rows(odd, docs):
    clash = odd.withColumns({"line": F.lit(1), "early": F.lit(2), "_gone": F.lit(3), "_doc": F.lit(4), "_gone_doc": F.lit(5), "lot": F.lit(6), "n": F.lit(7)})
    rows = deduped(clash).collect()
    assert len(rows) == 10 and set(clash.columns) < set(rows[0].asDict())
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.left)
    assert by[4][0] == by[4][1] != "" and by[5] == [""] and "end" in by[None] and by[1] == [None] and by[3] == [" \n\t\n "]
    assert deduped(docs([])).count() == 0

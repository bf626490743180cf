import re
from collections import Counter

from pyspark.sql import functions as F

from llm_cases import prose
from sensorcal.llm.quality import bin_start, measure, quality_filter, quality_verdicts

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def test_measures_against_brute_force(docs):
    texts = [None, "", "a b c", "x " * 40, prose(1, 30) + " " + prose(1, 9) + "\n#\n#\n \n", "ä\u00a0ß 𝒳y\x0bz\x0c| <> " + prose(2, 12) + " q " + prose(2, 12), "one\n" * 5]
    rows = measure(docs(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows] == [brute(t) for t in texts]


def test_bins(spark):
    got = [r.b for r in spark.range(5000).select(bin_start(F.col("id")).alias("b")).collect()]
    assert got[:64] == list(range(64)) and got == sorted(got) and all(0 <= i - b <= i / 32 for i, b in enumerate(got))


def test_junk_is_rejected_and_prose_kept(docs):
    clean = [(i, prose(i, 60), "en", "hot" if i % 3 else "s", 1) for i in range(300)]
    junk = [(1000 + i, " ".join(f"{w}###" for w in prose(i, 60).split()), "en", "hot", 1) for i in range(20)]
    got = {r.doc_id: r.kept for r in quality_verdicts(docs(clean + junk), least_docs=50).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(20))


def test_odd_rows(odd, docs):
    clash = odd.withColumns({"n_words": F.lit(-1), "kept": F.lit("x"), "signal": F.lit(0), "q1": F.lit(0), "_lines": F.lit(1), "_words": F.lit(2), "_own_kept": F.lit(3)})
    out = quality_filter(clash)
    assert out.columns == clash.columns
    kept = out.collect()
    # The very long text repeats itself after 9,973 words, so the base rules reject it.
    assert sorted(r.doc_id or 0 for r in kept) == [0, 4, 4, 5] and {(r.n_words, r.kept, r._lines, r._words, r._own_kept) for r in kept} == {(-1, "x", 1, 2, 3)}
    assert quality_verdicts(odd).filter("base_failed").count() == 6
    assert quality_filter(docs([])).count() == 0

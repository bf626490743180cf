import random
import re

from pyspark.sql import functions as F

from llm_cases import prose
from sensorcal.llm.jaccard import jaccard_components, one_of_each
from sensorcal.llm.shingles import Shingler

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(s), label[i]) for i, s in sets.items()}


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.random()}"
    return " ".join(out)


def test_hashes_are_sets_of_shingles():
    for text in (None, "", "A b", "Ä b c d e f", "a b\x0bc\x0cd\u00a0e f g h", prose(1, 500), prose(2, 30_000)):
        assert len(Shingler()(text)) == len(shingles(text))
    assert (Shingler()("A b C d E") == Shingler()("a\nb c\td e")).all()


def test_against_brute_force(docs):
    rng = random.Random(7)
    passage = prose(99, 60)
    rows = []
    for base in range(12):
        words = prose(base, rng.randrange(8, 150)).split()
        for _ in range(rng.randrange(1, 9)):
            rows.append((len(rows), edited(words, rng, rng.randrange(0, 5))))
    rows += [(len(rows) + k, f"{prose(200 + k, 120)} {passage}") for k in range(25)]
    rows += [(500 + k, t) for k, t in enumerate(["a b c", "A B C", "", None, "a b c d", "a b c d e"])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(rows)).collect()}
    assert got == brute(rows)


def test_large_group_of_near_copies(docs):
    """Links inside a list of a frequent shingle: chains and copies whose pivot links only some of them."""
    rng = random.Random(11)
    base = prose(5, 160).split()
    rows = [(i, edited(base, rng, i % 5)) for i in range(150)]
    drift = list(base)
    for k in range(30):
        drift = list(drift)
        drift[rng.randrange(len(drift))] = f"d{k}"
        rows.append((1000 + k, " ".join(drift)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(rows)).collect()}
    assert got == brute(rows)


def test_odd_rows(odd, docs):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(odd).collect()), key=str)
    assert [x for x in got if x[0] in (1, 2, 3)] == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert {x[2] for x in got if x[0] in (4, 5)} == {4} and (7, 1, 7) in got and (None, 0, None) in got and (None, 69, 4) in got
    clash = odd.withColumns({"rep": F.lit(1), "unit": F.lit(2), "comp": F.lit(3), "_id": F.lit(4)})
    kept = one_of_each(clash)
    assert kept.columns == clash.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "6", "7", "None"]
    assert jaccard_components(docs([])).count() == 0 and one_of_each(docs([])).count() == 0

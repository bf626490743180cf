import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorcal.llm.pieces import LONG, Pieces, decode_pieces, encode_pieces, piece_path, pieces, round_trip
from sensorcal.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "   ", "▁", "a", " a", "a ", "\n", "\t\n x", "a  b   c    d" + " " * 40 + "e", "tab\there", "▁▁under  ▁score", "<s> </s> <unk> <0x0A>",
    "日本語 text 🎉🎉 é é", "\u0000nul\u0000", "it's (fine), isn't it?...", "x" * 5000, "ab" * 4000 + " " + "é" * 3000, "1234567890 3.14", "  ",
]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces(piece_path())


def ids(raw):
    return np.frombuffer(raw, "<i4").tolist()


def test_odd_texts_equal_the_library(vocabulary):
    for text, raw in zip(ODD, vocabulary.encode(ODD), strict=True):
        want = vocabulary.library.encode(text)
        assert ids(raw) == want, text[:40]
        assert vocabulary.decode(want) == vocabulary.library.decode(want)
    assert vocabulary.encode([None, ""]) == [b"", b""]


def test_made_up_texts_equal_the_library(vocabulary):
    rng = random.Random(3)
    letters = " ab▁\n\té日🎉<s>.,()'x0 ́the ing"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(800)]
    for text, raw in zip(texts, vocabulary.encode(texts), strict=True):
        assert ids(raw) == vocabulary.library.encode(text), text


def test_any_ids_decode_as_the_library_does(vocabulary):
    rng = random.Random(5)
    for _ in range(2000):
        some = [rng.choice([0, 1, 2, 259, 261, 28705, rng.randrange(32_000), rng.randrange(3, 259)]) for _ in range(rng.randrange(9))]
        assert vocabulary.decode(some) == vocabulary.library.decode(some), some


def test_heap_and_rounds_agree(vocabulary):
    """The two forms of the agenda, on chains shorter and longer than where one takes over."""
    rng = random.Random(7)
    for n in (1, 2, 9, LONG, 3 * LONG):
        chains = [[vocabulary.symbol[rng.choice("thesaringo ▁".replace("▁", " "))] for _ in range(n)] for _ in range(50)]
        merged, of = vocabulary.merge_many(np.array(chains, np.int64).ravel(), np.repeat(np.arange(50), n))
        for k, chain in enumerate(chains):
            assert merged[of == k].tolist() == vocabulary.merge_one(list(chain))


def test_a_wrong_merge_is_noticed():
    own = Pieces(piece_path())
    own.ranks = own.ranks[::-1].copy()
    with pytest.raises(ValueError, match="library"):
        own.encode(["The quick brown fox jumps over something longer"])


def test_memory_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr("sensorcal.llm.pieces.MEMORY", 10)
    monkeypatch.setattr("sensorcal.llm.pieces.AT_ONCE", 30)
    texts = [f"number {k} of many words {k * k}" for k in range(60)]
    assert [ids(r) for r in vocabulary.encode(texts)] == vocabulary.library.encode(texts)
    assert len(vocabulary.known) < 40


def test_columns(spark, vocabulary):
    """Nulls, repeated rows and other columns with any name."""
    rows = [(k, t, "r") for k, t in enumerate([*ODD, None, "a", "a"])]
    df = spark.createDataFrame(rows, "ids long, text string, decoded string")
    out = df.withColumn("e", encode_pieces(F.col("text"))).withColumn("d", decode_pieces(F.col("e"))).withColumn("r", round_trip(F.col("text")))
    for r in out.collect():
        want = vocabulary.library.encode(r.text or "")
        assert r.e == want == r.r["ids"] and r.d == r.r["decoded"] == vocabulary.library.decode(want) and r.decoded == "r"
    assert df.where("false").select(round_trip(F.col("text"))).count() == 0


def test_query_equals_the_library_on_whole_texts(spark, vocabulary):
    import hashlib

    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in QUERIES["op12_piece_ids"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = vocabulary.library.encode(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), digest(",".join(map(str, want))), digest(vocabulary.library.decode(want)))

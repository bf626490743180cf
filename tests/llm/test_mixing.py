from pyspark.sql import functions as F

from llm_cases import prose
from sensorcal.llm.common import WORD
from sensorcal.llm.mixing import letter_quality, mix, sampling_key


def mixed(df, **more):
    text = F.coalesce("text", F.lit(""))
    return mix(df, F.regexp_count(text, F.lit(WORD)), F.col("source"), sampling_key(F.col("doc_id"), text, letter_quality(text)), **more)


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_and_budgets(docs):
    rows = [(i, prose(i, 5 + i % 40), "en", s, 0) for i in range(900) for s in [("hot", "a", None, "é", "b")[min(i % 7, 4)]]]
    got = mixed(docs(rows)).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r._size
    want = brute_targets(sizes)
    for s, t in want.items():
        mine = [r for r in got if r.source == s]
        assert all(abs(r._target - t) < 1e-6 * t and r._source_size == sizes[s] for r in mine)
        assert abs(sum(r._size * r._copies for r in mine) - t) <= 45
        # Whole epochs come first: copies differ by one at most.
        assert max(r._copies for r in mine) <= 2 and max(r._copies for r in mine) - min(r._copies for r in mine) <= 1
    again = mixed(docs(rows).repartition(13)).collect()
    assert {(r.doc_id, r._copies) for r in got} == {(r.doc_id, r._copies) for r in again}


def test_quality_weighs(docs):
    rows = [(i, prose(i, 20) if i % 2 else "# " * 60 + prose(i, 10), "en", "ab"[i % 31 == 0], 0) for i in range(800)]
    got = [r for r in mixed(docs(rows), weights=(1, 40)).collect() if r.source == "a"]
    share = lambda kind: sum(r._copies for r in got if r.doc_id % 2 == kind) / sum(r.doc_id % 2 == kind for r in got)
    assert share(1) > share(0) + 0.2


def test_parts_are_even_where_weights_differ(spark, monkeypatch):
    from sensorcal.llm import mixing

    seen = {}
    keep = mixing.prefix_sums

    def spy(df, *more):
        seen["largest"] = df.groupBy("source", "part").count().agg(F.max("count")).first()[0]
        return keep(df, *more)

    monkeypatch.setattr(mixing, "prefix_sums", spy)
    rows = spark.range(200_000).withColumns({"source": F.lit("a"), "text": F.lit("x"), "quality": F.when(F.col("id") % 10 == 0, 0.05).otherwise(1.0)})
    key = sampling_key(F.col("id"), F.col("text"), F.col("quality"))
    taken = mix(rows.union(rows.withColumn("source", F.lit("b"))), F.lit(1), F.col("source"), key, weights=(1, 1)).filter("source = 'a'").agg(F.sum("_copies")).first()[0]
    assert seen["largest"] < 2 * mixing.PART_ROWS and abs(taken - 300_000) <= 1


def test_odd_rows(odd, docs):
    clash = odd.withColumns({"size": F.lit(1), "key": F.lit(2), "target": F.lit(3), "part": F.lit(4), "epochs": F.lit(5), "_key": F.lit(6), "_source": F.lit(7), "_s": F.lit(8), "_limit": F.lit(9), "_mix_key": F.lit(10)})
    rows = mixed(clash).collect()
    assert len(rows) == 10 and all(0 <= r._copies <= 2 for r in rows)
    assert {(r.epochs, r._key, r._source, r._s, r._limit, r._mix_key) for r in rows} == {(5, 6, 7, 8, 9, 10)}
    four = [r._copies for r in rows if r.doc_id == 4]
    assert four[0] == four[1]
    assert mixed(docs([])).count() == 0

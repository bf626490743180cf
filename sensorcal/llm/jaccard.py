"""Exact Jaccard join of documents on word shingles by a grouped prefix join.

Every document's shingles are put in one global order, rare ones first. Two sets with similarity t or more share a
shingle among the first n - ceil(t n) + 1 of each (the prefixes). Documents with the same size and prefix form one
group; groups are joined on prefix shingles, filtered by size, by position and by the number of shared prefix
shingles, and only then expanded to their distinct sets, which are compared in full.

* The order. Shingles are counted over all documents in 2^30 bins; bins are shuffled as sorted, packed runs. The
  most frequent ones (at most ``HOT_BINS``, so the list that tasks receive has a fixed bound) come last. The order
  affects the cost only, never the result.
* Frequent shingles in a prefix. A list of the groups that share one may hold any part of the table, so it is
  never paired with itself. Its members are compared with a few pivots; members that end up in the component of
  the most members of the list need no more pairs among themselves; only the rest are compared with all members
  outside their own component that the filters admit. So no link between components is lost.
* Equal sets are one node, so copies cost one row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import materialize, release
from .common import WORD, fresh
from .components import components
from .shingles import Shingler

WIDTH = 5
PERCENT = 75
#: Bins of the frequency order, the least count of a frequent one, and the most that are told to the tasks (16 MB).
BIN_BITS = 30
HOT_COUNT = 8
HOT_BINS = 2_000_000
#: Members of two groups are paired directly up to so many pairs; larger products go the way of frequent shingles.
DIRECT_PAIRS = 64
#: Bits of the filter that tells which sets have to be read again.
FILTER_BITS = 1 << 23


def _packed(bins: np.ndarray) -> bytes:
    """Sorted bins of one chunk as differences."""
    d = np.diff(bins, prepend=bins[:1] * 0)
    wide = bool(len(d) > 1 and d[1:].max() > 0xFFFF)
    return bytes([wide]) + d[:1].astype("<u4").tobytes() + d[1:].astype("<u4" if wide else "<u2").tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    d = np.concatenate([np.frombuffer(blob, "<u4", 1, 1), np.frombuffer(blob, "<u4" if blob[0] else "<u2", offset=5).astype(np.uint32)])
    return np.cumsum(d, dtype=np.int64)


def _hot_bins(docs: DataFrame, chunks: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent bins and the bit lengths of their counts, over all documents of ``docs(text)``."""
    step = -(-(1 << BIN_BITS) // chunks)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, held, size = Shingler(WIDTH), [], 0

        def flush() -> pd.DataFrame:
            bins = np.sort(np.concatenate(held))
            cuts = np.searchsorted(bins, np.arange(chunks + 1) * step)
            rows = [(k, _packed(bins[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            return pd.DataFrame(rows, columns=["chunk", "run"])

        for batch in batches:
            for text in batch["text"]:
                s = shingler(text)
                if len(s):
                    held.append((s >> np.uint64(64 - BIN_BITS)).astype(np.int64))
                    size += len(s)
                if size > 3_000_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def frequent(group: pd.DataFrame) -> pd.DataFrame:
        bins, n = np.unique(np.concatenate([_unpacked(r) for r in group["run"]]), return_counts=True)
        many = n >= HOT_COUNT
        return pd.DataFrame({"bin": bins[many], "n": n[many]})

    hot = docs.mapInPandas(runs, "chunk int, run binary").groupBy("chunk").applyInPandas(frequent, "bin long, n long")
    hot = materialize(hot, "frequent")
    tally = {r.k: r.c for r in hot.groupBy(F.length(F.bin("n")).alias("k")).agg(F.count("*").alias("c")).collect()}
    least, kept = 64, 0
    while least and kept + tally.get(least - 1, 0) <= HOT_BINS:
        least -= 1
        kept += tally.get(least, 0)
    top = hot.filter(F.length(F.bin("n")) >= least).toPandas().sort_values("bin")
    release(hot)
    return top["bin"].to_numpy(np.int64), np.array([int(n).bit_length() for n in top["n"]], np.uint8)


def _prefix_length(n: Column) -> Column:
    return n - F.ceil(n * PERCENT / 100).cast("int") + 1


def _least_overlap(n: Column, m: Column) -> Column:
    """Shared shingles that two sets of these sizes need."""
    return F.ceil((n + m) * PERCENT / (100 + PERCENT)).cast("int")


def _described(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, n, unit, grp, cold, prefix, rep): ``unit`` names the set, ``grp`` its size and prefix, ``rep`` the text; the first ``cold`` prefix shingles are not frequent."""
    # At most HOT_BINS entries of nine bytes.
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, classes = shared.value
        shingler = Shingler(WIDTH)
        digest = lambda a, seed: xxhash.xxh3_64_intdigest(a.tobytes(), seed=seed) - (1 << 63)
        for batch in batches:
            rows = []
            for doc_id, text, rep in zip(batch["doc_id"], batch["text"], batch["rep"]):
                s = shingler(text)
                n = len(s)
                kind = np.zeros(n, np.uint8)
                if n and len(bins):
                    own = (s >> np.uint64(64 - BIN_BITS)).astype(np.int64)
                    at = np.minimum(np.searchsorted(bins, own), len(bins) - 1)
                    kind = np.where(bins[at] == own, classes[at], 0)
                order = np.argsort(kind, kind="stable")
                length = n - -(-n * PERCENT // 100) + 1 if n else 0
                first = order[:length]
                prefix = s[first]
                rows.append((doc_id, n, digest(s, n), digest(prefix, n + 1), int((kind[first] == 0).sum()), prefix.view(np.int64), rep))
            names = ["doc_id", "n", "unit", "grp", "cold", "prefix", "rep"]
            yield pd.DataFrame(rows, columns=names).assign(doc_id=pd.array([r[0] for r in rows], "Int64"))

    return docs.mapInPandas(describe, "doc_id long, n int, unit long, grp long, cold int, prefix array<long>, rep long")


def _cold_pairs(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (g, h) of groups that share enough infrequent prefix shingles; each such shingle stands in few documents."""
    postings = docs.select("grp", F.explode(F.slice("prefix", F.lit(1), F.col("cold"))).alias("s"))
    following = Window.partitionBy("s").orderBy("grp").rowsBetween(1, Window.unboundedFollowing)
    later = postings.select(F.col("grp").alias("g"), F.collect_set("grp").over(following).alias("later")).filter(F.size("later") > 0)
    shared = later.select("g", F.explode("later").alias("h")).filter("g <> h").groupBy("g", "h").agg(F.count("*").alias("both"))
    side = lambda x: groups.select(F.col("grp").alias(x), F.col("n").alias(f"n_{x}"), F.col("hot").alias(f"hot_{x}"))
    met = shared.join(side("g"), "g").join(side("h"), "h")
    need = _least_overlap(F.col("n_g"), F.col("n_h"))
    least = F.least(*(_prefix_length(F.col(f"n_{x}")) - F.col(f"n_{x}") + need for x in "gh")) - F.least("hot_g", "hot_h")
    return met.filter((F.least("n_g", "n_h") >= need) & (F.col("both") >= least)).select("g", "h")


def _filtered(pairs: DataFrame) -> DataFrame:
    """Candidates (x, nx, px, y, ny, py) whose sizes and positions admit enough shared shingles."""
    room = 1 + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) - 1
    return pairs.filter((F.col("x") != F.col("y")) & (F.least(room, F.col("nx"), F.col("ny")) >= _least_overlap(F.col("nx"), F.col("ny"))))


def _star_pairs(lists: DataFrame) -> DataFrame:
    """Every member of a list with its pivots: the one with the fewest rare shingles, and two by chance."""
    me = F.struct("unit", "n", "pos")
    pivots = lists.groupBy("list").agg(
        F.array(F.min_by(me, F.struct("pos", "n", "unit")), *(F.min_by(me, F.xxhash64("unit", F.lit(k))) for k in (1, 2))).alias("pivots")
    )
    # Written first, so that a list with any share of the rows meets one row in a join that Spark can split.
    rows = lists.join(materialize(pivots, "pivots"), "list").select("unit", "n", "pos", F.explode("pivots").alias("p"))
    return _filtered(rows.select(F.col("unit").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("p.unit").alias("y"), F.col("p.n").alias("ny"), F.col("p.pos").alias("py")))


def _rest_pairs(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of a list's members outside its largest component with the members of other components."""
    named = lists.join(labels, lists.unit == labels.node, "left").select("list", "unit", "n", "pos", F.coalesce("component", "unit").alias("comp"))
    sizes = named.groupBy("list", "comp").agg(F.count("*").alias("k"))
    main = sizes.groupBy("list").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1")
    apart = named.join(materialize(main, "main"), "list")
    outside = apart.filter("comp <> main").select("list", F.col("unit").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("comp").alias("cx"))
    rest = apart.select("list", F.col("unit").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("comp").alias("cy"), "main")
    return _filtered(outside.join(rest, "list").filter("cx <> cy AND (cy = main OR x < y)"))


def _bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """One bit per key's remainder; at most FILTER_BITS / 64 numbers reach the driver whatever the table."""
    at = F.pmod(key, F.lit(FILTER_BITS))
    bits = keys.select((at / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("b"))
    found = bits.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out


def _links(pairs: DataFrame, docs: DataFrame, units: DataFrame) -> DataFrame:
    """The pairs (x, y) of units whose full sets are similar enough."""
    pairs = materialize(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")
    wanted = units.join(pairs.select(F.col("x").alias("unit")).union(pairs.select("y")).distinct(), "unit", "left_semi")
    wanted = materialize(wanted.select("unit", "rep"), "wanted")
    spark = docs.sparkSession
    # One bit per place: FILTER_BITS / 8 bytes whatever the input. Documents that pass by chance drop out in the join.
    bits = spark.sparkContext.broadcast(_bitmap(wanted, "rep"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, bitmap = Shingler(WIDTH), bits.value
        for batch in batches:
            at = batch["rep"].to_numpy(np.int64) % FILTER_BITS
            batch = batch[(bitmap[at >> 6] >> (at & 63)) & 1 == 1]
            yield pd.DataFrame({"rep": batch["rep"], "shingles": [shingler(t).tobytes() for t in batch["text"]]})

    read = docs.select("rep", "text").mapInPandas(sets, "rep long, shingles binary").dropDuplicates(["rep"])
    read = wanted.join(read, "rep").select("unit", "shingles")
    read = materialize(read, "sets")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["a"], batch["b"]):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(a) + len(b) - both))
            yield batch.loc[keep, ["x", "y"]]

    left = read.select(F.col("unit").alias("x"), F.col("shingles").alias("a"))
    right = read.select(F.col("unit").alias("y"), F.col("shingles").alias("b"))
    out = materialize(pairs.join(left, "x").join(right, "y").mapInPandas(compare, "x long, y long"), "links")
    release(pairs, wanted, read)
    return out


def _resolved(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, rep, n, n_links, comp) for each row, a written table; ``rep`` is the text's hash, ``comp`` names the component."""
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("rep", F.xxhash64("text"))
    chunks = max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = materialize(_described(own, _hot_bins(own.select("text"), chunks)), "prefixes")
    full = table.filter("n > 0")
    # A set is read again from one of the texts that have it.
    units = materialize(full.groupBy("unit", "grp").agg(F.first("n").alias("n"), F.min("rep").alias("rep")), "units")
    groups = full.groupBy("grp").agg(F.first("n").alias("n"), F.first(F.size("prefix") - F.col("cold")).alias("hot"))

    members = units.select("grp", "unit", "n")
    crowd = members.groupBy("grp").agg(F.count("*").alias("k"))
    met = _cold_pairs(full, groups)
    many = lambda x: crowd.select(F.col("grp").alias(x), F.col("k").alias(f"k_{x}"))
    met = materialize(met.join(many("g"), "g").join(many("h"), "h"), "grouppairs")
    few = F.col("k_g") * F.col("k_h") <= DIRECT_PAIRS
    side = lambda g, u: members.select(F.col("grp").alias(g), F.col("unit").alias(u))
    direct = met.filter(few).join(side("g", "x"), "g").join(side("h", "y"), "h").select("x", "y")

    # Lists: documents with a frequent prefix shingle, members of one group, members of two large groups.
    distinct = full.dropDuplicates(["unit"])
    hot = distinct.select("unit", "n", "cold", F.posexplode(F.slice("prefix", F.col("cold") + 1, F.size("prefix"))).alias("at", "s"))
    hot = hot.select(F.xxhash64("s", F.lit("s")).alias("list"), "unit", "n", (F.col("at") + F.col("cold")).alias("pos"))
    alike = members.join(crowd.filter("k > 1"), "grp").select(F.xxhash64("grp", F.lit("g")).alias("list"), "unit", "n", F.lit(0).alias("pos"))
    big = met.filter(~few).select(F.xxhash64("g", "h").alias("list"), F.explode(F.array("g", "h")).alias("grp"))
    big = big.join(members, "grp").select("list", "unit", "n", F.lit(0).alias("pos"))
    lists = materialize(hot.union(alike).union(big), "lists")

    some = _links(direct.union(_star_pairs(lists).select("x", "y")), own, units)
    first = materialize(components(some, "x", "y"), "labels")
    more = _links(_rest_pairs(lists, first).select("x", "y"), own, units)
    links = materialize(some.union(more), "links")
    found = materialize(components(links, "x", "y"), "labels")

    degree = links.select(F.col("x").alias("u")).union(links.select("y")).groupBy("u").agg(F.count("*").alias("n_links"))
    # Sets without a link are their own component; only linked ones have rows here.
    named = materialize(found.join(degree, found.node == degree.u, "left").select("node", "component", "n_links"), "named")
    rows = table.select("doc_id", "rep", "n", "unit").join(named, (F.col("unit") == named.node) & (F.col("n") > 0), "left")
    rows = rows.select("doc_id", "rep", "n", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "unit").alias("comp"))
    rows = materialize(rows, "resolved")
    release(table, units, met, lists, some, first, more, links, found, named)
    return rows


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, n_links, component_id), a row for each row of ``docs``.

    Two documents link when they share at least 75 % of the union of their five-word shingles. ``component_id`` is the
    smallest ``doc_id`` that links reach. ``n_links`` counts the document's verified links to different sets that were
    needed to find the components (not all that exist).

    A null, empty or blank text has no shingles and links with nothing. Fewer than five words are one shingle. Repeated
    rows are equal sets and share a component. A null ``doc_id`` stays null and is ignored when the smallest is sought (a
    component without any id has a null ``component_id``). An empty table gives an empty table.
    """
    rows = _resolved(docs, doc_id, text)
    least = rows.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")).filter("k > 1")
    least = materialize(least.select(F.col("comp").alias("c"), "least"), "least")
    out = rows.join(least, (F.col("comp") == F.col("c")) & (F.col("n") > 0), "left")
    return out.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.col("n_links").cast("long").alias("n_links"),
        F.coalesce("least", "doc_id").alias("component_id"),
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: the smallest id, nulls last, equal ids by a hash of the text.

    Rows without a word are linked with nothing and all stay.
    """
    rows = _resolved(docs, doc_id, text).filter("n > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rep")).alias("k")
    keep = rows.groupBy("comp").agg(first).select(F.col("k.doc_id").alias("k_id"), F.col("k.rep").alias("k_rep"))
    keep = materialize(keep, "keep")
    own_id, own_rep = fresh(docs, "_id"), fresh(docs, "_rep")
    keyed = docs.withColumns({own_id: F.col(f"`{doc_id}`").cast("long"), own_rep: F.xxhash64(F.col(f"`{text}`"))})
    has_word = F.coalesce(F.col(f"`{text}`").rlike(WORD), F.lit(False))
    kept = keyed.filter(has_word).join(keep, F.col(own_id).eqNullSafe(F.col("k_id")) & (F.col(own_rep) == F.col("k_rep")), "left_semi")
    kept = kept.dropDuplicates([own_id, own_rep])
    return kept.union(keyed.filter(~has_word)).drop(own_id, own_rep)

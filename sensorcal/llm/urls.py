"""URL verdicts by rules and, where no rule fits, by trust spread over the graph of hosts.

Hosts are nodes. An edge leads from a host to every host it links to (absolute links in its pages) and, both ways, between
a host and the domain above it. Trust starts at hosts with pages that rules allow and follows the edges (personalised
PageRank); distrust starts at hosts with blocked pages and follows the edges backwards: who links to blocked hosts, or
shares their domain, is distrusted. A host is blocked if its distrust outweighs its trust.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialize

#: (host, path, verdict); a rule holds for the host and its subdomains where the path starts like this.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DAMPING = 0.85
#: Rounds go on until at most this share of all trust (and distrust) could still move; each round leaves ``DAMPING`` of it.
RESIDUAL = 0.01
ROUNDS = math.ceil(math.log(RESIDUAL) / math.log(DAMPING))
#: A host is blocked if its distrust is above this multiple of its trust.
DISTRUST_RATIO = 1.0
#: Scores that differ by less than this part of themselves are equal: sums of the same numbers in another order.
SAME = 1e-9
#: Rounds between two written tables.
WRITE_EVERY = 6


def after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. The rules are a parameter and become one expression."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, weight) between different hosts: number of links, and 1 between a host and the domain above it."""
    links = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)\b(?:href|src|action)\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)"""), F.lit(1))
    absolute = F.transform(links, lambda u: host_of(F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u)))
    linked = pages.select(F.col("host").alias("src"), F.explode(absolute).alias("dst")).filter("src <> '' AND dst <> '' AND src <> dst")
    # Written first: the pages are read once, though the hosts of the links are needed too.
    linked = materialize(linked.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")), "links")
    known = pages.select("host").union(linked.select("dst")).distinct().filter("host <> ''")
    up = known.filter(F.size(F.split("host", r"\.")) > 2).select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]*\.(.*)$", 1).alias("dst"), F.lit(1.0).alias("weight"))
    both = up.distinct()
    return linked.union(both).union(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, score) after so many rounds from ``seeds`` (kind, host, score) along ``edges`` (kind, src, dst, share).

    What a host without edges would hand on stays with it. Sums are partial aggregates; rows are one per kind and host.
    """
    rank = seeds
    for k in range(1, rounds + 1):
        moved = rank.join(edges, (rank.kind == edges.ekind) & (rank.host == edges.src), "left")
        moved = moved.select("kind", F.coalesce("dst", "host").alias("host"), (F.col("score") * damping * F.coalesce("share", F.lit(1.0))).alias("score"))
        start = seeds.select("kind", "host", (F.col("score") * (1 - damping)).alias("score"))
        rank = moved.union(start).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if k % WRITE_EVERY == 0 or k == rounds:
            rank = materialize(rank, "ranks")
    return rank


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", html: str = "html", id_: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), a row for each row of ``pages``.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed. A null or empty html, and a
    page without a host, has no links. A host that neither trust nor distrust reaches is allowed. Repeated rows are judged alike, each link of
    theirs counts. Without any seed all scores are 0. An empty table gives an empty table.
    """
    u = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    known = pages.select(F.col(f"`{id_}`").alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"), F.col(f"`{html}`").alias("html"))
    ruled = known.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    judged = ruled.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("by_rule"))

    kinds = F.when(F.col("by_rule") == "allow", "trust").when(F.col("by_rule") == "block", "distrust")
    seeds = judged.filter("by_rule IS NOT NULL AND host <> ''").groupBy(kinds.alias("kind"), "host").agg(F.count("*").alias("n"))
    total = seeds.groupBy("kind").agg(F.sum("n").alias("all")).withColumnRenamed("kind", "k")
    seeds = materialize(seeds.join(total, F.col("kind") == F.col("k")).select("kind", "host", (F.col("n") / F.col("all")).alias("score")), "seeds")

    edges = materialize(host_edges(known, "html"), "edges")
    ways = edges.select(F.lit("trust").alias("ekind"), "src", "dst", "weight").union(edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), "weight"))
    out = ways.groupBy(F.col("ekind").alias("k"), F.col("src").alias("s")).agg(F.sum("weight").alias("all"))
    ways = ways.join(out, (F.col("ekind") == F.col("k")) & (F.col("src") == F.col("s")))
    ways = materialize(ways.select("ekind", "src", "dst", (F.col("weight") / F.col("all")).alias("share")), "shares")

    score = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    hosts = propagate(ways, seeds).groupBy(F.col("host").alias("_host")).agg(score("trust"), score("distrust"))
    # Written first: Spark sees its size, and moves the pages only if it is large.
    hosts = materialize(hosts, "hosts")
    met = judged.join(hosts, judged.host == hosts._host, "left")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    spread = F.when(distrust > trust * (DISTRUST_RATIO * (1 + SAME)), "block").otherwise("allow")
    return met.select("page_id", "host", "path", "rule", F.coalesce("by_rule", spread).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))

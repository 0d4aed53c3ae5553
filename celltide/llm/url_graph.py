"""URL verdicts by rules and, where none fits, by trust and distrust that spread over the host graph.

Hosts are nodes. A host points to every host that its pages link to, and to its parent domain and back, since
one owner stands behind both. Trust starts at the hosts of allowed pages and follows the edges as a personalised
PageRank; distrust starts at the hosts of blocked pages and follows them backwards, to those who point at
them. A page without a rule gets the verdict of its host: block where distrust outweighs trust.

All of it is native: pages shrink to host edges by one aggregation, each turn of the ranks is one join and one
aggregation over hosts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from celltide.llm.text import whole
from celltide.runtime import checkpoint

#: Share of a rank that follows the edges, turns, turns between two stored tables, least share of trust to allow.
DAMPING, TURNS, STORED_EVERY, LEAST_TRUST = 0.85, 20, 5, 0.5
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.regexp_extract(whole(url), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(whole(url), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (``verdict, host, path``) of a written list and its verdict; null where none fits.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(start))
        name, verdict = F.when(fits, at + start).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, share) of the host graph from ``pages`` (host, html): the shares of a host's edges add up to one.

    A page counts once for each host it links to. Links to the own host are no edges.
    """
    targets = F.array_distinct(F.transform(F.regexp_extract_all(whole(F.col("html")), F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER)))
    links = pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    links = checkpoint(links.filter("src <> dst AND src <> '' AND dst <> ''"))
    hosts = pages.select("host").unionByName(links.select(F.col("dst").alias("host"))).filter("host <> ''").distinct()
    # every domain above a host down to two labels: a.b.c.d gives (a.b.c.d, b.c.d) and (b.c.d, c.d)
    parts = F.split("host", r"\.")
    suffix = lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    steps = F.when(F.size(parts) > 2, F.transform(F.sequence(F.lit(1), F.size(parts) - 2), lambda i: F.struct(suffix(i).alias("src"), suffix(i + 1).alias("dst"))))
    kin = hosts.select(F.explode(steps).alias("e")).select("e.src", "e.dst").distinct()
    kin = kin.unionByName(kin.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("n", F.lit(1).cast("long"))
    edges = checkpoint(links.unionByName(kin).groupBy("src", "dst").agg(F.sum("n").alias("n")))
    return edges.join(edges.groupBy("src").agg(F.sum("n").alias("all")), "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))


def spread(edges: DataFrame, seeds: DataFrame, turns: int = TURNS) -> DataFrame:
    """(kind, host, score): personalised PageRank of each kind of ``seeds`` (kind, host, score) over ``edges`` (kind, src, dst, share)."""
    seeds, edges = checkpoint(seeds), checkpoint(edges)
    edges = edges.withColumnRenamed("kind", "_kind")
    start = seeds.withColumn("score", F.col("score") * (1 - DAMPING))
    ranks = seeds
    for turn in range(1, turns + 1):
        passed = ranks.join(edges, (F.col("host") == F.col("src")) & (F.col("kind") == F.col("_kind"))).select(
            "kind", F.col("dst").alias("host"), (DAMPING * F.col("score") * F.col("share")).alias("score"),
        )
        ranks = passed.unionByName(start).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if turn % STORED_EVERY == 0 or turn == turns:
            ranks = checkpoint(ranks)
    return ranks


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], least_trust: float = LEAST_TRUST) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust``.

    Without a rule, the verdict is 'allow' if trust is at least ``least_trust`` of trust and distrust together or
    if the host has neither, else 'block'. Pages without a host have neither. New names replace columns of the same name.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "trust", "distrust")
    pages = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = pages.withColumn("rule", name).withColumn("_ruled", verdict)
    known = checkpoint(ruled.groupBy("host").agg(
        F.count_if(F.col("_ruled") == "allow").alias("allow"), F.count_if(F.col("_ruled") == "block").alias("block"),
    ))
    seeds = [
        known.filter(F.col(of) > 0).select(F.lit(kind).alias("kind"), "host", F.col(of).cast("double").alias("n"))
        for kind, of in (("trust", "allow"), ("distrust", "block"))
    ]
    seeds = reduce(DataFrame.unionByName, seeds).filter("host <> ''")
    total = known.agg(F.sum("allow").alias("trust"), F.sum("block").alias("distrust")).first()
    all_of = F.when(F.col("kind") == "trust", F.lit(float(total["trust"] or 1))).otherwise(F.lit(float(total["distrust"] or 1)))
    seeds = seeds.select("kind", "host", (F.col("n") / all_of).alias("score"))
    forward = checkpoint(host_edges(pages.select("host", "html")))
    # distrust walks backwards: a host hands its distrust to those that point at it
    back = forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "share")
    shared = back.join(back.groupBy("src").agg(F.sum("share").alias("all")), "src").select("src", "dst", (F.col("share") / F.col("all")).alias("share"))
    edges = forward.withColumn("kind", F.lit("trust")).unionByName(shared.withColumn("kind", F.lit("distrust")))
    ranks = spread(edges, seeds).groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("score"))).alias("distrust"),
    )
    joined = ruled.join(ranks.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"), "left").drop("_host").fillna(0.0, ["trust", "distrust"])
    both = F.col("trust") + F.col("distrust")
    by_host = F.when((both == 0) | (F.col("trust") >= least_trust * both), "allow").otherwise("block")
    return joined.withColumn("verdict", F.coalesce("_ruled", by_host)).drop("_ruled")

"""URL filter: rules first, then trust and distrust propagated over host links.

A rule (host, path prefix, verdict) fits its host and all subdomains when the
path starts with its prefix; the longest rule wins. Pages that no rule judges
are judged by their host. Every host sends out three masses by personalised
PageRank over the weighted host edges: trust, from its pages that rules allow,
and neutral mass, from its unjudged pages, follow links; distrust, from its
blocked pages, runs against them, so hosts that link to blocked ones receive
it. A host is blocked when distrust is more than ``threshold`` of its mass.

DataFrame and SQL functions only. Hosts are pre-aggregated before any join. The
walk goes on until it has settled; each round is written to the shared folder
and dropped once the next one is; only three sums reach the driver.

Null addresses, and addresses without ``://``, have an empty host and path and
are allowed. Pages without html have no links; repeated rows count each. An
empty table gives an empty result. Extra columns are ignored.
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .address import ascii_lower, host_and_path, salted_join
from .common import drop_stored, hot_join, stored

#: A link's host: after :// (or a leading //) in href or src.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""
MASSES = ("trust", "neutral", "distrust")


def rule_struct(rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null. ``rules``:
    (host, path, verdict), a short list that becomes one expression."""
    made = None
    for host, path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        value = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        made = F.when(fits, value) if made is None else made.when(fits, value)
    return made if made is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, counted."""
    links = pages.where("host <> '' AND html IS NOT NULL").select(
        F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    return (links.withColumn("dst", ascii_lower(F.col("dst"))).where("src <> dst")
            .groupBy("src", "dst").agg(F.count("*").alias("weight")))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """hosts (host, trust_seed, neutral_seed, distrust_seed) plus the masses
    after the walk, to within ``tolerance`` of all mass. Mass of hosts without
    links returns to its seeds. A round shrinks every difference by ``damping``
    at least, which bounds the rounds; more is an error."""
    out_w = edges.groupBy("src").agg(F.sum("weight").alias("total"), F.count("*").alias("n_out"))
    in_w = edges.groupBy("dst").agg(F.sum("weight").alias("total"), F.count("*").alias("n_in"))
    out_w, in_w = stored(out_w, "url-out"), stored(in_w, "url-in")
    forward = stored(hot_join(edges, out_w, ["src"], "n_out").selectExpr("src", "dst", "weight / total AS share"), "url-forward")
    backward = stored(hot_join(edges, in_w, ["dst"], "n_in").selectExpr("src", "dst", "weight / total AS share"), "url-backward")
    seeds = [f"{m}_seed" for m in MASSES]
    hosts = hosts.join(out_w.select(F.col("src").alias("host"), "n_out"), "host", "left").join(
        in_w.select(F.col("dst").alias("host"), "n_in"), "host", "left").na.fill(0, ["n_out", "n_in"])
    links = ["n_out", "n_in"]
    cur = hosts.select("host", *seeds, *links, *[F.col(f"{m}_seed").cast("double").alias(m) for m in MASSES])
    whole = cur.agg(*[F.coalesce(F.sum(s), F.lit(0)).cast("double").alias(s) for s in seeds]).first()
    n_edges, before = edges.count(), None
    for _ in range(math.ceil(math.log(tolerance / 2) / math.log(damping)) + 1):
        # hubs hold a large share of all links: their masses are broadcast, the others' are shuffled
        ahead = hot_join(forward, cur.where("n_out > 0").select(F.col("host").alias("src"), "n_out", "trust", "neutral"),
                         ["src"], "n_out", total=n_edges).groupBy("dst").agg(
            F.sum(F.expr("trust * share")).alias("in_trust"), F.sum(F.expr("neutral * share")).alias("in_neutral")
            ).withColumnRenamed("dst", "host")
        back = hot_join(backward, cur.where("n_in > 0").select(F.col("host").alias("dst"), "n_in", "distrust"),
                        ["dst"], "n_in", total=n_edges).groupBy("src").agg(
            F.sum(F.expr("distrust * share")).alias("in_distrust")).withColumnRenamed("src", "host")
        met = stored(cur.join(ahead, "host", "left").join(back, "host", "left").na.fill(
            0.0, [f"in_{m}" for m in MASSES]), "url-round")
        if before is not None:
            drop_stored(before)
        came = met.agg(*[F.coalesce(F.sum(f"in_{m}"), F.lit(0.0)).alias(m) for m in MASSES]).first()

        def mass(m: str) -> Column:
            total = whole[f"{m}_seed"]
            back_to_seed = (total - came[m]) / total if total else 0.0
            return ((1 - damping) * F.col(f"{m}_seed")
                    + damping * (F.col(f"in_{m}") + back_to_seed * F.col(f"{m}_seed")))

        change = met.agg(F.coalesce(F.sum(reduce(Column.__add__, [F.abs(mass(m) - F.col(m)) for m in MASSES])),
                                    F.lit(0.0))).first()[0]
        cur, before = met.select("host", *seeds, *links, *[mass(m).alias(m) for m in MASSES]), met
        if change <= tolerance * max(sum(whole), 1.0):
            return cur.drop(*links)
    raise RuntimeError(f"host masses did not settle to {tolerance}")


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, distrust): distrust is the share of
    the host's mass that comes from blocked pages (null without any mass)."""
    host, path = host_and_path("url")
    parsed = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"), "html")
    judged = parsed.withColumn("hit", rule_struct(rules))
    edges = stored(host_edges(parsed), "url-edges")
    known = judged.where("host <> ''").groupBy("host").agg(
        F.count_if(F.col("hit.verdict") == "allow").alias("trust_seed"),
        F.count_if(F.col("hit").isNull()).alias("neutral_seed"),
        F.count_if(F.col("hit.verdict") == "block").alias("distrust_seed"))
    linked = edges.selectExpr("dst AS host", "0L AS trust_seed", "0L AS neutral_seed", "0L AS distrust_seed").distinct()
    hosts = stored(known.union(linked).groupBy("host").agg(
        *[F.sum(f"{m}_seed").alias(f"{m}_seed") for m in MASSES]), "url-hosts")
    masses = propagate(hosts, edges).select("host", F.expr(
        "distrust / nullif(trust + neutral + distrust, 0)").alias("distrust"))
    rows = judged.select("page_id", "host", "path", "hit")
    out = salted_join(rows, stored(masses, "url-masses"), "host", F.struct("page_id", "path"))
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(
        F.col("hit.verdict"), F.when(F.col("distrust") > threshold, "block").otherwise("allow")).alias("verdict"),
        "distrust")

"""Web pages judged by host rules and, where no rule fits, by trust and distrust propagated over the host link graph.

Links in the pages' HTML are counted per pair of hosts, map-side. Trust is a personalised PageRank that restarts at hosts with pages an
allow rule fits and follows links; distrust restarts at hosts with pages a block rule fits and follows links backwards, so a host
that links to blocked hosts inherits distrust. A host is blocked when distrust has at least ``threshold`` of both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkframe.llm.common import settle

DAMPING, ROUNDS, SETTLE_EVERY, THRESHOLD = 0.85, 12, 4, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]*)"""


@dataclass(frozen=True)
class Rule:
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def parse(pages: DataFrame) -> DataFrame:
    """``pages`` with ``host`` and ``path`` (replacing columns of these names); empty for null urls and urls without ``://``."""
    url = F.coalesce("url", F.lit(""))
    return pages.withColumns({"host": F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), "path": F.regexp_extract(url, URL, 2)})


def ruled(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``rule`` and ``_ruled`` (its verdict); the longest rule that fits wins."""
    host, path = F.col("host"), F.col("path")
    name = said = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # later ones are longer and go outside
        name = F.when(r.fits(host, path), F.lit(r.text)).otherwise(name)
        said = F.when(r.fits(host, path), F.lit(r.verdict)).otherwise(said)
    return pages.withColumns({"rule": name, "_ruled": said})


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links): links between different hosts."""
    out = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    out = out.withColumn("dst", F.translate("dst", UPPER, LOWER)).filter("dst <> '' and dst <> src")
    return out.groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) of every host. ``seeds``: host, good, bad (restart shares). Rounds are settled every few steps."""
    edges = settle(edges, "host_links")
    out = edges.groupBy("src").agg(F.sum("links").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("into"))
    share = settle(edges.join(out, "src").join(into, "dst").select(
        "src", "dst", (F.col("links") / F.col("out")).alias("ahead"), (F.col("links") / F.col("into")).alias("back")), "host_shares")
    hosts = share.select(F.col("src").alias("host")).union(share.select(F.col("dst").alias("host"))).distinct()
    start = settle(hosts.join(seeds, "host", "full_outer").na.fill(0.0, ["good", "bad"]), "host_seeds")
    now = start.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    for turn in range(rounds):
        ahead = share.join(now, share["src"] == now["host"]).select(
            F.col("dst").alias("host"), (F.col("trust") * F.col("ahead")).alias("t"), F.lit(0.0).alias("d"))
        back = share.join(now, share["dst"] == now["host"]).select(
            F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("back")).alias("d"))
        come = ahead.union(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        now = start.join(come, "host", "left").select("host", *[
            ((1 - damping) * F.col(seed) + damping * F.coalesce(c, F.lit(0.0))).alias(to)
            for seed, c, to in (("good", "t", "trust"), ("bad", "d", "distrust"))])
        if turn % SETTLE_EVERY == SETTLE_EVERY - 1 or turn == rounds - 1:
            now = settle(now, "host_ranks")
    return now


def judge(pages: DataFrame, rules: list[Rule] = RULES, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    The verdict is the rule's; without a rule it is ``block`` where distrust makes up ``threshold`` of the host's trust and distrust, else
    ``allow`` (also for pages without a host and hosts the graph says nothing about). Null HTML has no links. Repeated pages are
    judged each for itself; an empty table gives an empty result. Columns other than page_id, url and html are not read. Runs
    jobs while it is built.
    """
    known = ruled(parse(pages.select("page_id", "url", "html")), rules)
    seen = known.filter("host <> ''").groupBy("host").agg(
        F.count(F.when(F.col("_ruled") == "allow", 1)).alias("g"), F.count(F.when(F.col("_ruled") == "block", 1)).alias("b")).filter("g + b > 0")
    seen = settle(seen, "host_rules")
    good, bad = seen.agg(F.sum("g"), F.sum("b")).first()
    seeds = seen.select("host", (F.col("g") / F.lit(float(good or 1))).alias("good"), (F.col("b") / F.lit(float(bad or 1))).alias("bad"))
    ranks = propagate(host_edges(known), seeds, rounds)
    out = known.select("page_id", "host", "path", "rule", "_ruled").join(ranks, "host", "left").na.fill(0.0, ["trust", "distrust"])
    doubt = (F.col("distrust") > 0) & (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust")))
    verdict = F.coalesce("_ruled", F.when(doubt, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")

"""URL filters: rules first, then trust and distrust that spread over links between hosts.

Pages that the rules decide make their hosts seeds: a host's trust seed is the share of its pages
that rules allow, its distrust seed the share that rules block. Personalised PageRank carries trust
along links from trusted hosts and, over the same links turned round, distrust to hosts that link to
blocked ones. A host is blocked when its distrust exceeds its trust by a threshold; pages without a
rule of their own take their host's verdict.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut_lineage, small_side

#: (verdict, host, path) of a rule; it fits the host and its subdomains where the url's path starts with the path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A score table of at most so many hosts is broadcast.
BROADCAST_ROWS = 200_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for a null or one without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    empty = lambda c: F.coalesce(c, F.lit(""))
    return empty(F.translate(host, UPPER, LOWER)), empty(path)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written as host and path, and its verdict; nulls where none fits."""
    rule = verdict = None
    for what, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        rule = F.when(fits, rule_host + rule_path) if rule is None else rule.when(fits, rule_host + rule_path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def host_links(pages: DataFrame) -> DataFrame:
    """``src``, ``dst`` and ``weight`` of links between different hosts; a host's weights sum to 1.

    Links are counted per pair of hosts before the shuffle. Relative links stay on their host and
    so carry nothing.
    """
    host, _ = split_url(F.col("url"))
    targets = F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*((?:https?:)?//[^\s\"'>]+)"), 1)
    counted = (
        pages.select(host.alias("src"), F.explode(targets).alias("to"))
        .select("src", F.translate(F.regexp_extract("to", r"//([^/?#]*)", 1), UPPER, LOWER).alias("dst"))
        .where("src <> '' AND dst <> '' AND src <> dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return cut_lineage(counted)


def spread(edges: DataFrame, seeds: DataFrame, seed: str, damping: float, rounds: int, tolerance: float) -> DataFrame:
    """``host`` and ``score``: the personalised PageRank of ``seeds`` over ``edges`` (src, dst, n).

    Scores restart at the seeds with probability 1 - damping; what reaches a host without links goes
    no further. Rounds end when no score moves by more than ``tolerance``; a warning tells if ``rounds`` were too few.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    weighted = edges.join(small_side(cut_lineage(out), BROADCAST_ROWS), "src").select(
        "src", "dst", (F.col("n") / F.col("total")).alias("w")
    )
    weighted = cut_lineage(weighted)
    start = seeds.where(F.col(seed) > 0).select("host", ((1 - damping) * F.col(seed)).alias("score"))
    start = cut_lineage(start)
    if weighted.isEmpty() or start.isEmpty():
        return start
    now = start
    for _ in range(rounds):
        moved = (
            weighted.join(small_side(now, BROADCAST_ROWS), weighted["src"] == now["host"])
            .groupBy(F.col("dst").alias("host"))
            .agg((damping * F.sum(F.col("w") * F.col("score"))).alias("score"))
        )
        new = cut_lineage(moved.union(start).groupBy("host").agg(F.sum("score").alias("score")))
        change = (
            new.withColumnRenamed("score", "b").join(now, "host", "full")
            .agg(F.max(F.abs(F.coalesce("b", F.lit(0.0)) - F.coalesce("score", F.lit(0.0))))).first()[0]
        )
        now = new
        if change is None or change <= tolerance:
            break
    else:
        warnings.warn(f"scores still moved by {change} after {rounds} rounds", stacklevel=2)
    return now


def judge_urls(
    pages: DataFrame, rules=RULES, damping: float = 0.85, rounds: int = 30, tolerance: float = 1e-6, threshold: float = 0.5
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust`` of every row of ``pages``.

    Pages without a rule are blocked where the host's distrust exceeds its trust by more than
    ``threshold`` of a full seed's restart; hosts of which nothing is known are allowed. Null urls have
    an empty host, of which nothing is known. Repeated rows each get a row; an empty table gives none.
    """
    host, path = split_url(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("*", rule.alias("rule"), verdict.alias("ruled"))
    seeds = cut_lineage(
        parsed.where("host <> ''")
        .groupBy("host")
        .agg(
            F.avg(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("good"),
            F.avg(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("bad"),
        )
    )
    links = host_links(pages)
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    trust = spread(links, seeds, "good", damping, rounds, tolerance).withColumnRenamed("score", "trust")
    distrust = spread(back, seeds, "bad", damping, rounds, tolerance).withColumnRenamed("score", "distrust")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    scores = cut_lineage(trust.join(distrust, "host", "full").select(F.col("host").alias("__host"), zero("trust"), zero("distrust")))
    judged = parsed.join(small_side(scores, BROADCAST_ROWS), parsed["host"] == scores["__host"], "left")
    bad = zero("distrust") - zero("trust") > threshold * (1 - damping)
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        zero("trust"), zero("distrust"),
    )

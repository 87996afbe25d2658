"""URL filters: rules by host and path, and for the other pages trust and distrust spread over the graph of hosts.

A rule (host, path, action) fits the pages of its host and of all subdomains
whose path starts with its own; of several the longest wins.  Pages that rules
allow or block are the seeds: each gives its host `UNIT` of trust or of distrust.
Trust follows the links from host to host (personalised PageRank: of what a host
holds, `DAMPING` goes on, shared by the number of pages that link to each other
host); distrust follows them backwards, from a blocked host to those that link
to it.  Ranks are whole numbers, so that sums don't depend on their order.
Rounds end when nothing changes, or after `ROUNDS`.  A host is blocked where
distrust has at least the share `BLOCK_AT` of both; hosts that neither reaches
are allowed.

Links are taken from the href of each page's anchors where they name a host;
links within a host don't count, and a page counts once for each host that it
links to.  Edges are counted before they are shuffled; a round joins the ranks
with the edges by host, and adds up what each task has before it is shuffled
again, so that a host with a third of all links is no single task's.

Defined cases: a null url, or one without "://", has an empty host and path; it
is no part of the graph, and without a rule the page is allowed.  A null or empty
html has no links; very long ones are read whole.  Repeated rows count as often
as they stand, and each has its verdict.  Rules of equal length: the smaller text
wins.  Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: a seed page's trust or distrust, what a host passes on, and the rounds at most
UNIT, DAMPING, ROUNDS = 1 << 20, 0.85, 30
#: the share of distrust from which a host is blocked
BLOCK_AT = 0.5
#: rules are part of the plan; blocked hosts up to this number, which is counted, are broadcast
MAX_RULES, BROADCAST_HOSTS = 1000, 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ANCHOR = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]+)"""
#: an href that names a host
FAR = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]+)"

Rule = tuple[str, str, str]


def _after(url: Column) -> Column:
    """What follows the first "://", or the empty text."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: Iterable[Rule]) -> tuple[Column, Column]:
    """The text and the action of the longest rule that fits, null where none does."""
    rules = sorted(set(rules), key=lambda r: (-len(r[0] + r[1]), r[0] + r[1], r[2]))
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules are over {MAX_RULES}")
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in rules]
    text = [F.when(f, F.lit(h + p)) for f, (h, p, _) in zip(fits, rules, strict=True)]
    action = [F.when(f, F.lit(a)) for f, (_, _, a) in zip(fits, rules, strict=True)]
    null = F.lit(None).cast("string")
    return F.coalesce(*text, null), F.coalesce(*action, null)


def ruled(pages: DataFrame, rules: Iterable[Rule], url: str = "url", keep: Iterable[str] = ("page_id",)) -> DataFrame:
    """The kept columns with host, path, rule and action."""
    rows = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, action = matched(F.col("host"), F.col("path"), rules)
    return rows.withColumns({"rule": rule, "action": action})


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): how many pages of a host link to another."""
    links = F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), 1), lambda x: F.translate(F.regexp_extract(x, FAR, 1), UPPER, LOWER))
    far = F.array_distinct(F.filter(links, lambda x: x != ""))
    rows = pages.select(host_of(F.col(url)).alias("src"), F.explode(far).alias("dst"))
    return rows.filter("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, kind, rank): trust ('t') along the edges (src, dst, n) and distrust ('d') against them, from the seeds (host, kind, seed)."""
    edges = stored(edges)
    ranks = stored(seeds.select("host", "kind", F.col("seed").alias("rank")))
    if edges.isEmpty():
        return ranks
    out, into = edges.groupBy("src").agg(F.sum("n").alias("total")), edges.groupBy("dst").agg(F.sum("n").alias("total"))
    share = (F.lit(DAMPING) * F.col("n") / F.col("total")).alias("share")
    steps = stored(
        edges.join(out, "src").select(F.col("src").alias("host"), F.lit("t").alias("kind"), F.col("dst").alias("to"), share)
        .unionByName(edges.join(into, "dst").select(F.col("dst").alias("host"), F.lit("d").alias("kind"), F.col("src").alias("to"), share))
    )
    given, seen = ranks, None
    for _ in range(rounds):
        moved = ranks.join(steps, ["host", "kind"]).select(F.col("to").alias("host"), "kind", F.floor(F.col("rank") * F.col("share")).alias("rank"))
        ranks = stored(moved.filter("rank > 0").unionByName(given).groupBy("host", "kind").agg(F.sum("rank").alias("rank")))
        state = tuple(ranks.agg(F.count("*"), F.sum(F.xxhash64("host", "kind", "rank").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return ranks


def blocked_hosts(ranks: DataFrame, block_at: float = BLOCK_AT) -> DataFrame:
    """(host, trust, distrust): the hosts with at least that share of distrust."""
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0)).alias({"t": "trust", "d": "distrust"}[k])
    both = ranks.groupBy("host").agg(of("t"), of("d"))
    return both.filter((F.col("distrust") > 0) & (F.col("distrust") >= F.lit(block_at) * (F.col("trust") + F.col("distrust"))))


def judge(pages: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page (page_id, url, html)."""
    rows = ruled(pages, rules := list(rules))
    kind = F.when(F.col("action") == "allow", "t").when(F.col("action") == "block", "d")
    seeds = rows.filter("action IS NOT NULL AND host <> ''").groupBy("host", kind.alias("kind")).agg((F.count("*") * UNIT).alias("seed"))
    bad = stored(blocked_hosts(spread(host_edges(pages), seeds)).select("host", F.lit("block").alias("spread")))
    side = F.broadcast(bad) if bad.count() <= BROADCAST_HOSTS else bad
    return rows.join(side, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("action", "spread", F.lit("allow")).alias("verdict"))

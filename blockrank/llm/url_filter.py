"""Op 6: URL filter by rules and by link-graph propagation (DataFrame functions only).

A page's rule is the longest rule whose host is the page's host or one of its parent domains and whose
path begins the page's path. Pages without a rule get the verdict of their host: personalised PageRank
carries trust along host links from hosts whose pages are mostly allowed by rule, and distrust against
the links from hosts whose pages are mostly blocked; a host is blocked when its distrust reaches
`threshold` and exceeds its trust.

Defined results: a null url, or one without `://`, has an empty host and path, no rule and the verdict
`allow`; null html has no links; equal rows are judged alike, each on its own; an empty table gives an
empty result; other columns of the input are not read. Links from a host to itself do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, read_table
from .components import hot_join, hot_keys

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
#: (verdict, host, path): the rules of the contract.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
MAX_RULES = 500
DAMPING, ROUNDS, TOLERANCE, THRESHOLD, SALTS = 0.85, 20, 1e-6, 0.075, 16


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules, value) -> Column:
    """value(verdict, host, path) of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; a chain of conditions holds at most {MAX_RULES}")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    return F.coalesce(*[F.when(f, F.lit(value(*r))) for f, r in zip(fits, ordered, strict=True)]) if ordered else F.lit(None).cast("string")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts and their share of src's links."""
    links = pages.filter(F.col("html").contains("//")).select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href"))
    dst = host_of(F.when(F.col("href").startswith("//"), F.concat(F.lit("x:"), "href")).otherwise(F.col("href")))
    edges = links.select("src", dst.alias("dst")).filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").count()
    out = edges.groupBy("src").agg(F.sum("count").alias("out"))
    return edges.join(out, "src").select("src", "dst", (F.col("count") / F.col("out")).alias("weight"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): nodes(host, seed), edges(src, dst, weight), a written table. Each round is checkpointed; the links of a hub
    are dealt over several tasks."""
    rank = nodes.select("host", "seed", ((1 - damping) * F.col("seed")).alias("rank"))
    hubs = hot_keys(edges, "src")
    for _ in range(rounds):
        given = hot_join(edges, rank.select(F.col("host").alias("src"), "rank"), "src", hot=hubs).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("weight")).alias("given"))
        moved = rank.join(given, "host", "left").select("host", "seed", F.col("rank").alias("was"), ((1 - damping) * F.col("seed") + damping * F.coalesce("given", F.lit(0.0))).alias("rank")).checkpoint()
        delta = moved.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0
        rank = moved.drop("was")
        if delta < tolerance:
            break
    return rank.select("host", "rank")


def judge_hosts(hosts: DataFrame, edges: DataFrame, threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """hosts(host, n, allowed, blocked) -> (host, trust, distrust, verdict)."""
    every = hosts.select("host", (F.col("allowed") / F.col("n")).alias("a"), (F.col("blocked") / F.col("n")).alias("b"))
    ends = edges.select(F.col("src").alias("host")).union(edges.select(F.col("dst").alias("host"))).distinct()
    nodes = materialise(every.join(ends, "host", "full_outer").select("host", F.when(F.col("a") > F.coalesce("b", F.lit(0.0)), F.col("a")).otherwise(0.0).alias("good"), F.when(F.col("b") > F.coalesce("a", F.lit(0.0)), F.col("b")).otherwise(0.0).alias("bad")), "url-hosts")
    trust = pagerank(nodes.select("host", F.col("good").alias("seed")), edges, damping, rounds)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    into = back.groupBy("src").agg(F.sum("weight").alias("all"))
    back = materialise(hot_join(materialise(back, "url-back"), into, "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("weight")), "url-back")
    distrust = pagerank(nodes.select("host", F.col("bad").alias("seed")), back, damping, rounds)
    blocked = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host").withColumn("verdict", F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of pages."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    seen = pages.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    h, p = F.col("host"), F.col("path")
    # the verdict rides on the rule's string, so that one chain of conditions finds both
    ruled = seen.withColumn("hit", rule_column(h, p, rules, lambda v, rh, rp: f"{v} {rh}{rp}"))
    ruled = ruled.select("page_id", "host", "path", F.substring_index("hit", " ", 1).alias("by_rule"), F.expr("substring(hit, instr(hit, ' ') + 1)").alias("rule"))
    counts = ruled.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("by_rule") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("blocked")).filter("host <> ''")
    edges = materialise(host_edges(pages), "url-edges")
    verdicts = judge_hosts(counts, edges, threshold)
    # one host may own a third of all pages: its verdict is repeated under each salt
    salted = verdicts.select("host", "trust", "distrust", F.col("verdict").alias("by_host"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    joined = ruled.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op6_url_filter(spark, sf_dir) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))

"""URL filtering by rules and by trust that spreads over the host graph.

Hosts are linked by absolute links in their pages, also to hosts without pages here, and by a subdomain's tie to the
host above it.  Personalised PageRank starts from hosts with pages that a rule allows and follows links; distrust starts
from hosts with pages that a rule blocks and follows links backwards, to those who link there.  Both go on until they
have reached all hosts that they can reach and hardly change any more.  A page that no rule decides is blocked if its
host's distrust outweighs its trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, load

#: Rules of the production query, as (host and path, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Share that follows links, the total change of a round at which scores count as settled, and the multiple of its trust
#: from which a host's distrust blocks it; rounds from one written table to the next.
DAMPING, TOLERANCE, THRESHOLD, WRITTEN = 0.85, 1e-6, 1.0, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def decided(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does.  Rules are few: they become one expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, _, under = text.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + under))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, weight): links from host to host, counted, and half a link each way between a host and the one above
    it where both have pages.  Links within a host are left out."""
    target = F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']?(?:https?:)?//([^/\"'?#\s>]+)"), 1))
    links = pages.select("host", target.alias("to")).select(F.col("host").alias("src"), F.translate("to", UPPER, LOWER).alias("dst"))
    links = links.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    above = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+)$", 1).alias("dst")).where("dst <> ''")
    above = above.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").select("src", "dst", F.lit(0.5).alias("weight"))
    ties = above.unionByName(above.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return links.select("src", "dst", "weight").unionByName(ties).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, scratch: Scratch, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(walk, host, score) of the hosts that each walk reaches, its scores summing to 1.

    seeds: (walk, host, weight); edges: (walk, src, dst, weight).  Personalised PageRank: what hosts without links would
    pass on returns to the seeds, which only scales all scores, so it is made up for at the end.  It ends when a round
    changes all scores of a walk by less than `tolerance` in sum and reaches no new host.  Every few rounds are written
    to the shared folder.
    """
    total = seeds.groupBy("walk").agg(F.sum("weight").alias("total")).where("total > 0")
    start = scratch.keep(seeds.where("weight > 0").join(total, "walk").select("walk", "host", (F.col("weight") / F.col("total")).alias("start")), "start")
    out = edges.groupBy("walk", "src").agg(F.sum("weight").alias("out"))
    shares = scratch.keep(edges.join(out, ["walk", "src"]).select("walk", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("out")).alias("share")), "shares")
    ranks, reached = start.select("walk", "host", F.col("start").alias("score")), -1
    while True:
        for _ in range(WRITTEN):
            before = ranks
            moved = ranks.join(shares, ["walk", "host"]).select("walk", F.col("dst").alias("host"), (F.lit(damping) * F.col("score") * F.col("share")).alias("score"))
            returned = start.select("walk", "host", (F.lit(1 - damping) * F.col("start")).alias("score"))
            ranks = moved.unionByName(returned).groupBy("walk", "host").agg(F.sum("score").alias("score"))
        both = ranks.unionByName(before.select("walk", "host", (-F.col("score")).alias("score"))).groupBy("walk", "host")
        written = scratch.keep(both.agg(F.sum("score").alias("change"), F.sum(F.when(F.col("score") > 0, F.col("score"))).alias("score")), "ranks")
        now, change = written.agg(F.count("*"), F.coalesce(F.sum(F.abs("change")), F.lit(0.0))).first()
        if now == reached and change < tolerance:
            break
        ranks, reached = written.select("walk", "host", "score"), now
    whole = written.groupBy("walk").agg(F.sum("score").alias("whole"))
    return written.join(whole, "walk").select("walk", "host", (F.col("score") / F.col("whole")).alias("score"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A url that is null or has no `://` has an empty host and path and is judged as that host.  Null html has no links;
    urls and html of any length are read whole; null ids and repeated rows are judged each; an empty table gives no
    rows; other columns are ignored.  A host that neither walk reaches has no distrust and is allowed.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    at = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, verdict = decided(F.col("host"), F.col("path"), rules)
    hosts = scratch.keep(
        at.select("host", verdict.alias("says"))
        .groupBy("host")
        .agg(F.count(F.when(F.col("says") == "allow", 1)).cast("double").alias("allowed"), F.count(F.when(F.col("says") == "block", 1)).cast("double").alias("blocked")),
        "hosts",
    )
    edges = host_edges(at, hosts)
    edges = scratch.keep(
        edges.select(F.lit("trust").alias("walk"), "src", "dst", "weight").unionByName(edges.select(F.lit("distrust").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")),
        "edges",
    )
    seeds = hosts.select(F.lit("trust").alias("walk"), "host", F.col("allowed").alias("weight")).unionByName(hosts.select(F.lit("distrust").alias("walk"), "host", F.col("blocked").alias("weight")))
    walks = propagate(seeds, edges, scratch)
    of = lambda walk: F.coalesce(F.sum(F.when(F.col("walk") == walk, F.col("score"))), F.lit(0.0)).alias(walk)
    scores = scratch.keep(hosts.select("host").join(walks, "host", "left").groupBy("host").agg(of("trust"), of("distrust")), "scores")
    found = F.when(F.col("distrust") > threshold * F.col("trust"), F.lit("block")).otherwise(F.lit("allow"))
    return at.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("says")).join(scores, "host").select(
        "page_id", "host", "path", "rule", F.coalesce("says", found).alias("verdict"), "trust", "distrust"
    )


def op5_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "pages").select("page_id", "url", "html"))

"""URL filter: rules first, then trust and distrust spread over the links between hosts.

Trust is a personalised PageRank that starts from the hosts with pages allowed by a rule and
follows the links.  Distrust starts from the hosts with blocked pages and follows the links
backwards: who links to a bad host is suspect.  A page that no rule fits is judged by its
host's share of distrust.  Everything is DataFrame operations; pages are read once for their
urls and once for their links, and only distinct host edges are carried through the rounds.

Defined cases: a url that is null or has no ``://`` has empty host and path, fits no rule and
is allowed; a null page body has no links; links to unknown hosts count as hosts without
pages; repeated pages are judged one by one; no links at all leave trust and distrust on the
seeds; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlake.session import cut_lineage

#: (verdict, host, path) in any order; the longest rule that fits wins.
Rule = tuple[str, str, str]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links with a host of their own: absolute or protocol-relative.
LINK = r"""(?i)\b(?:href|src|action)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^"'/?#\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == F.lit(name)) | host.endswith("." + name)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct (src, dst, w) between different hosts; w is the share of src's links."""
    links = pages.select(host_of(F.col(url)).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where((F.col("src") != "") & (F.col("src") != F.col("dst")))
    return links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def _shares(edges: DataFrame, source: str, target: str) -> DataFrame:
    total = edges.groupBy(source).agg(F.sum("n").alias("total"))
    return edges.join(total, source).select(F.col(source).alias("src"), F.col(target).alias("dst"), (F.col("n") / F.col("total")).alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """(kind, host, score): for each ``kind`` of seed a PageRank personalised to its seeds.

    ``edges`` has (kind, src, dst, w), ``seeds`` (kind, host, seed) with seeds of a kind adding
    up to 1.  What sinks hold goes back to the seeds by being left out and rescaled at the end.
    Rounds end when no score changes by more than ``tolerance`` of itself, so every host that links
    reach has a score, however far it is, and the ratio of two small scores is as good as the scores."""
    if not 0 <= damping < 1:
        raise ValueError("rounds end only with a damping below 1")
    edges, seeds = cut_lineage(edges), cut_lineage(seeds)
    scores = seeds.withColumnRenamed("seed", "score")
    while True:
        passed = scores.join(edges.withColumnRenamed("src", "host"), ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("w")).alias("got"))
        after = seeds.join(passed, ["kind", "host"], "full").select(
            "kind", "host", (F.lit(1 - damping) * F.coalesce("seed", F.lit(0.0)) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("score")
        )
        # until now every row stems from a written table, so a lost executor costs one round
        was, scores = scores, cut_lineage(after)
        score, before = F.coalesce("score", F.lit(0.0)), F.coalesce("was", F.lit(0.0))
        # below the least of normal doubles scores are rounding
        moved = was.withColumnRenamed("score", "was").join(scores, ["kind", "host"], "full").where(F.abs(score - before) > F.lit(tolerance) * score + F.lit(1e-300))
        if moved.isEmpty():
            break
    total = scores.groupBy("kind").agg(F.sum("score").alias("total"))
    return scores.join(F.broadcast(total), "kind").select("kind", "host", F.when(F.col("total") > 0, F.col("score") / F.col("total")).otherwise(F.lit(0.0)).alias("score"))


def filter_urls(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", html: str = "html", block_above: float = 0.75) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every page.

    A page that no rule fits is blocked if distrust / (trust + distrust) of its host, each kind
    adding up to 1 over all hosts, is above ``block_above``; hosts that neither kind reaches are allowed."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    judged = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), matching_rule(host, path, rules).alias("m"))
    marked = judged.where(F.col("m").isNotNull() & (F.col("host") != "")).groupBy(F.col("m.verdict").alias("kind"), "host").agg(F.count("*").cast("double").alias("n"))
    of_kind = marked.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = marked.join(F.broadcast(of_kind), "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("seed"))
    links = cut_lineage(host_edges(pages, url, html))
    edges = _shares(links, "src", "dst").withColumn("kind", F.lit("allow")).unionByName(_shares(links, "dst", "src").withColumn("kind", F.lit("block")))
    scores = propagate(edges, seeds).groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "allow", F.col("score")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "block", F.col("score")).otherwise(0.0)).alias("distrust"),
    )
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_host = F.when(distrust > F.lit(block_above) * (trust + distrust), F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(scores, "host", "left").select(
        "page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce(F.col("m.verdict"), by_host).alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )

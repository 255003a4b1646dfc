"""URL filter by link-graph propagation: trust spreads along host links, distrust against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

#: (verdict, host suffix, path prefix)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An absolute or scheme-relative target of a link.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. Equal lengths: the earlier of the list."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, w: how many links from pages of src lead to dst, other than src. pages: host, html. A link without a
    host leads to the page's own, and so is no edge."""
    links = pages.filter("host != ''").select(
        F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("link")
    )
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    edges = links.select("src", split_url(target)[0].alias("dst")).filter("dst != '' and dst != src")
    return edges.groupBy("src", "dst").agg(F.count("*").alias("w"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-7) -> DataFrame:
    """Personalised PageRank of both kinds at once: kind, host, score.

    seeds: kind (trust or distrust), host, seed (its share of restarts). Trust follows edges, distrust runs against
    them. A walk from a host without a way on ends there. Rounds end when no score moves by more than
    tolerance times the sum of all seeds; each round's moves are `damping` times the last one's at most, so they do end.
    Scores are summed by (kind, host) after partial sums, so a host that a third of all edges enter is one row per task.
    """
    seeds = materialise(seeds, "seeds")
    one = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "w").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "w")
    )
    out = one.groupBy("kind", "host").agg(F.sum("w").alias("all"))
    steps = materialise(one.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("w") / F.col("all")).alias("p")), "steps")
    start = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
    score = materialise(start, "score")
    if steps.isEmpty():
        return score
    least = tolerance * (seeds.agg(F.sum("seed")).first()[0] or 0.0)
    while True:
        moved = score.join(steps, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("p") * damping).alias("score"))
        new = materialise(start.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score")), "score")
        change = (
            new.withColumnRenamed("score", "new").join(score, ["kind", "host"], "full")
            .agg(F.max(F.abs(F.coalesce("new", F.lit(0.0)) - F.coalesce("score", F.lit(0.0)))))
            .first()[0]
        )
        score = new
        if change is None or change <= least:
            break
    return score


def url_verdicts(pages: DataFrame, rules=None, block_share: float = 0.75) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of `pages` (page_id, url, html).

    The rule that fits decides. Other pages go by their host: seeds are hosts with pages that a rule allows or blocks,
    by how many; a host is blocked if distrust is more than block_share of trust + distrust, else allowed, as is a
    page whose url has no host. Null url: host and path are empty. Null html: no links. Repeated rows: each gets its
    own result row, and counts. No rows: no result rows. Extra columns of `pages` aren't read.
    """
    rules = RULES if rules is None else rules
    host, path = split_url(F.col("url"))
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"), "html").withColumns({"rule": rule, "said": said})
    seeds = (
        judged.filter("host != '' and said is not null")
        .groupBy(F.when(F.col("said") == "allow", "trust").otherwise("distrust").alias("kind"), "host")
        .agg(F.count("*").cast("double").alias("seed"))
    )
    scores = propagate(seeds, host_edges(judged))
    by_host = scores.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"),
    )
    method = F.when(F.col("distrust") > block_share * (F.col("trust") + F.col("distrust")), "block").otherwise("allow")
    return judged.drop("html").join(by_host, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def op8_link_trust(spark, sf_dir):
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")

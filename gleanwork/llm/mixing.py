"""Mixing sources to target weights with soft membership (native: DataFrame functions alone).

Domains are the classes of the labelled table. A naive Bayes classifier learnt from it by aggregation gives every
document a posterior over domains. Nonnegative document rates are then fitted by projected-gradient least squares, so
that the expected tokens of each domain, sum of rate * tokens * posterior, meet its target. The sums over documents
that its rounds need are taken in Spark.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, table

#: Target shares of tokens, by domain "q<quality>t<toxic>" of the labels table; what isn't named shares the rest.
TARGETS = {"q1t0": 0.85, "q0t0": 0.15, "q0t1": 0.0, "q1t1": 0.0}
BUCKETS = 4096
MOST_COPIES = 8.0
MOST_BINS = 10_000
RIDGE = 1e-5
TOLERANCE = 1e-3  # of a domain's share of tokens
GROWTH = (1.0, 1.01, 1.02, 1.04, 1.07, 1.1, 1.15, 1.2, 1.3, 1.4, 1.6, 1.8, 2.0, 2.5, 3.0)
LOG = logging.getLogger(__name__)


def words(text: Column) -> Column:
    """Lower-cased words of a text; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Punct}]+"), lambda w: w != "")


def word_buckets(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("smallint"))


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id, domain: of documents labelled more than once, the least name."""
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null")
    name = F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string"))
    return known.groupBy("doc_id").agg(F.min(name).alias("domain"))


def features(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """row (struct of the columns `keep`, or all), doc_id, tokens and b (buckets of the words), written as a table: texts
    are split once."""
    plain = docs.select(
        F.struct(*[docs[c] for c in keep or docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"), word_buckets(docs["text"]).alias("b")
    )
    plain = plain.select("row", "doc_id", F.size("b").cast("long").alias("tokens"), "b")
    return materialise(plain, "features")


def naive_bayes(seen: DataFrame, labels: DataFrame, smoothing: float = 1.0) -> tuple[list[str], list[float], list[list[float]]]:
    """Domains, log priors and log likelihoods by bucket, counted over all labelled documents of `seen` (doc_id, b).

    Each bucket counts once per document: a long text can't outweigh the others. To the driver come BUCKETS counts per
    domain at most. The join is the same at every size. Without labelled documents: one domain, "all".
    """
    known = seen.select("doc_id", F.array_distinct("b").alias("b")).hint("merge").join(domain_labels(labels), "doc_id")
    # Bucket -1 counts the documents themselves.
    each = known.select("domain", F.explode(F.concat(F.array(F.lit(-1).cast("smallint")), "b")).alias("b"))
    counted = each.groupBy("domain", "b").agg(F.count("*").alias("n")).collect()
    prior = {r["domain"]: r["n"] for r in counted if r["b"] < 0}
    if not prior:
        return ["all"], [0.0], [[0.0] * BUCKETS]
    domains = sorted(prior)
    counts = {d: [smoothing] * BUCKETS for d in domains}
    for r in counted:
        if r["b"] >= 0:
            counts[r["domain"]][r["b"]] += r["n"]
    total = sum(prior.values())
    like = []
    for d in domains:
        of = sum(counts[d])
        like.append([math.log(c / of) for c in counts[d]])
    return domains, [math.log(prior[d] / total) for d in domains], like


def _sum_of(places: str, values: list[float]) -> Column:
    """The sum of the values at the places that an array holds."""
    every = F.lit(values)
    return F.aggregate(places, F.lit(0.0), lambda a, i: a + F.element_at(every, i.cast("int") + 1))


def posteriors(seen: DataFrame, domains: list[str], prior: list[float], like: list[list[float]], temperature: float = 20.0) -> DataFrame:
    """row, tokens and p (array: posterior of each domain).

    The log likelihood is a mean over the words, times `temperature`: naive Bayes takes words for independent, so that
    sums over thousands would leave no soft membership. A text without words has the prior.
    """
    plain = seen.select("row", "tokens", "b")
    base = like[0]
    logit = [F.lit(prior[0])]
    for k in range(1, len(domains)):
        total = _sum_of("b", [x - y for x, y in zip(like[k], base)])
        logit.append(F.lit(prior[k]) + F.lit(temperature) * total / F.greatest(F.col("tokens"), F.lit(1)))
    plain = plain.select("row", "tokens", *[x.alias(f"z{k}") for k, x in enumerate(logit)])
    top = F.greatest(*[F.col(f"z{k}") for k in range(len(domains))]) if len(domains) > 1 else F.col("z0")
    plain = plain.select("row", "tokens", *[F.exp(F.col(f"z{k}") - top).alias(f"e{k}") for k in range(len(domains))])
    total = sum((F.col(f"e{k}") for k in range(1, len(domains))), F.col("e0"))
    return plain.select("row", "tokens", F.array(*[F.col(f"e{k}") / total for k in range(len(domains))]).alias("p"))


def targets_for(domains: list[str], weights: dict[str, float]) -> list[float]:
    """A share for each domain, summing to 1. Domains that `weights` doesn't name share alike what is left."""
    rest = [d for d in domains if d not in weights]
    left = max(0.0, 1 - sum(weights.get(d, 0.0) for d in domains)) if rest else 0.0
    found = [weights[d] if d in weights else left / len(rest) for d in domains]
    total = sum(found)
    return [x / total for x in found] if total > 0 else [1 / len(domains)] * len(domains)


def resolution(domains: int, most_bins: int = MOST_BINS) -> int:
    """The finest grid on posteriors over so many domains that has at most most_bins cells (2 at least)."""
    r = 2
    while r < 1024 and math.comb(r + 1 + domains, domains - 1) <= most_bins:
        r += 1
    return r


def bin_of(k: int) -> Column:
    """The cell of the grid in which a posterior `p` over k domains lies."""
    r = resolution(k)
    parts = [F.round(F.element_at("p", i + 1) * r).cast("long").cast("string") for i in range(k)]
    return F.concat_ws(",", *parts)


@dataclass
class Fit:
    """Shares of the tokens there were: what was aimed at, what the rates give, and how far apart they are."""

    domains: list[str]
    target: list[float]
    reached: list[float]
    residual: float
    largest: float
    rounds: int
    converged: bool


def _descend(share, mean, target, least: float, most: float | None, ridge: float, rounds: int = 20_000, tolerance: float = 1e-7):
    """Projected gradient with momentum, which begins anew when it overshoots: rates, rounds, and whether the last step was
    below tolerance. Steps are scaled by 1 / share, so that rates depend on membership and not on length."""
    scale = float(np.linalg.eigvalsh((mean * share[:, None]).T @ mean)[-1]) + ridge
    rate = ahead = np.clip(np.ones(len(share)), least, most)
    momentum = 1.0
    for n in range(1, rounds + 1):
        slope = mean @ ((ahead * share) @ mean - target) + ridge * (ahead - 1)
        new = np.clip(ahead - slope / scale, least, most)
        if ((ahead - new) * (new - rate) * share).sum() > 0:
            momentum = 1.0
        then = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        moved = np.abs(new - ahead).max()
        ahead, rate, momentum = new + (momentum - 1) / then * (new - rate), new, then
        if moved <= tolerance:
            return rate, n, True
    return rate, rounds, False


def _solve(tokens, mass, centre, targets: list[float], least: float, most: float | None, ridge: float):
    """Rates of bins: `tokens` of each, `mass` its expected tokens by domain, `centre` a posterior for bins without tokens."""
    total = tokens.sum()
    share = tokens / total
    mean = np.where(tokens[:, None] > 0, mass / np.maximum(tokens, 1)[:, None], centre)
    target = np.array(targets)
    if least <= 0:
        rate, n, ok = _descend(share, mean, target, least, most, ridge)
        return rate, target, n, ok
    # All that there is stays, so the mixture can only grow. A domain without a target keeps what it has; the least growth is
    # that which leaves the most overfull of the others as it is. Additions to one domain are in part of others, too: growth
    # goes on until the targets can be met.
    has = share @ mean * least
    kept = has[target == 0].sum()
    least_growth = max([1.0 - kept, *(h / t for h, t in zip(has, target) if t > 0)])
    best = None
    for more in GROWTH:
        aim = np.where(target > 0, target * least_growth * more, has)
        rate, n, ok = _descend(share, mean, aim, least, most, ridge)
        miss = np.abs((rate * share) @ mean - aim)[target > 0].max()
        if best is None or miss < best[0]:
            best = (miss, rate, aim, n, ok)
        if miss <= TOLERANCE:
            break
    return best[1:]


def fit_rates(members: DataFrame, targets: list[float], least: float = 0.0, most: float | None = None, ridge: float = RIDGE, domains: list[str] | None = None) -> tuple[DataFrame, Fit]:
    """`members` (with tokens and p) with `rate`, and how the fit came out.

    Minimises |sum of rate * share * p - target|^2 + ridge * sum of share * (rate - 1)^2 over rates >= least (and <= most),
    share being a document's part of all tokens, by projected gradient. The second term decides among the rates that meet
    the targets, keeps rates of hopeless targets (a domain that is in every document at least a little) within bounds,
    and makes the result one: it doesn't depend on the rounds.

    Rates are a function of membership. Documents whose posteriors share a cell of a grid have one rate; what the gradient
    needs of them, their expected tokens by domain, is summed once, in Spark and exactly. The cells are MOST_BINS at
    most, however many documents there are, so rounds cost the same at every size, and run until they converge.

    With a `least` above 0 all documents stay: targets are those of the grown mixture (see _solve), and Fit.target tells them.
    No tokens: rates of 1 (or `least`).
    """
    k = len(targets)
    names = domains or [str(i) for i in range(k)]
    p = [F.element_at("p", i + 1) for i in range(k)]
    binned = members.withColumn("bin", bin_of(k))
    sums = [F.sum("tokens").alias("t"), *[F.sum(F.col("tokens") * p[i]).alias(f"m{i}") for i in range(k)], *[F.avg(p[i]).alias(f"c{i}") for i in range(k)]]
    rows = binned.groupBy("bin").agg(*sums).orderBy("bin").collect()
    tokens = np.array([r["t"] or 0 for r in rows], np.float64)
    if not tokens.sum():
        return members.withColumn("rate", F.lit(float(max(1.0, least)))), Fit(names, list(targets), [0.0] * k, 0.0, max(1.0, least), 0, True)
    mass = np.array([[r[f"m{i}"] or 0.0 for i in range(k)] for r in rows])
    rate, aim, rounds, ok = _solve(tokens, mass, np.array([[r[f"c{i}"] for i in range(k)] for r in rows]), targets, least, most, ridge)
    reached = rate @ mass / tokens.sum()
    found = Fit(names, aim.tolist(), reached.tolist(), float(np.linalg.norm(reached - aim)), float(rate.max()), rounds, ok)
    LOG.log(logging.INFO if ok else logging.WARNING, "mixing: %s", found)
    spark = members.sparkSession
    place = F.col("id").cast("int") + 1
    told = spark.range(len(rows)).select(F.element_at(F.lit([r["bin"] for r in rows]), place).alias("bin"), F.element_at(F.lit(rate.tolist()), place).alias("rate"))
    # Of MOST_BINS rows at most.
    return binned.join(F.broadcast(told), "bin").drop("bin"), found


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, keep: list[str] | None = None, **limits) -> tuple[DataFrame, Fit]:
    """(struct `row` of the columns `keep` (all), tokens, p and rate for every row of `docs`; how the fit came out).

    Null and empty texts have no tokens and the prior; their rates follow their membership like any other's. Equal
    texts get equal rates; rows that repeat are documents each. Labels with nulls aren't used; documents with a null
    doc_id have no label. No labels: one domain and rates of 1. No documents: an empty result. Columns of any name pass
    through in `row`; `text` and `doc_id` are read. `limits`: those of fit_rates.
    """
    seen = features(docs, keep)
    domains, prior, like = naive_bayes(seen, labels)
    members = materialise(posteriors(seen, domains, prior, like), "members")
    return fit_rates(members, targets_for(domains, TARGETS if weights is None else weights), domains=domains, **limits)


def op2_soft_membership_mixing(spark, sf_dir):
    """Besides its posterior and rate, each document's row tells the target share of its likeliest domain, the share that
    the rates give it, and the fit's residual over all domains."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, fit = mix(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
    best = F.array_position("p", F.array_max("p")).cast("int")
    return found.select(
        "row.doc_id", "tokens", F.element_at(F.lit(fit.domains), best).alias("domain"), F.col("p").alias("posterior"), "rate",
        (F.col("rate") * F.col("tokens")).alias("expected_tokens"), F.element_at(F.lit(fit.target), best).alias("target"),
        F.element_at(F.lit(fit.reached), best).alias("reached"), F.lit(fit.residual).alias("residual"),
    )


def apply_mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: each document is written floor(rate + u) times, u being a number in [0, 1) that its id and text decide.

    Rates are 1 to MOST_COPIES: what lacks tokens is repeated, and every document stays. So domains can only grow: those
    without a target (toxic ones) keep the tokens that they have, as far as repeats of others don't add to them, and the
    others meet the shares of the grown mixture that TARGETS gives them, where rates up to MOST_COPIES can; the log tells
    targets, what is reached and the residual. Null and empty texts, null ids: repeated by the rate of the prior.
    Rows that repeat: each is repeated alike. No documents: no rows.
    """
    found, _ = mix(docs, table(spark, sf_dir, "labels"), least=1.0, most=MOST_COPIES)
    u = F.pmod(F.xxhash64(F.lit("mixing"), "row.doc_id", "row.text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.sequence(F.lit(1), F.floor(F.col("rate") + u).cast("int"))
    return found.select("row", F.explode(copies).alias("copy")).select("row.*")

"""Retrieval evaluation: pools, judgments, agreement, metrics, intervals, tests, failures."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOOTSTRAP, FLIPS, SEED = 1000, 10_000, 20261015
FAILURE_DEPTH, SMALL_GROUP = 10, 5


# ---- pools and judgments ----


def pool(runs: DataFrame, depth: int) -> DataFrame:
    """qid, unit_id, found_by (run -> rank): what any run has in its first `depth`. runs: run, qid, unit_id, rank."""
    top = runs.filter(F.col("rank") <= depth)
    return top.groupBy("qid", "unit_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("run", "rank")))).alias("found_by"))


def shuffled(df: DataFrame, keys: list[str], within: str, seed: int) -> DataFrame:
    """position in a repeatable random order inside each group."""
    w = Window.partitionBy(within).orderBy(F.xxhash64(F.lit(seed), *keys), *keys)
    return df.withColumn("position", F.row_number().over(w))


def stratified_sample(df: DataFrame, stratum: str, quota: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """quota: stratum, n. Without replacement."""
    return shuffled(df, keys, stratum, seed).join(F.broadcast(quota), stratum).filter("position <= n").drop("position", "n")


def latest_judgments(raw: DataFrame) -> DataFrame:
    """The last per qid, unit_id, annotator by `seq`; grades other than 0, 1, 2 are refused."""
    wrong = raw.filter("grade is null or grade not in (0, 1, 2)").limit(1).collect()
    if wrong:
        raise ValueError(f"grade {wrong[0]['grade']} isn't 0, 1 or 2")
    last = raw.groupBy("qid", "unit_id", "annotator").agg(F.max_by(F.struct("grade", "seq"), "seq").alias("x"))
    return last.select("qid", "unit_id", "annotator", "x.grade", "x.seq")


def pair_grades(judgments: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """qid, unit_id, a, b where both have judged."""
    of = lambda who: F.max(F.when(F.col("annotator") == who, F.col("grade")))
    return judgments.groupBy("qid", "unit_id").agg(of(a).alias("a"), of(b).alias("b")).filter("a is not null and b is not null")


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def agreement(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    mean = lambda c: F.round(F.avg(c.cast("double")), 6)
    same = F.col("a") == F.col("b")
    both = (F.col("a") >= 1) == (F.col("b") >= 1)
    return pairs.groupBy(*(by or [])).agg(F.count("*").alias("n"), mean(same).alias("exact"), mean(both).alias("relevance"), F.sum((~same).cast("long")).alias("disagreements"))


def weighted_kappa(pairs: DataFrame, levels: int = 3) -> DataFrame:
    """kappa, n: quadratic weights. From the counts of pairs and their margins; null when nothing is expected to differ.

    Sum of w * expected is E[(a - b)^2] under independence = E a^2 + E b^2 - 2 E a E b, so no cross product of margins."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    s = pairs.agg(F.count("*").alias("n"), F.avg((a - b) * (a - b)).alias("seen"), (F.avg(a * a) + F.avg(b * b) - 2 * F.avg(a) * F.avg(b)).alias("expected"))
    return s.select(F.when(F.col("expected") > 1e-15, F.round(1 - F.col("seen") / F.col("expected"), 6)).alias("kappa"), "n")


def finalize(judgments: DataFrame, adjudicator: str = "adjudicated", strict: bool = True) -> DataFrame:
    """qid, unit_id, grade: the adjudicated grade, else the unanimous one; anything else is an error."""
    decided = F.max(F.when(F.col("annotator") == adjudicator, F.col("grade")))
    human = F.when(F.col("annotator") != adjudicator, F.col("grade"))
    same = F.when(F.min(human) == F.max(human), F.max(human))
    out = judgments.groupBy("qid", "unit_id").agg(F.coalesce(decided, same).alias("grade"))
    if strict and not out.filter("grade is null").isEmpty():
        raise ValueError("units with different grades and no adjudication")
    return out


def disputed(judgments: DataFrame, adjudicator: str = "adjudicated") -> DataFrame:
    """qid, unit_id: more than one human grade, or an adjudication unlike the first."""
    human = F.when(F.col("annotator") != adjudicator, F.col("grade"))
    g = judgments.groupBy("qid", "unit_id").agg(
        F.count_distinct(human).alias("grades"), F.min_by(human, F.when(human.isNotNull(), F.col("seq"))).alias("first"),
        F.max(F.when(F.col("annotator") == adjudicator, F.col("grade"))).alias("decided"),
    )
    return g.filter("grades > 1 or (decided is not null and decided <> first)").select("qid", "unit_id")


def qrels_stats(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """qid, n0, n1, n2, for all queries."""
    of = lambda g: F.sum(F.when(F.col("grade") == g, 1).otherwise(0)).alias(f"n{g}")
    return queries.select("qid").join(qrels, "qid", "left").groupBy("qid").agg(of(0), of(1), of(2))


# ---- metrics ----


def metrics(run: DataFrame, qrels: DataFrame, k: int = 10, deep: int = 100) -> DataFrame:
    """qid and ndcg, precision, recall, mrr at k, recall at `deep`, recall of grade 2 at k (null if there are none), for every
    query with a unit of grade 1 or more; queries that the run lacks count as 0. run: qid, unit_id, rank."""
    best = Window.partitionBy("qid").orderBy(F.desc("grade"), "unit_id")
    relevant = qrels.filter("grade > 0").withColumn("i", F.row_number().over(best))
    gain = lambda rank: F.col("grade") / F.log2(rank + 1.0)
    ideal = relevant.groupBy("qid").agg(
        F.count("*").alias("n"), F.sum((F.col("grade") == 2).cast("long")).alias("n2"), F.sum(F.when(F.col("i") <= k, gain(F.col("i"))).otherwise(0.0)).alias("idcg")
    )
    hits = run.join(qrels.filter("grade > 0"), ["qid", "unit_id"]).groupBy("qid").agg(
        F.sum(F.when(F.col("rank") <= k, gain(F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.sum((F.col("rank") <= k).cast("long")).alias("top"),
        F.sum(((F.col("rank") <= k) & (F.col("grade") == 2)).cast("long")).alias("top2"),
        F.sum((F.col("rank") <= deep).cast("long")).alias("far"),
        F.min(F.when(F.col("rank") <= k, F.col("rank"))).alias("first"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = ideal.join(hits, "qid", "left")
    return both.select(
        "qid", F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("idcg"), 6).alias("ndcg"), F.round(zero("top") / F.lit(k), 6).alias("precision"),
        F.round(zero("top") / F.col("n"), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(zero("far") / F.col("n"), 6).alias("recall_deep"), F.when(F.col("n2") > 0, F.round(zero("top2") / F.col("n2"), 6)).alias("recall_grade2"),
    )


def evidence_language(qrels: DataFrame, units: DataFrame) -> DataFrame:
    """qid, lang of the relevant units: the other language if most are in it, ko on ties. units: unit_id, lang."""
    rel = qrels.filter("grade > 0").join(units, "unit_id").groupBy("qid", "lang").agg(F.count("*").alias("n"))
    ko = F.sum(F.when(F.col("lang") == "ko", F.col("n")).otherwise(0))
    other = F.when(F.col("lang") != "ko", F.struct(F.col("n"), F.col("lang")))
    return rel.groupBy("qid").agg(ko.alias("ko"), F.max(other).alias("o")).select("qid", F.when(F.coalesce(F.col("o.n"), F.lit(0)) > F.col("ko"), F.col("o.lang")).otherwise("ko").alias("lang"))


# ---- statistics ----


def bootstrap_interval(values, n: int = BOOTSTRAP, seed: int = SEED) -> tuple[float, float]:
    x = np.asarray(values, float)
    if not len(x):
        return float("nan"), float("nan")
    means = x[np.random.default_rng(seed).integers(0, len(x), (n, len(x)))].mean(axis=1)
    return tuple(float(v) for v in np.percentile(means, [2.5, 97.5]))


def sign_flip_p(differences, n: int = FLIPS, seed: int = SEED, tolerance: float = 1e-12) -> float:
    """Two-sided; counts flips that reach the observed mean, without adding one."""
    d = np.asarray(differences, float)
    if not len(d):
        return float("nan")
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (n, len(d)))
    return float((np.abs((signs * d).mean(axis=1)) >= abs(d.mean()) - tolerance).mean())


def bootstrap_by_group(scores: DataFrame, by: list[str], seed: int = SEED) -> DataFrame:
    """by, n, mean, low, high. scores: by, qid, value. A group is one run's queries: small by nature."""
    fields = ", ".join(f"{c} {t}" for c, t in scores.dtypes if c in by)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("qid")["value"].to_numpy()
        low, high = bootstrap_interval(x, seed=seed)
        return pd.DataFrame([[*pdf[by].iloc[0].tolist(), len(x), x.mean(), low, high]], columns=[*by, "n", "mean", "low", "high"])

    return scores.groupBy(*by).applyInPandas(one, f"{fields}, n long, mean double, low double, high double")


def paired_tests(a: DataFrame, b: DataFrame, seed: int = SEED) -> DataFrame:
    """n, difference (b - a), low, high, p for queries that both have. a, b: qid, value."""
    both = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), "qid").withColumn("g", F.lit(1))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        d = (pdf["b"] - pdf["a"])[pdf["qid"].argsort()].to_numpy()
        low, high = bootstrap_interval(d, seed=seed)
        return pd.DataFrame([[len(d), d.mean(), low, high, sign_flip_p(d, seed=seed)]], columns=["n", "difference", "low", "high", "p"])

    return both.groupBy("g").applyInPandas(one, "n long, difference double, low double, high double, p double")


def holm(tests: DataFrame, family: list[str] | None = None, p: str = "p", key: str = "name") -> DataFrame:
    """`tests` with adjusted: step-down, never falling, at most 1; NaN and null don't count."""
    tests = tests.withColumn("__f", F.lit(1))
    known = tests.filter(F.col(p).isNotNull() & ~F.isnan(p))
    w = Window.partitionBy("__f", *(family or []))
    order = w.orderBy(p, key)
    left = F.count("*").over(w) - F.row_number().over(order) + 1
    stepped = known.withColumn("__s", F.least(F.lit(1.0), left * F.col(p)))
    adjusted = stepped.withColumn("adjusted", F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")
    rest = tests.filter(F.col(p).isNull() | F.isnan(p)).withColumn("adjusted", F.lit(None).cast("double"))
    return adjusted.unionByName(rest).drop("__f")


# ---- failures ----


def missed(qrels: DataFrame, base: DataFrame, runs: DataFrame, names: list[str], depth: int = FAILURE_DEPTH) -> DataFrame:
    """qid, unit_id and its rank in each run: units of grade 2 that the base run lacks in its first `depth`."""
    lost = qrels.filter("grade = 2").select("qid", "unit_id").join(base.filter(F.col("rank") <= depth), ["qid", "unit_id"], "left_anti")
    ranks = runs.groupBy("qid", "unit_id").pivot("run", names).agg(F.min("rank"))
    return lost.join(ranks, ["qid", "unit_id"], "left")


def failure_hints(facts: DataFrame, p95_tokens: float, runs: dict[str, str], depth: int = FAILURE_DEPTH) -> DataFrame:
    """`facts` with hints why a unit was missed. facts: a rank column for each run (null: not found), query_lang, unit_lang,
    n_parts, n_tokens, is_disputed. runs: the columns of the runs "base" (reranked, with headers), "fused" (before
    reranking), "plain" (without headers) and "lexical"; of one that wasn't made, nothing is said.

    Only units that the base run lacks can have been demoted or hurt by headers; a unit is lost across languages if its own
    language is known, isn't the query's, and the lexical run lacks it. Long is what has several parts or more tokens
    than 95 % of units."""
    never = F.lit(False)
    inside = lambda name: F.coalesce(F.col(runs[name]) <= depth, F.lit(False)) if name in runs else never
    outside = lambda name: ~inside(name) if name in runs else never
    told = ~F.coalesce(F.col("unit_lang"), F.lit("")).isin("", "und")
    rules: list[tuple[str, Column]] = [
        ("rerank_demotion", outside("base") & inside("fused")),
        ("header_effect", outside("base") & inside("plain")),
        ("cross_lingual", told & (F.col("query_lang") != F.col("unit_lang")) & outside("lexical")),
        ("long_unit", (F.col("n_parts") >= 2) | (F.col("n_tokens") > p95_tokens)),
        ("disputed", F.col("is_disputed")),
    ]
    return facts.withColumn("hints", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules])))


def tokens_p95(parts: DataFrame) -> DataFrame:
    """p95 of the units' tokens. parts: unit_id, n_tokens."""
    return parts.groupBy("unit_id").agg(F.sum("n_tokens").alias("n")).agg(F.round(F.percentile("n", F.lit(0.95)), 4).alias("p95"))


def keep_annotations(rows: DataFrame, before: DataFrame, columns: list[str], key: tuple[str, ...] = ("qid", "unit_id")) -> DataFrame:
    """`rows` with what people have written into `columns` before; where they have written nothing, as it is."""
    old = before.select(*key, *[F.nullif(F.col(c), F.lit("")).alias(f"__{c}") for c in columns])
    both = rows.join(old, list(key), "left")
    return both.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def relevant_distribution(queries: DataFrame, qrels: DataFrame, group: str, many: int = 10) -> DataFrame:
    """group (and total): how many relevant units queries have (grade 1 or more, and grade 2): mean, median, most; queries
    without one, and with more than `many`. Queries that weren't judged have none."""
    each = queries.select("qid", group).join(qrels, "qid", "left").groupBy("qid", group).agg(
        F.sum((F.coalesce("grade", F.lit(0)) >= 1).cast("long")).alias("rel"), F.sum((F.coalesce("grade", F.lit(0)) == 2).cast("long")).alias("top")
    )
    of = lambda c: [F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.percentile(c, F.lit(0.5)), 6).alias(f"{c}_median"), F.max(c).alias(f"{c}_max")]
    table = each.rollup(group).agg(
        F.grouping(group).alias("__all"), F.count("*").alias("n"), *of("rel"), *of("top"), F.sum((F.col("rel") == 0).cast("long")).alias("none"), F.sum((F.col("rel") > many).cast("long")).alias("many")
    )
    return table.withColumn(group, F.when(F.col("__all") == 1, "total").otherwise(F.col(group))).drop("__all")


def pool_stats(queries: DataFrame, pooled: DataFrame, max_chars: int) -> DataFrame:
    """One row: pooled units of a query (mean, least, most; queries without any count), rows, different units, rows and units
    whose text is longer than max_chars, and that have a translation. pooled: qid, unit_id, n_chars, translated."""
    per = queries.select("qid").join(pooled.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left")
    per = per.agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("mean"), F.min(F.coalesce("n", F.lit(0))).alias("least"), F.max(F.coalesce("n", F.lit(0))).alias("most"))
    cut, told = F.col("n_chars") > max_chars, F.coalesce("translated", F.lit(False))
    rows = pooled.agg(
        F.count("*").alias("rows"), F.count_distinct("unit_id").alias("units"), F.count(F.when(cut, 1)).alias("cut_rows"), F.count_distinct(F.when(cut, F.col("unit_id"))).alias("cut_units"),
        F.count(F.when(told, 1)).alias("translated_rows"), F.count_distinct(F.when(told, F.col("unit_id"))).alias("translated_units"),
    )
    return per.withColumn("one", F.lit(1)).join(rows.withColumn("one", F.lit(1)), "one").drop("one")


def comparison_table(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, n, mean_a, mean_b for each pair of runs. scores: run, qid, value; pairs: a, b (a few)."""
    both = _paired(scores, pairs)
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("va").alias("mean_a"), F.avg("vb").alias("mean_b"))


def _paired(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    of = lambda r: scores.select(F.col("run").alias(r), "qid", F.col("value").alias(f"v{r}"))
    return of("a").join(F.broadcast(pairs), "a").join(of("b"), ["b", "qid"])


def compared(scores: DataFrame, pairs: DataFrame, seed: int = SEED) -> DataFrame:
    """comparison_table with the difference (b - a), its interval, p and p adjusted over all pairs as one family."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("qid")
        d = (pdf["vb"] - pdf["va"]).to_numpy()
        low, high = bootstrap_interval(d, seed=seed)
        row = [pdf["a"].iloc[0], pdf["b"].iloc[0], len(d), pdf["va"].mean(), pdf["vb"].mean(), d.mean(), low, high, sign_flip_p(d, seed=seed)]
        return pd.DataFrame([row], columns=["a", "b", "n", "mean_a", "mean_b", "difference", "low", "high", "p"])

    fields = "a string, b string, n long, mean_a double, mean_b double, difference double, low double, high double, p double"
    tested = _paired(scores, pairs).groupBy("a", "b").applyInPandas(one, fields)
    return holm(tested.withColumn("name", F.concat_ws(" ", "a", "b"))).drop("name")


def t_test_p(differences) -> float:
    """Two-sided p of a paired t test; 1 where nothing differs, 0 where all differ alike."""
    d = np.asarray(differences, float)
    if len(d) < 2:
        return float("nan")
    if np.allclose(d, 0):
        return 1.0
    if np.allclose(d, d[0]):
        return 0.0
    t2, df = len(d) * d.mean() ** 2 / d.var(ddof=1), len(d) - 1
    # P(|T| > t) by the substitution T = sqrt(df) tan(angle): the integral of cos(angle)^(df - 1), by Simpson's rule.
    angles = np.linspace(math.atan(math.sqrt(t2 / df)), math.pi / 2, 20_001)
    weight = np.where(np.arange(20_001) % 2, 4.0, 2.0)
    weight[[0, -1]] = 1.0
    area = (weight * np.cos(angles) ** (df - 1)).sum() * (angles[1] - angles[0]) / 3
    return float(min(1.0, 2 * area * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)))


def permutation_p(differences, n: int = FLIPS, seed: int = 0) -> float:
    """sign_flip_p as the earlier harness has it: the observed signs count as one of the flips."""
    found = sign_flip_p(differences, n, seed)
    return (found * n + 1) / (n + 1)


def breakdown(scores: DataFrame, group: str, runs: list[str]) -> DataFrame:
    """group, n, a column for each run, small (fewer than SMALL_GROUP queries)."""
    table = scores.groupBy(group).pivot("run", runs).agg(F.round(F.avg("value"), 6))
    sizes = scores.groupBy(group).agg(F.count_distinct("qid").alias("n"))
    return table.join(sizes, group).withColumn("small", F.col("n") < SMALL_GROUP)


def breakdowns(scores: DataFrame, facts: DataFrame, groups: list[str], runs: list[str]) -> DataFrame:
    """breakdown by each of `groups` (columns of facts: qid, ...), one after the other: grouping, value, n, runs, small."""
    every = None
    both = scores.join(facts, "qid")
    for g in groups:
        one = breakdown(both, g, runs).select(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("value"), "n", *runs, "small")
        every = one if every is None else every.unionByName(one)
    return every

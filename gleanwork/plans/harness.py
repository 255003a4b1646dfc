"""The evaluation harness: runs by configuration, latency, environment, locks, and logs of use."""

from __future__ import annotations

import hashlib
import json
import platform
import random
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanwork.operators.search import RetrievalConfig
from gleanwork.plans.retrieve import retrieve

# ---- fixed values ----
GROUPS = {"A": "search", "A'": "search", "C": "meta", "D": "nonsearch", "B": "nonsearch", "E": "nonsearch"}
STAGES = ["bm25", "embed_query", "dense", "rrf", "rerank", "total"]
# ---- end of fixed values ----


def validate_queries(queries: DataFrame) -> DataFrame:
    """Refuses repeated ids, blank texts and unknown classes; adds support_group."""
    if not queries.groupBy("qid").count().filter("count > 1").isEmpty():
        raise ValueError("query ids repeat")
    if not queries.filter("trim(coalesce(text, '')) = ''").isEmpty():
        raise ValueError("queries without text")
    group = F.lit(None).cast("string")
    for k, v in GROUPS.items():
        group = F.when(F.col("support_class") == k, v).otherwise(group)
    out = queries.withColumn("support_group", group)
    if not out.filter("support_group is null").isEmpty():
        raise ValueError("unknown support classes")
    return out


def subset_lock(qids: list[str], locked: str | None = None) -> str:
    """A digest of the primary set; another than the locked one is an error."""
    found = hashlib.sha256("\n".join(sorted(qids)).encode()).hexdigest()
    if locked is not None and locked != found:
        raise ValueError("the primary set of queries has changed since it was locked")
    return found


def run_all(queries: DataFrame, parts: DataFrame, configs: dict[str, RetrievalConfig]) -> DataFrame:
    """run, qid, unit_id, rank, score of every configuration over all queries."""
    every = None
    for name, config in configs.items():
        one = retrieve(queries, parts, config).select(F.lit(name).alias("run"), "qid", "unit_id", "rank", "score")
        every = one if every is None else every.unionByName(one)
    return every


def composition(queries: DataFrame) -> DataFrame:
    """area (and total) by support class: how many queries."""
    classes = sorted(GROUPS)
    counts = [F.sum((F.col("support_class") == c).cast("long")).alias(c) for c in classes]
    table = queries.rollup("area").agg(F.grouping("area").alias("g"), *counts, F.count("*").alias("n"))
    return table.withColumn("area", F.when(F.col("g") == 1, "total").otherwise(F.col("area"))).drop("g")


def measure(stages: dict[str, Callable[[], object]], warm_up: int = 3, repeats: int = 5, seed: int = 1) -> list[tuple[str, float]]:
    """(stage, seconds): each stage in shuffled order, after warm-ups that don't count."""
    rng, out = random.Random(seed), []
    for k in range(warm_up + repeats):
        order = list(stages)
        rng.shuffle(order)
        for name in order:
            start = time.perf_counter()
            stages[name]()
            if k >= warm_up:
                out.append((name, time.perf_counter() - start))
    return out


def environment(spark: SparkSession) -> dict[str, str]:
    conf = spark.sparkContext.getConf()
    return {
        "python": platform.python_version(), "spark": spark.version, "machine": platform.machine(), "master": spark.sparkContext.master,
        "parallelism": str(spark.sparkContext.defaultParallelism), "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "executor_memory": conf.get("spark.executor.memory", ""), "driver_memory": conf.get("spark.driver.memory", ""),
    }


def with_cache(texts: DataFrame, cache: DataFrame, model: str, translate: Callable[[Column], Column]) -> DataFrame:
    """text, translation, fresh: cached by model and the text's hash; only what is missing is translated."""
    keyed = texts.select("text").distinct().withColumn("key", F.sha1("text"))
    known = cache.filter(F.col("model") == model).select("key", F.col("translation").alias("cached"))
    both = keyed.join(known, "key", "left")
    done = both.filter("cached is not null").select("key", "text", F.col("cached").alias("translation"), F.lit(False).alias("fresh"))
    return done.unionByName(both.filter("cached is null").select("key", "text", translate(F.col("text")).alias("translation"), F.lit(True).alias("fresh")))


def token_usage(response: Column, prompt: Column, answer: Column) -> Column:
    """Input and output tokens of a model's answer (JSON): by its usage_metadata, else the counters of a local server, else
    an older form, else estimated; `source` says which."""
    at = lambda path: F.get_json_object(response, "$." + path).cast("long")
    from gleanwork.functions.text import llm_token_estimate

    forms = [("usage_metadata", "usage_metadata.input_tokens", "usage_metadata.output_tokens"), ("server", "prompt_eval_count", "eval_count"), ("legacy", "token_usage.prompt_tokens", "token_usage.completion_tokens")]
    given = F.lit("estimate")
    for name, i, _ in reversed(forms):
        given = F.when(at(i).isNotNull(), name).otherwise(given)
    return F.struct(
        F.coalesce(*[at(i) for _, i, _ in forms], llm_token_estimate(prompt)).alias("input"), F.coalesce(*[at(o) for _, _, o in forms], llm_token_estimate(answer)).alias("output"),
        given.alias("source"),
    )


def append_log(spark: SparkSession, path: str, **fields) -> None:
    """One row of a log table: indexing runs, questions and answers, token use."""
    row = {"at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **{k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in fields.items()}}
    spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).write.mode("append").parquet(path)


def recent(log: DataFrame, case_id: str, limit: int = 50) -> DataFrame:
    return log.filter(F.col("case_id") == case_id).orderBy(F.desc("at")).limit(limit)


def compare_top(a: DataFrame, b: DataFrame, k: int = 5) -> DataFrame:
    """qid, overlap of two runs' first k units."""
    top = lambda d, n: d.filter(F.col("rank") <= k).groupBy("qid").agg(F.collect_set("unit_id").alias(n))
    return top(a, "a").join(top(b, "b"), "qid").select("qid", (F.size(F.array_intersect("a", "b")) / F.lit(k)).alias("overlap"))


def rank_table(run: DataFrame, run_column: str = "run") -> DataFrame:
    w = Window.partitionBy(run_column, "qid").orderBy(F.desc("score"), "unit_id")
    return run.withColumn("rank", F.row_number().over(w))

"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix (native).

A uniformly random permutation of N rows, cut into shards, sends a random number of rows from each source
partition to each shard. Those numbers follow the multivariate hypergeometric law with both margins fixed. So they
are drawn first, on the driver, from the partitions' sizes alone; each partition is permuted locally, its rows go to
the shards in runs as long as the numbers drawn, and each shard is permuted again.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, table

LOW_33 = (1 << 33) - 1


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Successes among `draws` items taken without replacement from `good` + `bad`. Inversion over the ratios of
    neighbouring probabilities from the mode outward, so that the population may exceed what NumPy's sampler takes;
    terms below 1e-18 of the mode's are zero in a double and end the table."""
    low, high = max(0, draws - bad), min(good, draws)
    if low >= high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    p = good / total
    width = int(13 * math.sqrt(max(1.0, draws * p * (1 - p)))) + 40
    up = np.arange(mode, min(high, mode + width), dtype=np.float64)
    down = np.arange(mode, max(low, mode - width), -1, dtype=np.float64)
    right = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    left = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    weights = np.concatenate([left[::-1], [1.0], right])
    sums = np.cumsum(weights)
    return int(mode - len(left) + min(np.searchsorted(sums, rng.random() * sums[-1], side="right"), len(sums) - 1))


def communication_matrix(sizes: list[int], capacities: list[int], seed: int) -> list[list[int]]:
    """Rows per (source partition, shard), with the margins `sizes` and `capacities`, which have equal sums."""
    rng = np.random.default_rng(seed)
    left, out = list(capacities), []
    for size in sizes:
        rest, row = sum(left), []
        need = size
        for cap in left:
            got = hypergeometric(rng, cap, rest - cap, need)
            row.append(got)
            need -= got
            rest -= cap
        left = [c - g for c, g in zip(left, row)]
        out.append(row)
    return out


def hypergeometric_shuffle(df: DataFrame, n_shards: int = 16, seed: int = 20240607, bucket_rows: int = 50_000) -> DataFrame:
    """`df` as struct column `row`, with `shard` (int, from 0) and `slot` (long, gapless from 0 in each shard).

    Shards' counts differ by one at most, the first N mod n_shards being the larger. Every arrangement of the rows is
    equally likely. A row's columns aren't looked at: nulls, equal rows, hot keys and columns of any name make no
    difference, and no key decides where a row goes. No rows: an empty result.

    To the driver go one number per source partition; back go n_shards sums for each. A shard is permuted in buckets
    of about bucket_rows rows each, none of which holds more than its random share of the rows.
    """
    spark = df.sparkSession
    # Once written, the random numbers and positions are data: a lost task reads them again instead of drawing others.
    dealt = (
        df.select(F.struct(*[df[c] for c in df.columns]).alias("row") if df.columns else F.struct().alias("row"))
        .withColumn("near", F.rand(seed))
        .withColumn("far", F.rand(seed + 1))
        .sortWithinPartitions("near")
        .withColumn("block", F.spark_partition_id())
        .withColumn("pos", F.monotonically_increasing_id().bitwiseAND(F.lit(LOW_33)))
    )
    dealt = materialise(dealt.drop("near"), "shards")
    sizes = {r["block"]: r["n"] for r in dealt.groupBy("block").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    blocks = sorted(sizes)
    capacities = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    matrix = communication_matrix([sizes[b] for b in blocks], capacities, seed)
    runs = [(int(b), [int(x) for x in np.cumsum(row)]) for b, row in zip(blocks, matrix)]
    ends = spark.createDataFrame(
        runs, T.StructType([T.StructField("block", T.IntegerType()), T.StructField("ends", T.ArrayType(T.LongType()))])
    )
    if len(runs) * n_shards <= 1_000_000:  # 8 MB at most; beyond it an ordinary join
        ends = F.broadcast(ends)
    parts = max(1, math.ceil(total / n_shards / bucket_rows))
    sent = dealt.join(ends, "block").select(
        "row",
        F.size(F.filter("ends", lambda e: e <= F.col("pos"))).cast("int").alias("shard"),
        F.least(F.lit(parts - 1), F.floor(F.col("far") * parts).cast("int")).alias("bucket"),
        "far", "block", "pos",
    )
    starts = sent.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    if n_shards * parts <= 500_000:
        starts = F.broadcast(starts)
    within = Window.partitionBy("shard", "bucket").orderBy("far", "block", "pos")
    return (
        sent.withColumn("at", F.row_number().over(within) - 1)
        .join(starts, ["shard", "bucket"])
        .select("row", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"))
    )


def op7_hypergeometric_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    return hypergeometric_shuffle(docs).select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

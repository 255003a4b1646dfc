"""Lexical and dense scoring, part-to-unit collapse, rank fusion, reranking and filters: one job over all queries."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

QUERY_BLOCK, BLOCK_ROWS = 512, 4096  # queries and vectors of a matrix product
BROADCAST_BYTES = 32 << 20  # of query blocks; more are joined by a shuffle
QUERY_TERMS = 10_000  # distinct query terms that are told to the scan; beyond it they are joined
DIGITS = 9  # scores are compared after rounding, so that sums taken in another order tie alike


@dataclass(frozen=True)
class RetrievalConfig:
    use_bm25: bool = True
    use_dense: bool = True
    rerank: bool = False
    k_bm25: int = 50
    k_dense: int = 50
    rrf_k: int = 60
    rerank_candidates: int = 30
    rerank_min_score: float = 0.0  # 0: off
    depth: int = 100


# ---- lexical ----


def lexical_index(parts: DataFrame) -> dict[str, DataFrame]:
    """parts: part_id, tokens (array). Gives postings (term, part_id, dl, tf) and terms (term, df, cf). A part without tokens
    counts as a document of length 1: it has one posting of a null term.

    Tokens are counted once: terms are summed from postings. Stored in order of terms, a query reads the row groups of its
    own terms.
    """
    tokens = F.coalesce("tokens", F.array().cast("array<string>"))
    each = parts.select("part_id", F.greatest(F.size(tokens), F.lit(1)).alias("dl"), F.explode_outer(tokens).alias("term"))
    postings = each.groupBy("term", "part_id", "dl").agg(F.count("*").alias("tf"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return {"postings": postings, "terms": terms}


def score_postings(index: dict[str, DataFrame], queries: DataFrame, n_parts: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """qid, part_id, score of every part that has a query token. index: see lexical_index; queries: qid, tokens; n_parts: how
    many parts there are.

    A token that a query repeats counts as often. Okapi weights; a negative idf becomes epsilon times the mean idf of all
    terms. Statistics cover all parts: filter afterwards.
    """
    asked = queries.select("qid", F.explode("tokens").alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    wanted = [r["term"] for r in asked.select("term").distinct().limit(QUERY_TERMS + 1).collect()]
    n = F.lit(float(n_parts))
    terms = index["terms"]
    idf = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    stats = terms.agg(F.avg(F.when(F.col("term").isNotNull(), idf)).alias("mean"), (F.sum("cf") / n).alias("avgdl")).withColumn("one", F.lit(1))
    known, postings = terms.select("term", idf.alias("idf")), index["postings"].select("term", "part_id", "dl", "tf")
    if len(wanted) <= QUERY_TERMS:  # told to the scan; more are joined
        known, postings = known.filter(F.col("term").isin(wanted)), postings.filter(F.col("term").isin(wanted))
    weights = known.join(asked, "term").withColumn("one", F.lit(1)).join(F.broadcast(stats), "one")
    weight = F.when(F.col("idf") < 0, epsilon * F.col("mean")).otherwise(F.col("idf")) * F.col("times")
    weights = weights.select("qid", "term", weight.alias("weight"), "avgdl")
    tf = F.col("tf")
    gain = F.col("weight") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return postings.join(weights, "term").groupBy("qid", "part_id").agg(F.sum(gain).alias("score"))


def bm25_scores(parts: DataFrame, queries: DataFrame, **weights: float) -> DataFrame:
    """score_postings over an index made on the way: for parts that aren't searched again."""
    return score_postings(lexical_index(parts), queries, parts.select("part_id").count(), **weights)


# ---- dense ----


def l2_normalize(v: Column) -> Column:
    """A zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _blocks(rows: int):
    """Rows (key, vec) in blocks of one dimension: keys, and the normalised vectors as bytes."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[int, list] = {}

        def block(dim, found):
            m = np.array([v for _, v in found], np.float64).reshape(len(found), dim)
            norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
            m = m / np.where(norm > 0, norm, 1)
            return keys_type, [[k for k, _ in found]], [dim], [m.tobytes()]

        for batch in batches:
            keys_type = pa.list_(batch.column(0).type)
            for key, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if vec is None or any(x is None for x in vec):
                    continue
                found = held.setdefault(len(vec), [])
                found.append((key, vec))
                if len(found) == rows:
                    made = block(len(vec), held.pop(len(vec)))
                    yield pa.RecordBatch.from_arrays([pa.array(made[1], made[0]), pa.array(made[2], pa.int32()), pa.array(made[3], pa.binary())], ["keys", "dim", "m"])
        for dim, found in held.items():
            made = block(dim, found)
            yield pa.RecordBatch.from_arrays([pa.array(made[1], made[0]), pa.array(made[2], pa.int32()), pa.array(made[3], pa.binary())], ["keys", "dim", "m"])

    return run


def _best_of_block(k: int, digits: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                dim = columns["dim"][i].as_py()
                m, q = (np.frombuffer(columns[c][i].as_py(), np.float64).reshape(-1, dim) for c in ("m", "q_m"))
                keys, q_keys = columns["keys"][i].values, columns["q_keys"][i].values
                row_no = keys.field("row_no").to_numpy(zero_copy_only=False)
                unit = keys.field("unit_id").dictionary_encode().indices.to_numpy(zero_copy_only=False)
                scores = np.round(q @ m.T, digits)
                taken, asked, score = [], [], []
                for j in range(len(q)):
                    order = np.lexsort((row_no, -scores[j]))
                    _, first = np.unique(unit[order], return_index=True)  # the best part of each unit
                    pick = order[np.sort(first)[:k]]
                    taken.append(pick)
                    asked.append(np.full(len(pick), j))
                    score.append(scores[j, pick])
                chosen, who = keys.take(pa.array(np.concatenate(taken))), q_keys.take(pa.array(np.concatenate(asked)))
                yield pa.RecordBatch.from_arrays(
                    [who.field("qid"), *(chosen.field(c) for c in ("unit_id", "part_id", "row_no")), pa.array(np.concatenate(score))], ["qid", "unit_id", "part_id", "row_no", "score"]
                )

    return run


def dense_ranked(vectors: DataFrame, queries: DataFrame, limit: int, digits: int = DIGITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """qid, unit_id, part_id, row_no, score, rank: by exact cosine, the `limit` best units of each query, each by its best
    part; of equal scores (after rounding) the smaller row_no. vectors: part_id, unit_id, row_no, vec; queries: qid, vec.

    Blocks of queries meet blocks of vectors by an equi-join on the query block's number; a pair is one matrix product and
    gives `limit` rows a query. A unit that is among the best is so in the block of its best part.
    """
    key = F.struct("part_id", "unit_id", F.col("row_no").cast("long").alias("row_no"))
    rows = vectors.select(key.alias("key"), F.col("vec").cast("array<double>").alias("vec"))
    asked = queries.select(F.struct("qid").alias("key"), F.col("vec").cast("array<double>").alias("vec"))
    blocks = lambda d, n: d.mapInArrow(_blocks(n), StructType([StructField("keys", ArrayType(d.schema["key"].dataType)), StructField("dim", IntegerType()), StructField("m", BinaryType())]))
    table, asked = blocks(rows, block_rows), blocks(asked.coalesce(8), QUERY_BLOCK).select(F.col("keys").alias("q_keys"), "dim", F.col("m").alias("q_m"))
    size = asked.agg(F.sum(F.octet_length("q_m"))).first()[0] or 0
    pairs = table.join(F.broadcast(asked) if size <= BROADCAST_BYTES else asked, "dim")
    schema = StructType([queries.schema["qid"], *[StructField(c, vectors.schema[c].dataType) for c in ("unit_id", "part_id")], StructField("row_no", LongType()), StructField("score", DoubleType())])
    return rank_units(pairs.mapInArrow(_best_of_block(limit, digits), schema), limit, digits=digits)


def check_dimension(vectors: DataFrame, dim: int) -> None:
    wrong = vectors.filter(F.size("vec") != dim).limit(1).collect()
    if wrong:
        raise ValueError(f"vectors of {len(wrong[0]['vec'])} components where {dim} are expected")


# ---- ranking ----


def rank_units(scored: DataFrame, limit: int, positive_only: bool = False, digits: int = DIGITS) -> DataFrame:
    """qid, unit_id, part_id, row_no, score, rank. scored: qid, unit_id, part_id, row_no, score. Each unit is represented
    by its best part; of equal scores the smaller row_no. The best parts are an aggregation with partial results."""
    kept = scored.filter("score > 0") if positive_only else scored
    order = F.struct(F.round("score", digits).alias("score"), (-F.col("row_no")).alias("back"))
    best = kept.groupBy("qid", "unit_id").agg(F.max(order).alias("o"), F.max_by("part_id", order).alias("part_id"))
    best = best.select("qid", "unit_id", "part_id", (-F.col("o.back")).alias("row_no"), F.col("o.score").alias("score"))
    across = Window.partitionBy("qid").orderBy(F.desc("score"), "row_no")
    return best.withColumn("rank", F.row_number().over(across)).filter(F.col("rank") <= limit)


def fuse(rankings: dict[str, DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: qid, unit_id, score, part_id, stage_ranks, rank. Each ranking: qid, unit_id, part_id, rank.

    A unit's terms are added in order of rank, so that symmetric ranks tie exactly. Order: score, best rank, unit_id. The
    representing part is that of the best rank, of equals that of the ranking first by name.
    """
    every = None
    for name, r in rankings.items():
        one = r.select("qid", "unit_id", "part_id", "rank", F.lit(name).alias("stage"))
        every = one if every is None else every.unionByName(one)
    together = every.groupBy("qid", "unit_id").agg(
        F.array_sort(F.collect_list("rank")).alias("ranks"),
        F.min_by("part_id", F.struct("rank", "stage")).alias("part_id"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "rank")))).alias("stage_ranks"),
    )
    score = F.aggregate("ranks", F.lit(0.0), lambda a, r: a + F.lit(1.0) / (F.lit(k) + r))
    fused = together.select("qid", "unit_id", score.alias("score"), F.element_at("ranks", 1).alias("best"), "part_id", "stage_ranks")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "best", "unit_id")
    return fused.withColumn("rank", F.row_number().over(order)).drop("best")


def rerank_head(ranked: DataFrame, scores: DataFrame, candidates: int = 30) -> DataFrame:
    """`ranked` (qid, unit_id, rank, score) with the first `candidates` put in order of `scores` (qid, unit_id, rerank);
    of equals, as before. The tail follows unchanged."""
    both = ranked.join(scores, ["qid", "unit_id"], "left")
    head = F.col("rank") <= candidates
    key = F.when(head, F.coalesce("rerank", F.lit(float("-inf"))))
    order = Window.partitionBy("qid").orderBy(F.when(head, 0).otherwise(1), F.desc_nulls_last(key), "rank")
    return both.withColumn("score", F.when(head, F.col("rerank")).otherwise(F.col("score"))).withColumn("new", F.row_number().over(order)).drop("rank", "rerank").withColumnRenamed("new", "rank")


def overlap_score(query_tokens: Column, doc_tokens: Column) -> Column:
    """A reranker without a model: the share of the query's distinct tokens that the document has."""
    q = F.array_distinct(query_tokens)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, doc_tokens)) / F.size(q)).otherwise(F.lit(0.0))


class OverlapReranker:
    """A reranker without a model, in the form that one with a model takes: a name, and scores in [0, 1] for pairs."""

    name = "overlap"

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]:
        from gleanwork.functions.text import tokenize_text

        out = []
        for query, text in pairs:
            q, t = set(tokenize_text(query)), set(tokenize_text(text))
            out.append(len(q & t) / len(q) if q else 0.0)
        return out


def probability_of_yes(yes: float, no: float) -> float:
    """What a generative reranker's logits for yes and no say."""
    return 1 / (1 + math.exp(max(-700.0, min(700.0, no - yes))))


def sigmoid(logit: float) -> float:
    """What a cross-encoder's logit says."""
    return probability_of_yes(logit, 0.0)


def rerank_scores(head: DataFrame, reranker: Callable[[list[tuple[str, str]]], list[float]], batch: int = 16, most_tokens: int = 4096, counter=None) -> DataFrame:
    """qid, unit_id, rerank, truncated. head: qid, unit_id, query, text. Texts of more than most_tokens are cut, and say so.
    `reranker` scores a batch of pairs; one that fails gives no scores (null), and its units keep their order behind the others.
    `counter`: counts and cuts tokens (see operators.units.CharCounter)."""
    from gleanwork.operators.units import CharCounter

    counter = counter or CharCounter()

    def run(frames):
        import pandas as pd

        for pdf in frames:
            texts, cut = [], []
            for t in pdf["text"].fillna(""):
                over = counter.count(t) > most_tokens
                cut.append(over)
                texts.append(t[: counter.offsets(t)[most_tokens]] if over else t)
            pairs, scores = list(zip(pdf["query"].fillna(""), texts)), []
            for k in range(0, len(pairs), batch):
                try:
                    scores += [float(x) for x in reranker(pairs[k : k + batch])]
                except Exception:
                    scores += [None] * len(pairs[k : k + batch])
            yield pd.DataFrame({"qid": pdf["qid"], "unit_id": pdf["unit_id"], "rerank": pd.Series(scores, dtype="float64"), "truncated": cut})

    schema = StructType([head.schema["qid"], head.schema["unit_id"]]).add("rerank", "double").add("truncated", "boolean")
    return head.select("qid", "unit_id", "query", "text").mapInPandas(run, schema)


def least_rerank_score(hits: DataFrame, least: float) -> DataFrame:
    """Without the reranked hits below `least` (0: off); hits that weren't reranked stay. hits: score, reranked (boolean)."""
    return hits if least <= 0 else hits.filter(~F.coalesce("reranked", F.lit(False)) | (F.col("score") >= least))


def keep_above_mean_share(hits: DataFrame, share: float = 0.3) -> DataFrame:
    """Hits of at least a share of their query's mean score; a query that would lose all keeps all."""
    w = Window.partitionBy("qid")
    marked = hits.withColumn("ok", F.col("score") >= share * F.avg("score").over(w)).withColumn("any", F.max("ok").over(w))
    return marked.filter("ok or not any").drop("ok", "any")


# ---- filters ----

SOURCE_ALIASES = {"teams_chat": "chat"}
PEOPLE = ["participants", "recipients", "recipient_names", "cc", "cc_names", "parent_recipients"]
PEOPLE_SINGLE = ["sender", "sender_name", "author", "parent_sender"]


def filter_condition(columns: dict[str, str], filters: dict) -> Column:
    """One predicate for a filter dict; `columns` maps names to types (as df.dtypes gives them). Values that are None,
    empty or an empty list don't count, nor do keys that begin with $. It is a plain Column: Catalyst pushes it down."""
    listed = lambda v: list(v) if isinstance(v, (list, tuple, set)) else [v]
    start = F.substring(F.coalesce("date", F.lit("")), 1, 10) if "date" in columns else F.lit("")
    end = F.substring(F.coalesce(F.nullif(F.col("date_end"), F.lit("")), F.col("date"), F.lit("")), 1, 10) if "date_end" in columns else start
    out = F.lit(True)
    for key, value in filters.items():
        if value is None or value == "" or value == [] or key.startswith("$"):
            continue
        if key in ("source_type", "unit_type"):
            one = F.col("unit_type").isin([SOURCE_ALIASES.get(v, v) for v in listed(value)])
        elif key == "_date_gte":
            one = (start != "") & (end >= value)
        elif key == "_date_lte":
            one = (start != "") & (start <= value)
        elif key == "_date_eq":
            one = (start != "") & (start <= value) & (end >= value)
        elif key == "participants":
            names = [F.concat_ws("\n", F.col(c)) for c in PEOPLE if c in columns] + [F.coalesce(F.col(c), F.lit("")) for c in PEOPLE_SINGLE if c in columns]
            people = F.lower(F.concat_ws("\n", *names))
            one = _any([people.contains(str(v).lower()) for v in listed(value)])
        elif key in ("author", "last_modified_by"):
            one = _any([F.lower(F.coalesce(F.col(key), F.lit(""))).contains(str(v).lower()) for v in listed(value)])
        elif key not in columns:
            one = F.lit(False)
        elif columns[key].startswith("array"):
            one = F.arrays_overlap(F.col(key), F.array(*[F.lit(v) for v in listed(value)]))
        else:
            one = F.col(key).isin(listed(value))
        out = out & F.coalesce(one, F.lit(False))
    return out


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def apply_filters(parts: DataFrame, filters: dict) -> DataFrame:
    return parts.filter(filter_condition(dict(parts.dtypes), filters))


# ---- vector reuse ----


def reusable_vectors(inputs: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inputs with the vector stored for the same part and input, inputs without one). inputs: part_id, input_hash."""
    key = ["part_id", "input_hash"]
    return inputs.join(stored.select(*key, "vec"), key), inputs.join(stored.select(*key), key, "left_anti")


def input_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 16)

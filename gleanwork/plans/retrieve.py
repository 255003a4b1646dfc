"""Retrieval from end to end, and the sources that an answer is written from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.operators.search import (
    RetrievalConfig, apply_filters, bm25_scores, dense_ranked, fuse, least_rerank_score, overlap_score, rank_units, rerank_head, rerank_scores, score_postings,
)

# ---- fixed values ----
CITATION = r"\[출처\s*(\d+)\]"
REFUSALS = ["찾을 수 없습니다", "검색 결과가 없습니다", "자료에서 해당", "확인할 수 없습니다"]
LABELS = {"email": "이메일", "teams_chat": "Teams 채팅", "chat": "Teams 채팅", "document": "문서", "attachment": "첨부파일"}
# ---- end of fixed values ----


def retrieve(
    queries: DataFrame, parts: DataFrame, config: RetrievalConfig | None = None, filters: dict | None = None, index: dict | None = None, reranker=None
) -> DataFrame:
    """qid, unit_id, rank, score, part_id, stage_ranks, reranked for all queries in one job.

    queries: qid, tokens and, for dense retrieval, vec; with a reranker, text. parts: part_id, unit_id, row_no, what filters
    name and, without an index, tokens and vec. index: the stored postings, terms, vectors and n_parts (see open_index), so that
    no text is tokenized again. Statistics come from all parts; filters choose among the candidates.
    reranker: scores pairs of texts (see operators.search.rerank_scores); without one, the share of the query's tokens counts.
    """
    config = config or RetrievalConfig()
    allowed = (apply_filters(parts, filters) if filters else parts).select("part_id", "unit_id", "row_no")
    single = config.use_bm25 != config.use_dense
    rankings = {}
    if config.use_bm25:
        scored = score_postings(index, queries, index["n_parts"]) if index else bm25_scores(parts.select("part_id", "tokens"), queries)
        rankings["bm25"] = rank_units(scored.join(allowed, "part_id"), config.depth if single else config.k_bm25, positive_only=True)
    if config.use_dense:
        vectors = (index["vectors"] if index else parts).select("part_id", "vec").join(allowed, "part_id")
        rankings["dense"] = dense_ranked(vectors, queries.select("qid", "vec"), config.depth if single else config.k_dense)
    if single:
        (name, only), = rankings.items()
        ranked = only.select("qid", "unit_id", "rank", "score", "part_id", F.create_map(F.lit(name), F.col("rank")).alias("stage_ranks"))
    else:
        ranked = fuse(rankings, config.rrf_k)
    ranked = ranked.filter(F.col("rank") <= config.depth).withColumn("reranked", F.lit(False))
    if config.rerank:
        head = ranked.filter(F.col("rank") <= config.rerank_candidates).select("qid", "unit_id", "part_id")
        if reranker is not None:
            pairs = head.join(parts.select("part_id", F.col("content").alias("text")), "part_id").join(queries.select("qid", F.col("text").alias("query")), "qid")
            scores = rerank_scores(pairs, reranker).select("qid", "unit_id", "rerank")
        else:
            tokens = index["parts"] if index else parts
            pairs = head.join(tokens.select("part_id", "tokens"), "part_id").join(queries.select("qid", F.col("tokens").alias("q")), "qid")
            scores = pairs.select("qid", "unit_id", overlap_score(F.col("q"), F.col("tokens")).alias("rerank"))
        ranked = rerank_head(ranked.withColumn("reranked", F.col("rank") <= config.rerank_candidates), scores, config.rerank_candidates)
        ranked = least_rerank_score(ranked, config.rerank_min_score)
    return ranked.select("qid", "unit_id", "rank", "score", "part_id", "stage_ranks", "reranked")


def open_index(store, case: str, embed_model: str | None = None, profile: str | None = None) -> dict:
    """The tables of a case's index and n_parts, as retrieve() takes them. profile: the vectors of another embedding."""
    tables = store.load(case, embed_model)
    if profile is not None:
        tables["vectors"] = store.load_profile(case, profile)
    return {**tables, "n_parts": tables["parts"].select("part_id").count()}


def sources(hits: DataFrame, parts: DataFrame, limit: int = 5, least_length: int = 20) -> DataFrame:
    """hits joined with their representing parts, without those of fewer than `least_length` characters, `limit` a query."""
    from pyspark.sql import Window

    both = hits.join(parts.drop("unit_id"), "part_id").filter(F.length("content") >= least_length)
    w = Window.partitionBy("qid").orderBy("rank")
    return both.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit)


def source_context(columns: list[str]) -> Column:
    """`[header]` and content of a source; columns that it lacks are left out."""
    has = lambda c: F.nullif(F.col(c), F.lit("")) if c in columns else F.lit(None).cast("string")
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, 5), ", ")) if c in columns else F.lit(None).cast("string")
    kind = F.lit(None).cast("string")
    for k, v in LABELS.items():
        kind = F.when(F.col("source_type") == k, v).otherwise(kind)
    show = lambda label, v: F.when(v.isNotNull(), F.concat(F.lit(label + ": "), v))
    mail = F.col("source_type") == "email"
    changed = lambda a, b: F.when(has(a).isNotNull() & ~has(a).eqNullSafe(has(b)), has(a))
    header = F.concat_ws(
        " | ",
        show("유형", F.coalesce(kind, has("source_type"))), show("파일", has("filename")), show("제목", has("subject")), show("날짜", has("date")),
        F.when(mail, show("From", has("sender"))), F.when(mail, show("To", listed("recipients"))), F.when(mail, show("Cc", listed("cc"))),
        F.when(mail, show("첨부", listed("attachments"))), F.when(~mail, show("작성자", has("author"))),
        F.when(~mail, show("마지막 수정", changed("last_modified_by", "author"))), F.when(~mail, show("생성일", has("created_date"))),
        F.when(~mail, show("수정일", changed("last_modified", "created_date"))), F.when(~mail, show("참여자", listed("participants"))),
    )
    return F.concat(F.lit("["), F.when(header == "", "출처 불명").otherwise(header), F.lit("]\n"), F.col("content"))


def prompts(chosen: DataFrame, empty: str = "(검색된 자료가 없습니다)") -> DataFrame:
    """qid, context: the sources of each query, numbered, between rules."""
    one = F.concat(F.lit("[출처 "), F.col("n").cast("string"), F.lit("]\n"), F.col("context"))
    return chosen.groupBy("qid").agg(F.coalesce(F.array_join(F.array_sort(F.collect_list(F.struct("n", one.alias("t"))))["t"], "\n\n---\n\n"), F.lit(empty)).alias("context"))


def check_citations(answer: Column, n_sources: Column) -> Column:
    """n_citations, invalid (sorted, distinct numbers that no source has), uncited (no citation, and no refusal)."""
    text = F.coalesce(answer, F.lit(""))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), lambda x: x.cast("int"))
    refused = F.lit(False)
    for phrase in REFUSALS:
        refused = refused | text.contains(phrase)
    return F.struct(
        F.size(numbers).alias("n_citations"), F.array_sort(F.array_distinct(F.filter(numbers, lambda x: (x < 1) | (x > n_sources)))).alias("invalid"),
        ((F.size(numbers) == 0) & ~refused).alias("uncited"),
    )


def keyword_overlap(query_topics: Column, text: Column) -> Column:
    """Whether any of the query's topics occurs in the sources' text."""
    return F.exists(query_topics, lambda t: F.lower(text).contains(F.lower(t)))

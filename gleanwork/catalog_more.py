"""More registered queries: text functions, identifiers, filters, reports, cases and answers, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanwork.catalog import (
    JUDGED, LINES, RUNS, bm25_ranked, bm25_sql, dense_sql, event_parts, fused_sql, judgments, label_runs, label_scores, messages, query, questions, read, sessions_sql, settled, vectors,
)
from gleanwork.functions import ids, mail
from gleanwork.functions import text as X
from gleanwork.operators import analytics as A
from gleanwork.operators import evaluation as E
from gleanwork.operators import search as S
from gleanwork.operators import units as U
from gleanwork.plans import harness as H
from gleanwork.plans import queries as Q
from gleanwork.plans import retrieve as R
from gleanwork.plans.index import embedding_parity, orphans
from gleanwork.sources import files, tables
from gleanwork.streaming.sessions import session_stream


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


# ---- text ----


@query(
    """with w as (select doc_id, lower(unnest(regexp_extract_all(text, '[a-zA-Z]{3,}'))) as w, generate_subscripts(regexp_extract_all(text, '[a-zA-Z]{3,}'), 1) as i from documents where length(trim(text)) >= 10),
c as (select doc_id, w, count(*) as n, min(i) as first from w where w not in ("""
    + ", ".join(f"'{w}'" for w in X.EN_STOPWORDS)
    + """) group by all)
select doc_id, w as topic, cast(row_number() over (partition by doc_id order by n desc, first) as integer) as rank from c qualify rank <= 5"""
)
def unit_topics(spark, sf_dir):
    return X.topics_of(docs(spark, sf_dir).select("doc_id", "text"), "doc_id")


@query("select doc_id, cast(floor(greatest(octet_length(encode(text)) / 3, length(text) / 2)) as bigint) as tokens from documents")
def llm_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.llm_token_estimate(F.col("text")).alias("tokens"))


@query(
    r"""with s as (select doc_id, text, greatest(len(regexp_extract_all(text, '\p{L}')), 1)::double as letters from documents)
select doc_id, length(text) as chars, octet_length(encode(text)) as bytes, round(100 * len(regexp_extract_all(text, '[가-힣ᄀ-ᇿ㄰-㆏]')) / letters, 1) as hangul,
  round(100 * len(regexp_extract_all(text, '[A-Za-z]')) / letters, 1) as latin from s"""
)
def text_statistics(spark, sf_dir):
    s = docs(spark, sf_dir).select("doc_id", X.text_stats(F.col("text")).alias("s"))
    return s.select("doc_id", "s.chars", "s.bytes", "s.hangul", "s.latin")


@query(
    r"""with s as (select doc_id, substr(text, 1, 3000) as t from documents), c as (select doc_id, t, len(regexp_extract_all(t, '[가-힣ㄱ-ㆎ]')) as h, len(regexp_extract_all(t, '\p{L}')) as letters from s)
select doc_id, case when letters = 0 then 'unknown' when h / letters >= 0.2 then 'ko' when len(regexp_extract_all(t, '[ěščřžůťďňĚŠČŘŽŮŤĎŇ]')) >= 2 then 'cs'
  when len(regexp_extract_all(t, '[ñÑ]')) >= 1 or len(regexp_extract_all(t, '[áéíóúÁÉÍÓÚ]')) >= 3 then 'es' else 'en' end as lang from c"""
)
def script_languages(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.script_language(F.col("text")).alias("lang"))


@query(
    r"""with c as (select doc_id, len(regexp_extract_all(substr(text, 1, 3000), '[가-힣ㄱ-ㆎ]')) as h, len(regexp_extract_all(substr(text, 1, 3000), '[A-Za-z]')) as l from documents)
select doc_id, case when h / (h + l) >= 0.7 then 'ko' when h / (h + l) <= 0.1 then 'en' else 'mixed' end as lang from c where h + l >= 5"""
)
def language_groups(spark, sf_dir):
    d = docs(spark, sf_dir).filter(F.regexp_count(F.substring("text", 1, 3000), F.lit("[A-Za-z가-힣ㄱ-ㆎ]")) >= 5)
    return d.select("doc_id", X.language_group(F.col("text")).alias("lang"))


@query(
    r"""select doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b-\x1f\x7f-\x9f\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}]', '', 'g'), '[ \t]+', ' ', 'g'), ' ') as text from documents"""
)
def embedding_input(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.sanitize(F.col("text")).alias("text"))


@query("select doc_id, list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) as bigrams from (select doc_id, regexp_extract(text, '[A-Za-z]{2,}') as w from documents) where length(w) >= 2")
def letter_bigrams(spark, sf_dir):
    """The windows that runs of Chinese and Japanese are cut into, over a document's first Latin word."""
    w = docs(spark, sf_dir).select("doc_id", F.regexp_extract("text", "[A-Za-z]{2,}", 0).alias("w")).filter(F.length("w") >= 2)
    return w.select("doc_id", X.cjk_bigrams(F.col("w")).alias("bigrams"))


@query("select lang, strip_accents(lower(w)) as word, count(*) as n from (select lang, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as w from documents) where not contains(w, 'ß') and not contains(w, '×') and not contains(w, '÷') group by all")
def folded_words(spark, sf_dir):
    w = docs(spark, sf_dir).select("lang", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("w")).filter("w not like '%ß%' and w not like '%×%' and w not like '%÷%'")
    once = w.groupBy("lang", "w").agg(F.count("*").alias("n"))  # each different word goes to Python once
    return once.groupBy("lang", X.fold("w").alias("word")).agg(F.sum("n").alias("n"))


@query(
    r"""with h as (select conv_id, 'From: ' || conv_id || chr(10) || 'Subject: x' || chr(10) || chr(10) || min(text) as m from conversations group by conv_id)
select conv_id, substr(m, instr(m, chr(10) || chr(10)) + 2) as body from h"""
)
def bodies_of_messages(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("text").alias("t"))
    m = F.concat(F.lit("From: "), F.col("conv_id").cast("string"), F.lit("\nSubject: x\n\n"), F.col("t"))
    return c.select("conv_id", mail.body_of_message(m).alias("body"))


SUBJECTS = ["FW: plan", "re: plan", " Fwd : x", "(광고) sale", "[ 광 고 ] x", "전달: y", "광고 없이", "WG: z", "forward"]


@query(
    "with s as (select p_partkey, [" + ", ".join(f"'{x}'" for x in SUBJECTS) + r"""][p_partkey % 9 + 1] as t from part)
select p_partkey, regexp_matches(t, '(?i)^\s*(?:fw|fwd|전달|转发|轉寄|rv|př|wg)\s*[:：]') as forwarded, regexp_matches(t, '^\s*[\[(（【〔<［]\s*광\s*고\s*[\])）】〕>］]') as advert from s"""
)
def subject_predicates(spark, sf_dir):
    t = F.element_at(F.lit(SUBJECTS), (F.col("p_partkey") % 9 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", mail.is_forwarded(t).alias("forwarded"), mail.is_ad_subject(t).alias("advert"))


# ---- identifiers and headers ----


@query(
    """select c_custkey, case when c_custkey % 2 = 0 then 'box/' || c_custkey || '__' || c_mktsegment else 'box/' || c_custkey end as room,
  case when c_custkey % 3 = 0 then 'a/b/c/x' || c_custkey || '.txt' when c_custkey % 3 = 1 then 'b/c/d/' || c_custkey || '.txt' else '/other/' || c_custkey || '.txt' end as path from customer"""
)
def rooms_and_paths(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    folder = F.concat(F.lit("box/"), k)
    topic = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("")
    root = F.when(F.col("c_custkey") % 3 == 0, "/data/a/b/c/x").when(F.col("c_custkey") % 3 == 1, "/data/a/b/c/d/").otherwise("/other/")
    path = files.relative_path(F.concat(root, k, F.lit(".txt")), ["/data/a/b/c/d", "/data/a/b/c"])
    path = F.when(F.col("c_custkey") % 3 == 0, files.relative_path(F.concat(F.lit("/data/a/b/c/x"), k, F.lit(".txt")), ["/data/a/b/c"])).otherwise(path)
    return read(spark, sf_dir, "customer").select("c_custkey", ids.room_key(folder, topic).alias("room"), path.alias("path"))


@query("select 'f/' || doc_id as path, 'f/' || doc_id || '|' || n_chars || '|' || (1700000000000000 + doc_id * 1000000) as mark from documents")
def fingerprints(spark, sf_dir):
    d = docs(spark, sf_dir).select(F.concat(F.lit("f/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("length"), F.timestamp_seconds(1_700_000_000 + F.col("doc_id")).alias("modificationTime"))
    return d.select("path", files.fingerprint().alias("mark"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT00:00:00') as at from orders")
def pdf_dates(spark, sf_dir):
    """As PDF files write them: D:YYYYMMDD and a zone after missing digits."""
    return read(spark, sf_dir, "orders").select("o_orderkey", files.pdf_date(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"))).alias("at"))


@query(
    """select doc_id, '[문서] f' || doc_id || '.txt' || case when doc_id % 2 = 0 then ' | p.' || (doc_id % 5 + 1) || '/5' else '' end || case when lang <> 'en' then ' | 작성자: ' || lang else '' end
  || ' | 수정일: 2024-03-' || lpad((doc_id % 28 + 1)::varchar, 2, '0') as header from documents"""
)
def document_headers(spark, sf_dir):
    k = F.col("doc_id").cast("string")
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    d = docs(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("f"), k, F.lit(".txt")).alias("filename"), F.when(F.col("lang") != "en", F.col("lang")).alias("author"), F.lit("").alias("last_modified_by"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("p."), (F.col("doc_id") % 5 + 1).cast("string"), F.lit("/5"))).alias("position"), F.concat(F.lit("2024-03-"), day, F.lit("T10:00:00")).alias("last_modified"),
    )
    return d.select("doc_id", U.document_header().alias("header"))


@query(
    """select o_orderkey, strftime(o_orderdate + interval 9 hour, '%Y-%m-%d %H:%M') as shown, strftime(o_orderdate, '%Y-%m-%d') as day from orders"""
)
def displayed_times(spark, sf_dir):
    """A time with an offset is shown in the display zone, a naive one as it is."""
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return read(spark, sf_dir, "orders").select("o_orderkey", U.format_time(F.concat(at, F.lit("Z"))).alias("shown"), U.format_date(at).alias("day"))


@query("select p_partkey, case when p_size % 8 = 0 then '' when p_size % 8 <= 5 then array_to_string(list_transform(range(1, p_size % 8 + 1), lambda i: 'n' || i), ', ') else 'n1, n2, n3, n4, n5 외 ' || (p_size % 8 - 5) || '명' end as names from part")
def limited_names(spark, sf_dir):
    n = (F.col("p_size") % 8).cast("int")
    every = F.transform(F.slice(F.array(*[F.lit(k) for k in range(1, 8)]), 1, n), lambda i: F.concat(F.lit(" n"), i.cast("string")))
    return read(spark, sf_dir, "part").select("p_partkey", U.join_limited(every).alias("names"))


@query(f"with l as ({LINES}) select doc_id, string_agg(line, chr(10) order by n) as text from l group by doc_id")
def units_from_parts(spark, sf_dir):
    parts = docs(spark, sf_dir).select(F.col("doc_id").alias("unit_id"), F.posexplode(F.split("text", "\n", -1)).alias("part_no", "text"))
    return U.unit_text(parts).select(F.col("unit_id").alias("doc_id"), "text")


# ---- filters and ranking ----


@query("select event_id as part_id from events where contains(lower(event_type), 'cli') or contains(lower(event_type), 'vie')")
def filter_author(spark, sf_dir):
    return S.apply_filters(event_parts(spark, sf_dir), {"author": ["CLI", "vie"], "participants": []}).select("part_id")


@query("select event_id as part_id from events where event_id % 10 = 3 and ('User' || user_id) in ('User1', 'User2', 'User3') and strftime(ts, '%Y-%m-%d') <= '2024-01-20'")
def filter_other_keys(spark, sf_dir):
    """A plain column, an array column, a date; a key that isn't a column lets nothing through."""
    e = event_parts(spark, sf_dir).withColumn("last", F.col("part_id") % 10).withColumn("tags", F.col("participants"))
    found = S.apply_filters(e, {"last": [3], "tags": ["User1", "User2", "User3"], "_date_lte": "2024-01-20", "$or": [1]})
    return found.unionByName(S.apply_filters(e, {"nowhere": "x"})).select("part_id")


@query(bm25_sql() + "select qid, doc_id as unit_id from (select *, avg(score) over (partition by qid) as m, max(score) over (partition by qid) as top from bm25) where score >= 1.02 * m or top < 1.02 * m")
def above_mean_share(spark, sf_dir):
    return S.keep_above_mean_share(bm25_ranked(spark, sf_dir, 10), 1.02).select("qid", "unit_id")


@query("select o_orderkey from orders where o_orderkey % 2 = 1 or o_totalprice / 500000 >= 0.3")
def least_rerank_scores(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 500000).alias("score"), (F.col("o_orderkey") % 2 == 0).alias("reranked"))
    return S.least_rerank_score(o, 0.3).select("o_orderkey")


@query(bm25_sql(limit=10) + "select qid, doc_id as unit_id, cast(row_number() over (partition by qid order by rank) as integer) as n from bm25 join documents using (doc_id) where length(text) >= 900 qualify n <= 5")
def answer_sources(spark, sf_dir):
    parts = docs(spark, sf_dir).select(F.col("doc_id").alias("part_id"), F.col("doc_id").alias("unit_id"), F.col("text").alias("content"))
    return R.sources(bm25_ranked(spark, sf_dir, 10).drop("row_no"), parts, 5, 900).select("qid", "unit_id", "n")


@query(fused_sql(dense_sql(50, 9, "(select * from embeddings where vec_id in (select doc_id from documents))")) + "select qid, unit_id, cast(rank as integer) as rank, round(s, 9) as score from fr where rank <= 100")
def retrieve_hybrid(spark, sf_dir):
    """The whole retrieval: parts with tokens and vectors, questions with either or both."""
    tokens = docs(spark, sf_dir).select(F.col("doc_id").alias("part_id"), F.col("doc_id").alias("unit_id"), F.col("doc_id").alias("row_no"), X.latin_words(F.col("text")).alias("tokens"))
    v = vectors(spark, sf_dir).select("part_id", "vec")
    asked = v.filter("part_id % 20 = 0").select(F.concat(F.lit("q"), (F.col("part_id") + 1).cast("string")).alias("qid"), "vec")
    both = questions(spark).join(asked, "qid", "full").select("qid", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), F.col("vec").cast("array<double>").alias("vec"))
    found = R.retrieve(both, tokens.join(v, "part_id", "left"), S.RetrievalConfig())
    return found.select("qid", "unit_id", "rank", F.round("score", 9).alias("score"))


@query(bm25_sql(limit=100) + "select qid, doc_id as unit_id, cast(rank as integer) as rank from bm25")
def retrieve_lexical(spark, sf_dir):
    """One retriever alone goes as deep as the configuration says."""
    parts = docs(spark, sf_dir).select(F.col("doc_id").alias("part_id"), F.col("doc_id").alias("unit_id"), F.col("doc_id").alias("row_no"), X.latin_words(F.col("text")).alias("tokens"))
    return R.retrieve(questions(spark), parts, S.RetrievalConfig(use_dense=False)).select("qid", "unit_id", "rank")


@query("select c_custkey, (contains(lower(c_mktsegment), 'build') or contains(lower(c_mktsegment), 'mach')) as overlaps from customer")
def keyword_overlaps(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", R.keyword_overlap(F.lit(["Build", "mach"]), F.col("c_mktsegment")).alias("overlaps"))


@query("with c as (select case when norm > 0 then d / norm end as c from (select list_dot_product(embedding::double[], [0.0::double] || embedding[2:]::double[]) as d, sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(embedding[2:]::double[], embedding[2:]::double[])) as norm from embeddings)) select count(*) as n, round(avg(c), 6) as mean, round(min(c), 6) as least, avg(c) >= 0.99 as passes from c")
def embedder_parity(spark, sf_dir):
    v = vectors(spark, sf_dir).select("part_id", F.col("vec").cast("array<double>").alias("vec"))
    other = v.select("part_id", F.transform("vec", lambda x, i: F.when(i == 0, 0.0).otherwise(x)).alias("vec"))
    return embedding_parity(v, other).select("n", F.round("mean", 6).alias("mean"), F.round("least", 6).alias("least"), "passes")


# ---- sessions, attachments ----


@query(sessions_sql(30) + "select room, min(ts) as \"start\", max(ts) as \"end\", count(*) as n_messages from s group by room, session")
def session_windows(spark, sf_dir):
    """The streaming form of sessions, over a table."""
    m = messages(spark, sf_dir).select("room", "ts")
    return session_stream(m).select("room", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n_messages")


@query("select 'a' || l_orderkey || '.' || l_linenumber as unit_id from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def orphan_attachments(spark, sf_dir):
    key = F.concat(F.lit("a"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    a = read(spark, sf_dir, "lineitem").select(key.alias("unit_id"), F.col("l_orderkey").alias("parent_unit_id"))
    return orphans(a, read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("unit_id"))).select("unit_id")


# ---- statistics and reports ----


@query("select case user_id % 3 when 0 then 'email' when 1 then 'chat' else 'document' end as unit_type, count(*) as n from events group by 1")
def units_by_type(spark, sf_dir):
    return A.units_by_type(event_parts(spark, sf_dir))


@query(
    """with t as (select greatest(1, round_even(length(text) / 2.0, 0))::int as b, (doc_id % 40)::int as h from documents)
select cast(sum((b <= 2048)::int) as bigint) as within_without_header, cast(sum((h + b <= 2048)::int) as bigint) as within_with_header, cast(sum((h + b > 4096)::int) as bigint) as over_rerank from t"""
)
def token_ceilings(spark, sf_dir):
    return A.token_ceilings(docs(spark, sf_dir), (F.col("doc_id") % 40).cast("int"), X.token_estimate(F.col("text")))


EXTENSIONS = [".PNG", "zip", "mp3", "exe", "heic", "7z"]


@query("select case ((p_partkey % 6)::int) when 0 then 'image' when 1 then 'archive' when 2 then 'media' when 3 then 'other' when 4 then 'image' else 'archive' end as kind, count(*) as n from part group by 1")
def excluded_groups(spark, sf_dir):
    e = F.element_at(F.lit(EXTENSIONS), (F.col("p_partkey") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "part").groupBy(A.excluded_group(e).alias("kind")).agg(F.count("*").alias("n"))


@query("select lang, cast(sum(length(text)) as bigint) as before, cast(sum(length(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as bigint) as after from documents group by lang")
def cleaning_effect(spark, sf_dir):
    d = docs(spark, sf_dir)
    return A.cleaning_effect(d.select("lang", F.length("text").alias("chars_before"), F.length(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("chars_after")))


@query("select l_returnflag as run, l_linestatus as stage, round(quantile_cont(l_extendedprice / 1000, 0.5), 6) as p50, round(quantile_cont(l_extendedprice / 1000, 0.95), 6) as p95, count(*) as n from lineitem group by all")
def latency_table(spark, sf_dir):
    return A.latency_table(read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("stage"), (F.col("l_extendedprice") / 1000).alias("seconds")))


@query("select lang, source, count(*) as n from documents group by all")
def cross_tab(spark, sf_dir):
    return A.cross_tab(docs(spark, sf_dir), "lang", "source")


CLASSES = ["A", "A'", "C", "D", "B", "E"]


@query(
    """with q as (select c_mktsegment as area, (c_custkey % 6)::int as k from customer)
select coalesce(area, 'total') as area, cast(sum((k = 0)::int) as bigint) as "A", cast(sum((k = 1)::int) as bigint) as "A'", cast(sum((k = 4)::int) as bigint) as "B", cast(sum((k = 2)::int) as bigint) as "C",
  cast(sum((k = 3)::int) as bigint) as "D", cast(sum((k = 5)::int) as bigint) as "E", count(*) as n from q group by rollup(area)"""
)
def query_composition(spark, sf_dir):
    k = F.element_at(F.lit(CLASSES), (F.col("c_custkey") % 6 + 1).cast("int"))
    q = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("qid"), F.lit("text").alias("text"), k.alias("support_class"), F.col("c_mktsegment").alias("area"))
    return H.composition(H.validate_queries(q))


@query(
    JUDGED + """, n as (select qid, 'g' || (substr(qid, 2)::int % 3) as g, sum((least(a, b) >= 1)::int) as rel, sum((least(a, b) = 2)::int) as top from pairs group by qid)
select coalesce(g, 'total') as g, count(*) as n, round(avg(rel), 6) as rel_mean, round(median(rel), 6) as rel_median, cast(max(rel) as bigint) as rel_max, round(avg(top), 6) as top_mean, round(median(top), 6) as top_median,
  cast(max(top) as bigint) as top_max, cast(sum((rel = 0)::int) as bigint) as none, cast(sum((rel > 10)::int) as bigint) as many from n group by rollup(g)"""
)
def relevant_distribution(spark, sf_dir):
    q = settled(spark, sf_dir)
    group = F.concat(F.lit("g"), (F.substring("qid", 2, 9).cast("int") % 3).cast("string"))
    return E.relevant_distribution(q.select("qid", group.alias("g")).distinct(), q, "g")


POOLED = RUNS + ", p as (select qid, unit_id, n_chars from (select qid, unit_id from runs where rank <= 5 group by all) join (select doc_id as unit_id, n_chars from documents) using (unit_id))"


@query(
    POOLED + """, per as (select qid, count(*) as n from p group by qid)
select (select count(*) from per) as queries, (select round(avg(n), 6) from per) as mean, (select min(n) from per) as least, (select max(n) from per) as most, count(*) as rows, count(distinct unit_id) as units,
  count(*) filter (n_chars > 1000) as cut_rows, count(distinct unit_id) filter (n_chars > 1000) as cut_units, count(*) filter (unit_id % 2 = 0) as translated_rows, count(distinct unit_id) filter (unit_id % 2 = 0) as translated_units from p"""
)
def pool_report(spark, sf_dir):
    p = E.pool(label_runs(spark, sf_dir), 5).select("qid", "unit_id")
    size = docs(spark, sf_dir).select(F.col("doc_id").alias("unit_id"), "n_chars")
    return E.pool_stats(p.select("qid").distinct(), p.join(size, "unit_id").withColumn("translated", F.col("unit_id") % 2 == 0), 1000)


@query(
    JUDGED + """, l as (select qid, case when lang = 'de' then 'ko' else lang end as lang, count(*) as n from pairs join documents on unit_id = doc_id where least(a, b) > 0 group by all),
k as (select qid, coalesce(sum(n) filter (lang = 'ko'), 0) as ko, max(case when lang <> 'ko' then {'n': n, 'l': lang} end) as o from l group by qid) select qid, case when coalesce(o.n, 0) > ko then o.l else 'ko' end as lang from k"""
)
def evidence_languages(spark, sf_dir):
    """With German in the place of Korean."""
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("unit_id"), F.when(F.col("lang") == "de", "ko").otherwise(F.col("lang")).alias("lang"))
    return E.evidence_language(settled(spark, sf_dir), d)


@query(JUDGED + "select qid, unit_id from pairs where a <> b")
def disputed_units(spark, sf_dir):
    return E.disputed(judgments(spark, sf_dir))


NDCG = RUNS + """, pos as (select *, row_number() over (partition by qid order by g desc, unit_id) as i from rel where g > 0),
ideal as (select qid, sum(case when i <= 10 then g / log2(i + 1.0) else 0 end) as idcg from pos group by qid),
h as (select run, qid, sum(case when rank <= 10 then g / log2(rank + 1.0) else 0 end) as dcg from runs join rel using (qid, unit_id) where g > 0 group by all),
sc as (select r.run, ideal.qid, round(coalesce(dcg, 0) / idcg, 6) as value from ideal cross join (select distinct run from runs) r left join h on h.run = r.run and h.qid = ideal.qid)
"""


@query(NDCG + "select 'id' as a, 'long' as b, count(*) as n, round(avg(x.value), 6) as mean_a, round(avg(y.value), 6) as mean_b from sc x join sc y using (qid) where x.run = 'id' and y.run = 'long'")
def comparison_table(spark, sf_dir):
    pairs = spark.createDataFrame([("id", "long")], "a string, b string")
    return E.comparison_table(label_scores(spark, sf_dir), pairs).select("a", "b", "n", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"))


@query(
    NDCG + """, f as (select *, 'g' || (substr(qid, 2)::int % 9) as g, 'h' || (substr(qid, 2)::int % 2) as h from sc), u as (select 'g' as grouping, g as value, qid, run, f.value as x from f union all select 'h', h, qid, run, f.value from f)
select grouping, value, count(distinct qid) as n, round(avg(x) filter (run = 'id'), 6) as id, round(avg(x) filter (run = 'long'), 6) as long, count(distinct qid) < 5 as small from u group by grouping, value"""
)
def breakdown_tables(spark, sf_dir):
    s = label_scores(spark, sf_dir)
    n = F.substring("qid", 2, 9).cast("int")
    facts = s.select("qid").distinct().select("qid", F.concat(F.lit("g"), (n % 9).cast("string")).alias("g"), F.concat(F.lit("h"), (n % 2).cast("string")).alias("h"))
    return E.breakdowns(s, facts, ["g", "h"], ["id", "long"])


@query(
    RUNS + """, r as (select rel.qid, rel.unit_id, max(case run when 'id' then rank end) as i, max(case run when 'long' then rank end) as l from rel left join runs using (qid, unit_id) where g = 2 group by all),
f as (select r.*, lang, n_chars, p.a <> p.b as disputed from r join documents on unit_id = doc_id join pairs p on p.qid = r.qid and p.unit_id = r.unit_id)
select qid, unit_id, array_to_string(list_filter([case when coalesce(l > 10, true) and i <= 10 then 'rerank_demotion' end, case when lang <> 'en' and coalesce(i > 10, true) then 'cross_lingual' end,
  case when unit_id % 7 = 0 or n_chars > 2000 then 'long_unit' end, case when disputed then 'disputed' end], lambda x: x is not null), ',') as hints from f where coalesce(l > 10, true)"""
)
def failure_causes(spark, sf_dir):
    runs = label_runs(spark, sf_dir)
    lost = E.missed(settled(spark, sf_dir), runs.filter("run = 'long'").select("qid", "unit_id", "rank"), runs, ["id", "long"])
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("unit_id"), F.col("lang").alias("unit_lang"), F.col("n_chars").alias("n_tokens"), F.when(F.col("doc_id") % 7 == 0, 2).otherwise(1).alias("n_parts"))
    marked = E.disputed(judgments(spark, sf_dir)).withColumn("is_disputed", F.lit(True))
    facts = lost.join(d, "unit_id").join(marked, ["qid", "unit_id"], "left").withColumn("query_lang", F.lit("en"))
    return E.failure_hints(facts, 2000, {"base": "long", "fused": "id", "lexical": "id"}).select("qid", "unit_id", F.array_join("hints", ",").alias("hints"))


@query(f"with l as ({LINES}), u as (select doc_id, sum(case when line = '' then 0 else greatest(1, round_even(length(line) / 2.0, 0)) end) as n from l group by doc_id) select round(quantile_cont(n, 0.95), 4) as p95 from u")
def unit_tokens_p95(spark, sf_dir):
    line = F.explode(F.split("text", "\n", -1)).alias("line")
    parts = docs(spark, sf_dir).select(F.col("doc_id").alias("unit_id"), line)
    return E.tokens_p95(parts.select("unit_id", F.when(F.col("line") == "", 0).otherwise(X.token_estimate(F.col("line"))).alias("n_tokens")))


@query("select c_custkey as qid, c_nationkey as unit_id, case when c_custkey % 3 = 0 then 'said' else 'new' end as category from customer")
def kept_annotations(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid"), F.col("c_nationkey").alias("unit_id"), F.lit("new").alias("category"))
    before = rows.filter("qid % 3 < 2").select("qid", "unit_id", F.when(F.col("qid") % 3 == 0, "said").otherwise("").alias("category"))
    return E.keep_annotations(rows, before, ["category"])


# ---- answers, usage, cases ----


@query("select doc_id, '[유형: 문서 | 파일: f' || doc_id || ' | 작성자: ' || lang || ']' || chr(10) || text as context from documents")
def source_contexts(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.lit("document").alias("source_type"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"), F.col("lang").alias("author"), F.col("text").alias("content"))
    return d.select("doc_id", R.source_context(d.columns).alias("context"))


@query("select conv_id as qid, string_agg('[출처 ' || (turn + 1) || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by turn) as context from conversations group by conv_id")
def answer_prompts(spark, sf_dir):
    return R.prompts(read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), (F.col("turn") + 1).alias("n"), F.col("text").alias("context")))


@query(
    """select c_custkey, case (c_custkey % 3)::int when 0 then 1 when 1 then 2 else 0 end as n_citations, case when c_custkey % 3 = 0 and c_custkey % 9 > 3 then array_to_string([c_custkey % 9], ',')
  when c_custkey % 3 = 1 then '7' else '' end as invalid, c_custkey % 6 = 2 as uncited from customer"""
)
def citation_checks(spark, sf_dir):
    k = F.col("c_custkey")
    cited = F.concat(F.lit("so it is [출처 "), F.greatest(k % 9, F.lit(1)).cast("string"), F.lit("]"))
    answer = F.when(k % 3 == 0, cited).when(k % 3 == 1, "see [출처 2] and [출처  7]").when(k % 6 == 2, "nothing named").otherwise("자료를 찾을 수 없습니다")
    c = read(spark, sf_dir, "customer").select("c_custkey", R.check_citations(answer, F.lit(3)).alias("c"))
    return c.select("c_custkey", "c.n_citations", F.array_join(F.transform("c.invalid", lambda x: x.cast("string")), ",").alias("invalid"), "c.uncited")


@query(
    """select o_orderkey, case when o_orderkey % 3 = 0 then o_orderkey % 100 when o_orderkey % 3 = 1 then o_orderkey % 50 else 3 end as input, cast(case when o_orderkey % 3 < 2 then 7 else 1 end as bigint) as output,
  case o_orderkey % 3 when 0 then 'usage_metadata' when 1 then 'server' else 'estimate' end as source from orders"""
)
def token_usage(spark, sf_dir):
    k = F.col("o_orderkey")
    usage = F.concat(F.lit('{"usage_metadata": {"input_tokens": '), (k % 100).cast("string"), F.lit(', "output_tokens": 7}}'))
    server = F.concat(F.lit('{"prompt_eval_count": '), (k % 50).cast("string"), F.lit(', "eval_count": 7}'))
    u = H.token_usage(F.when(k % 3 == 0, usage).when(k % 3 == 1, server).otherwise("{}"), F.lit("abcdef"), F.lit("ab"))
    return read(spark, sf_dir, "orders").select("o_orderkey", u.alias("u")).select("o_orderkey", "u.*")


@query("select distinct c_mktsegment as text, upper(c_mktsegment) || case when c_mktsegment < 'C' then '' else '!' end as translation, c_mktsegment >= 'C' as fresh from customer")
def translation_cache(spark, sf_dir):
    t = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("text"))
    cache = t.distinct().filter("text < 'C'").select(F.lit("m").alias("model"), F.sha1("text").alias("key"), F.upper("text").alias("translation"))
    return H.with_cache(t, cache, "m", lambda x: F.concat(F.upper(x), F.lit("!"))).select("text", "translation", "fresh")


def cases_of(spark, sf_dir):
    states = F.element_at(F.lit(list(tables.STATES)), (F.col("c_custkey") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("case_id"), F.col("c_name").alias("name"), states.alias("status"), F.array(F.lit("/x")).alias("sources"),
        F.lit(None).cast("string").alias("error"), F.lit("2020-01-01").cast("timestamp").alias("updated"), F.col("c_custkey").cast("long").alias("seq"),
    )


STATE_SQL = "case (c_custkey % 5)::int when 0 then 'created' when 1 then 'indexing' when 2 then 'ready' when 3 then 'error' else 'archived' end"


@query(f"select 'c' || c_custkey as case_id, case when c_custkey % 5 = 1 then 'error' else {STATE_SQL} end as status, case when c_custkey % 5 = 1 then 'stuck' end as error from customer")
def recovered_cases(spark, sf_dir):
    return tables.recover_stuck(cases_of(spark, sf_dir)).select("case_id", "status", "error")


@query(f"select 'c' || c_custkey as case_id, case when c_custkey = 2 then 'archived' else {STATE_SQL} end as status, case when c_custkey = 4 then '/x,/y' else '/x' end as sources from customer")
def changed_cases(spark, sf_dir):
    c = tables.change_status(cases_of(spark, sf_dir), "c2", "archived")
    return tables.add_sources(c, "c4", ["/y", "/x"]).select("case_id", "status", F.array_join("sources", ",").alias("sources"))


@query("select 'c' || c_custkey as case_id, c_name as name from customer where c_custkey % 5 = 2")
def ready_cases(spark, sf_dir):
    return tables.list_cases(cases_of(spark, sf_dir), "ready").select("case_id", "name")


@query("select p_partkey, round(100.0 * (p_size / 2)::int / p_size, 1)::double as percent, case when (p_size / 2)::int > 0 then round(60.0::double / (p_size / 2)::int * (p_size - (p_size / 2)::int), 1) end as eta, p_partkey % 300 > 120 as stalled from part")
def indexing_progress(spark, sf_dir):
    p = tables.progress(F.bround(F.col("p_size") / 2).cast("int"), F.col("p_size"), F.lit(60.0), F.col("p_partkey") % 300)
    return read(spark, sf_dir, "part").select("p_partkey", p.alias("p")).select("p_partkey", "p.*")


# ---- questions ----
#: Questions and what they mean, stated by hand.
PARSED = [
    ("2024년 3월 이메일에서 예산", "예산", "search", "email", "2024-03-01", "2024-04-01"),
    ("2023년 보고서 요약", "보고서 요약", "summarize", "document", "2023-01-01", "2023-12-31"),
    ("compare the budgets 2024-01-05 2024-02-06", "compare the budgets 2024-01-05 2024-02-06", "compare", "", "2024-01-05", "2024-02-06"),
    ("harbour cranes", "harbour cranes", "search", "", "", ""),
]


@query("select * from (values " + ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in PARSED) + ") as t(question, cleaned, intent, source, first, last)")
def parsed_questions(spark, sf_dir):
    rows = []
    for question, *_ in PARSED:
        p = Q.parse_query(question)
        rows.append((p.original, p.cleaned, p.intent, p.filters.get("source_type", ""), p.filters.get("_date_gte", ""), p.filters.get("_date_lte", "")))
    return spark.createDataFrame(rows, "question string, cleaned string, intent string, source string, first string, last string")



"""The registered queries for the engine's own operators, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanwork.functions import ids
from gleanwork.functions import text as X
from gleanwork.operators import analytics as A
from gleanwork.operators import evaluation as E
from gleanwork.operators import search as S
from gleanwork.operators import units as U

QUERIES, SQL = {}, {}
QUESTIONS = {"q1": "the public license and the terms", "q2": "with that which was for it", "q3": "general inor thand ering the the"}
WIDE_GAP = 1440.0  # minutes


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark, texts=None):
    rows = list((texts or QUESTIONS).items())
    return spark.createDataFrame(rows, "qid string, text string").select("qid", X.latin_words(F.col("text")).alias("tokens"))


def documents_as_parts(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("part_id"), F.col("doc_id").alias("unit_id"), F.col("doc_id").alias("row_no"), X.latin_words(F.col("text")).alias("tokens"))


def bm25_ranked(spark, sf_dir, limit, texts=None):
    parts = documents_as_parts(spark, sf_dir)
    scored = S.bm25_scores(parts, questions(spark, texts)).withColumns({"unit_id": F.col("part_id"), "row_no": F.col("part_id")})
    return S.rank_units(scored, limit, positive_only=True)


def bm25_sql(texts=None, limit: int = 10) -> str:
    values = ", ".join(f"('{k}', '{v}')" for k, v in (texts or QUESTIONS).items())
    return f"""
with tok as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents),
len as (select doc_id, greatest(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')), 1) as dl from documents),
corpus as (select count(*)::double as n, avg(dl) as avgdl from len),
post as (select term, doc_id, count(*) as tf from tok group by all),
terms as (select term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as idf from post, corpus group by term, n),
mean as (select avg(idf) as m from terms),
q(qid, text) as (values {values}),
qt as (select qid, term, count(*) as times from (select qid, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from q) group by all),
scored as (
  select qid, doc_id, round(sum(times * (case when idf < 0 then 0.25 * m else idf end) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) as score
  from qt join terms using (term) join post using (term) join len using (doc_id), corpus, mean group by qid, doc_id),
bm25 as (
  select * from (select *, row_number() over (partition by qid order by score desc, doc_id) as rank from scored where score > 0) where rank <= {limit})
"""


@query(bm25_sql() + "select qid, doc_id as unit_id, cast(rank as integer) as rank, round(score, 6) as score from bm25")
def bm25_topk(spark, sf_dir):
    return bm25_ranked(spark, sf_dir, 10).select("qid", "unit_id", "rank", F.round("score", 6).alias("score"))


REPEATED = {"once": "public license", "twice": "public public license"}


@query(bm25_sql(REPEATED) + "select qid, doc_id as unit_id, cast(rank as integer) as rank, round(score, 6) as score from bm25")
def bm25_query_multiset(spark, sf_dir):
    return bm25_ranked(spark, sf_dir, 10, REPEATED).select("qid", "unit_id", "rank", F.round("score", 6).alias("score"))


def vectors(spark, sf_dir):
    key = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").select(key.alias("part_id"), key.alias("unit_id"), key.alias("row_no"), F.col("embedding").alias("vec"))


def dense_ranked(spark, sf_dir, limit):
    """Queries: all rows whose id is divisible by 20."""
    v = vectors(spark, sf_dir)
    asked = v.filter("part_id % 20 = 0").select(F.concat(F.lit("q"), (F.col("part_id") + 1).cast("string")).alias("qid"), "vec")
    return S.dense_ranked(v, asked, limit, digits=5)


def dense_sql(limit: int, digits: int = 5, among: str = "embeddings") -> str:
    return f"""dense as (
  select * from (select 'q' || (q.vec_id + 1) as qid, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), {digits}) as score,
    row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), {digits}) desc, v.vec_id) as rank
    from embeddings q, {among} v where q.vec_id % 20 = 0) where rank <= {limit})
"""


@query("with " + dense_sql(10) + "select qid, vec_id as unit_id, cast(rank as integer) as rank, score from dense")
def dense_topk(spark, sf_dir):
    return dense_ranked(spark, sf_dir, 10).select("qid", "unit_id", "rank", "score")


def fused(spark, sf_dir):
    return S.fuse({"bm25": bm25_ranked(spark, sf_dir, 50), "dense": dense_ranked(spark, sf_dir, 50)})


def fused_sql(dense: str) -> str:
    return bm25_sql(limit=50) + ", " + dense + """, merged as (
  select qid, doc_id as unit_id, rank, 'bm25' as stage from bm25 union all select qid, vec_id, rank, 'dense' from dense),
f as (select qid, unit_id, list_sum(list_transform(list_sort(list(rank)), lambda r: 1.0::double / (60 + r))) as s, min(rank) as best,
  arg_min(stage, rank * 2 + case stage when 'dense' then 1 else 0 end) as first_stage from merged group by all),
fr as (select *, row_number() over (partition by qid order by s desc, best, unit_id) as rank from f)
"""


FUSED_SQL = fused_sql(dense_sql(50))


@query(FUSED_SQL + "select qid, unit_id, cast(rank as integer) as rank, round(s, 9) as score from fr where rank <= 100")
def rrf_hybrid(spark, sf_dir):
    return fused(spark, sf_dir).filter("rank <= 100").select("qid", "unit_id", "rank", F.round("score", 9).alias("score"))


@query(FUSED_SQL + "select qid, unit_id, first_stage, best::integer as best_rank from fr where rank <= 100")
def rrf_representative(spark, sf_dir):
    """Which ranking's part stands for a fused unit."""
    stages = F.map_entries("stage_ranks")
    best = F.array_min(F.transform(stages, lambda e: F.struct(e["value"].alias("r"), e["key"].alias("s"))))
    return fused(spark, sf_dir).filter("rank <= 100").select("qid", "unit_id", best["s"].alias("first_stage"), best["r"].alias("best_rank"))


@query(
    bm25_sql(limit=100) + """, words as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from documents),
qw as (select qid, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from q),
s as (select b.qid, b.doc_id, b.rank, len(list_intersect(qw.w, words.w))::double / len(qw.w) as o from bm25 b join words using (doc_id) join qw on qw.qid = b.qid)
select qid, doc_id as unit_id, cast(row_number() over (partition by qid order by (rank > 30), case when rank <= 30 then -o end, rank) as integer) as rank,
  cast(rank as integer) as before from s
"""
)
def rerank_head_tail(spark, sf_dir):
    ranked = bm25_ranked(spark, sf_dir, 100)
    texts = documents_as_parts(spark, sf_dir).select("unit_id", "tokens")
    head = ranked.filter("rank <= 30").select("qid", "unit_id").join(texts, "unit_id").join(questions(spark).select("qid", F.col("tokens").alias("q")), "qid")
    scores = head.select("qid", "unit_id", S.overlap_score(F.col("q"), F.col("tokens")).alias("rerank"))
    return S.rerank_head(ranked.withColumn("before", F.col("rank")), scores).select("qid", "unit_id", "rank", "before")


LINES = "select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents"


@query(
    f"""
with l as ({LINES}), s as (select doc_id, n, len(regexp_extract_all(lower(line), '[a-z0-9]+'))::double as score from l),
b as (select doc_id, n, score, row_number() over (partition by doc_id order by score desc, n) as k from s)
select 'all' as qid, doc_id as unit_id, doc_id || '#' || n as part_id, cast(rank as integer) as rank from (
  select *, row_number() over (order by score desc, doc_id * 1000000 + n) as rank from b where k = 1) where rank <= 100
"""
)
def part_to_unit_collapse(spark, sf_dir):
    """Lines as parts, scored by their words: a document ranks by its best line."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    n = F.col("n") + 1
    parts = d.select(
        F.lit("all").alias("qid"), F.col("doc_id").alias("unit_id"), F.concat_ws("#", F.col("doc_id").cast("string"), n.cast("string")).alias("part_id"),
        (F.col("doc_id") * 1_000_000 + n).alias("row_no"), F.size(X.latin_words(F.col("line"))).cast("double").alias("score"),
    )
    return S.rank_units(parts, 100).select("qid", "unit_id", "part_id", "rank")


def messages(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("room"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("n"), F.col("event_type").alias("sender"), F.col("props").alias("body"))


def sessions_sql(minutes: float) -> str:
    return f"""
with m as (select user_id as room, ts, event_id, event_type,
  case when date_diff('microsecond', lag(ts) over w, ts) > {int(minutes * 60_000_000)} then 1 when row_number() over w = 1 then 1 else 0 end as opens
  from events window w as (partition by user_id order by ts nulls first, event_id)),
s as (select *, sum(opens) over (partition by room order by ts nulls first, event_id rows unbounded preceding) as session from m)
"""


@query(sessions_sql(30) + "select event_id, room, cast(session as bigint) as session from s")
def chat_sessions(spark, sf_dir):
    return U.sessionize(messages(spark, sf_dir), order=["n"]).select(F.col("n").alias("event_id"), "room", "session")


SESSION_AGG = """select 'ch:' || substr(sha1(room::varchar), 1, 10) || ':' || strftime(min(ts), '%Y%m%dT%H%M%S') as unit_id, room, cast(session as bigint) as session,
  count(*) as n_messages, epoch_us(max(ts)) - epoch_us(min(ts)) as span, case when count(distinct event_type) > 2 then 'group' else 'direct' end as chat_type
from s group by room, session"""


@query(sessions_sql(WIDE_GAP) + SESSION_AGG)
def session_agg(spark, sf_dir):
    u = U.session_units(messages(spark, sf_dir), WIDE_GAP)
    return u.select("unit_id", "room", "session", "n_messages", (F.unix_micros("end") - F.unix_micros("start")).alias("span"), "chat_type")


@query("select conv_id, count(*) as n_messages, string_agg(role || ': ' || text, chr(10) order by turn) as text, count(distinct role) as n_roles from conversations group by conv_id")
def conversation_units(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("line"))))
    return c.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.array_join(lines["line"], "\n").alias("text"), F.count_distinct("role").alias("n_roles"))


@query(
    """select doc_id, 'doc:' || substr(sha1(source || '/' || doc_id), 1, 12) || ':p' || (doc_id % 7 + 1) as document_id,
  'em:' || case when doc_id % 2 = 0 then substr(sha1('<' || doc_id || '@' || source || '>'), 1, 16) else substr(sha1(concat_ws('|', source, '', lang, substr(text, 1, 200))), 1, 16) end as email_id,
  'att:' || substr(sha1(source || '/' || doc_id), 1, 12) || ':' || (doc_id % 3) as attachment_id from documents"""
)
def unit_ids_sha1(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    message = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  <"), F.col("doc_id").cast("string"), F.lit("@"), F.upper("source"), F.lit("> "))).otherwise("")
    page = F.concat(F.lit(":p"), (F.col("doc_id") % 7 + 1).cast("string"))
    return d.select(
        "doc_id", ids.document_id(path, page).alias("document_id"), ids.email_id(message, F.col("source"), F.lit(""), F.col("lang"), F.col("text")).alias("email_id"),
        ids.attachment_id(ids.document_id(path), F.col("doc_id") % 3).alias("attachment_id"),
    )


@query(
    """with f as (select md5(text) as unit_id, min(doc_id) as doc_id, count(*) - 1 as n_duplicates from documents group by 1),
s as (select md5(text) as unit_id, source, min(doc_id) as d from documents group by all)
select f.unit_id, f.doc_id, string_agg(s.source, ',' order by s.d) as folder_paths, f.n_duplicates from f join s using (unit_id) group by all"""
)
def dedup_keep_first(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.md5("text").alias("unit_id"), "doc_id", F.array("source").alias("folder_paths"))
    return U.keep_first(d, "unit_id", ["doc_id"], merge="folder_paths").select("unit_id", "doc_id", F.array_join("folder_paths", ",").alias("folder_paths"), "n_duplicates")


def event_parts(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    kind = F.when(F.col("user_id") % 3 == 0, "email").when(F.col("user_id") % 3 == 1, "chat").otherwise("document")
    last = F.when(F.col("user_id") % 3 == 1, F.date_format(F.col("ts").cast("timestamp") + F.expr("interval 9 days"), "yyyy-MM-dd")).otherwise("")
    return e.select(
        F.col("event_id").alias("part_id"), kind.alias("unit_type"), day.alias("date"), last.alias("date_end"), F.col("event_type").alias("author"),
        F.array(F.concat(F.lit("User"), F.col("user_id").cast("string")), "event_type").alias("participants"),
    )


FILTERS = {"source_type": ["teams_chat", "email"], "_date_gte": "2024-01-05", "_date_lte": "2024-01-20", "participants": ["USER1", "click"], "author": "", "$or": []}


@query(
    """with p as (select event_id, user_id % 3 as t, strftime(ts, '%Y-%m-%d') as d,
  case when user_id % 3 = 1 then strftime(ts + interval 9 day, '%Y-%m-%d') else strftime(ts, '%Y-%m-%d') end as e,
  lower('User' || user_id || chr(10) || event_type) as people from events)
select event_id as part_id, case t when 0 then 'email' else 'chat' end as unit_type, d as date from p
where t in (0, 1) and e >= '2024-01-05' and d <= '2024-01-20' and (contains(people, 'user1') or contains(people, 'click'))"""
)
def filter_type_date_people(spark, sf_dir):
    return S.apply_filters(event_parts(spark, sf_dir), FILTERS).select("part_id", "unit_type", "date")


def days_as_units(spark, sf_dir):
    """Users of a day and event type as the participants of a unit."""
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    users = F.array_sort(F.collect_set(F.concat(F.lit("u"), F.col("user_id").cast("string"))))
    kind = F.when(F.col("event_type") == "click", "email").when(F.col("event_type") == "view", "chat").otherwise("document")
    return e.groupBy("day", "event_type").agg(users.alias("participants")).select(kind.alias("unit_type"), F.date_format("day", "yyyy-MM-dd").alias("date"), "participants")


DAYS = """with e as (select ts::date as day, event_type, 'u' || user_id as name, case event_type when 'click' then 'email' when 'view' then 'chat' else 'document' end as unit_type from events),
u as (select distinct day, event_type, unit_type, name from e),
people as (select name, count(*) as n, list_sort(list(distinct unit_type)) as types from u group by name order by n desc, name limit 30)
"""


@query(DAYS + "select name, n, array_to_string(types, ',') as types from people")
def dashboard_participants(spark, sf_dir):
    return A.people(days_as_units(spark, sf_dir)).select("name", "n", F.array_join("types", ",").alias("types"))


@query(
    DAYS + """, pairs as (select a.name as a, b.name as b, count(*) as weight from u a join u b on a.day = b.day and a.event_type = b.event_type and a.name < b.name
  group by all order by weight desc, a, b limit 100)
select * from pairs where a in (select name from people) and b in (select name from people) and weight >= 2"""
)
def dashboard_edges(spark, sf_dir):
    return A.edges(days_as_units(spark, sf_dir))


@query(
    DAYS + """select strftime(day, '%Y-%m') as month, count(distinct (day, event_type)) filter (unit_type = 'email') as email,
  count(distinct (day, event_type)) filter (unit_type = 'chat') as chat, count(distinct (day, event_type)) filter (unit_type = 'document') as document from u group by 1"""
)
def dashboard_timeline(spark, sf_dir):
    return A.timeline(days_as_units(spark, sf_dir)).select("month", *[F.col(c).cast("long").alias(c) for c in ("email", "chat", "document")])


STOP = ", ".join(f"'{w}'" for w in X.EN_STOPWORDS)


@query(
    f"""with w as (select doc_id, lower(unnest(regexp_extract_all(text, '[a-zA-Z]{{3,}}'))) as w, generate_subscripts(regexp_extract_all(text, '[a-zA-Z]{{3,}}'), 1) as i from documents where length(trim(text)) >= 10),
c as (select doc_id, w, count(*) as n, min(i) as first from w where w not in ({STOP}) group by all),
t as (select doc_id, w, row_number() over (partition by doc_id order by n desc, first) as k from c)
select w as topic, count(*) as n from t where k <= 5 group by w order by n desc, topic limit 20"""
)
def topics_topk(spark, sf_dir):
    topics = X.topics_of(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return A.topic_counts(topics.select(F.array("topic").alias("topics")))


@query(
    """select lang, count(*) as n, round(quantile_cont(t, 0.5), 4) as median, round(quantile_cont(t, 0.95), 4) as p95, round(quantile_cont(t, 0.99), 4) as p99, max(t)::integer as max
from (select lang, greatest(1, round_even(length(text) / 2.0, 0))::integer as t from documents) group by lang"""
)
def token_distribution(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("lang", X.token_estimate(F.col("text")).alias("t"))
    return d.groupBy("lang").agg(*A.distribution(F.col("t")))


@query(
    f"""with l as ({LINES}), u as (select lang as unit_type, d.doc_id, count(*) as n from l join documents d using (doc_id) group by all)
select coalesce(unit_type, 'total') as unit_type, count(*) as units, cast(sum(n) as bigint) as parts, cast(sum((n > 1)::int) as bigint) as split_units from u group by rollup(unit_type)"""
)
def corpus_rollup(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("lang").alias("unit_type"), F.col("doc_id").alias("unit_id"), F.explode(F.split("text", "\n", -1)))
    return A.corpus_table(d)


@query(
    """select coalesce(source, 'total') as file_type, count(*) as units, cast(sum((lang <> 'en')::int) as bigint) as author, cast(sum((n_chars > 1000)::int) as bigint) as modifier
from documents where doc_id % 2 = 0 group by rollup(source)"""
)
def fill_rates(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(
        F.when(F.col("doc_id") % 2 == 0, "document").otherwise("email").alias("unit_type"), F.col("source").alias("file_type"),
        F.when(F.col("lang") != "en", F.col("lang")).alias("author"), F.when(F.col("n_chars") > 1000, "x").otherwise(" ").alias("last_modified_by"),
    )
    return A.fill_rates(d)


@query(
    """select coalesce(b, 'total') as language, count(*) as units, cast(sum(m) as bigint) as mixed from (
select case when lang in ('ko', 'en', 'zh', 'und') then lang else 'other' end as b, (doc_id % 5 = 0)::int as m from documents) group by rollup(b)"""
)
def language_rollup(spark, sf_dir):
    return A.language_table(read(spark, sf_dir, "documents").select("lang", (F.col("doc_id") % 5 == 0).alias("lang_mixed")))


@query(
    r"""select doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+')) as emails from documents"""
)
def email_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.code_counts(F.col("text"))["emails"].alias("emails"))


@query()
def code_amount_counts(spark, sf_dir):
    """Codes and amounts need look-behind, which the oracle's regular expressions lack."""
    return read(spark, sf_dir, "documents").select("doc_id", X.code_counts(F.col("text")).alias("c")).select("doc_id", "c.codes", "c.amounts")


@query(
    r"""with t as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') as x from pages)
select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) as text from t"""
)
def html_strip(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


def judgments(spark, sf_dir):
    """Two annotators: A by quality, B by the absence of toxicity; a query is the label's document modulo 40."""
    g = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    qid = F.concat(F.lit("q"), (F.col("doc_id") % 40).cast("string"))
    one = lambda who, grade: g.select(qid.alias("qid"), F.col("doc_id").alias("unit_id"), F.lit(who).alias("annotator"), grade.cast("int").alias("grade"), F.lit(1).alias("seq"))
    return one("A", F.col("quality") * 2).unionByName(one("B", (1 - F.col("toxic")) * (1 + F.col("quality"))))


JUDGED = """with g as (select doc_id, max(quality) as q, max(toxic) as t from labels group by doc_id),
pairs as (select 'q' || (doc_id % 40) as qid, doc_id as unit_id, q * 2 as a, (1 - t) * (1 + q) as b from g)
"""


@query(JUDGED + "select a::integer as a, b::integer as b, count(*) as n from pairs group by all")
def agreement_confusion(spark, sf_dir):
    return E.confusion(E.pair_grades(E.latest_judgments(judgments(spark, sf_dir))))


@query(
    JUDGED + """select qid, count(*) as n, round(avg((a = b)::int), 6) as exact, round(avg(((a >= 1) = (b >= 1))::int), 6) as relevance, cast(sum((a <> b)::int) as bigint) as disagreements
from pairs group by qid"""
)
def agreement_by_query(spark, sf_dir):
    return E.agreement(E.pair_grades(judgments(spark, sf_dir)), ["qid"])


@query(JUDGED + "select round(1 - avg((a - b) ** 2) / (avg(a * a) + avg(b * b) - 2 * avg(a) * avg(b)), 6) as kappa, count(*) as n from pairs")
def kappa(spark, sf_dir):
    return E.weighted_kappa(E.pair_grades(judgments(spark, sf_dir)))


def settled(spark, sf_dir):
    """Where A and B differ, the smaller grade is the adjudicated one."""
    j = judgments(spark, sf_dir)
    p = E.pair_grades(j).filter("a <> b")
    return E.finalize(j.unionByName(p.select("qid", "unit_id", F.lit("adjudicated").alias("annotator"), F.least("a", "b").alias("grade"), F.lit(2).alias("seq"))), strict=False)


@query(JUDGED + "select qid, unit_id, least(a, b)::integer as grade from pairs")
def qrels_finalize(spark, sf_dir):
    return settled(spark, sf_dir)


@query(
    JUDGED + "select qid, cast(sum((least(a, b) = 0)::int) as bigint) as n0, cast(sum((least(a, b) = 1)::int) as bigint) as n1, cast(sum((least(a, b) = 2)::int) as bigint) as n2 from pairs group by qid"
)
def qrels_by_grade(spark, sf_dir):
    q = settled(spark, sf_dir)
    return E.qrels_stats(q.select("qid").distinct(), q)


def label_runs(spark, sf_dir):
    """Two runs over the judged units of a query: by length, and by id."""
    d = read(spark, sf_dir, "labels").select("doc_id").distinct().join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    d = d.select(F.concat(F.lit("q"), (F.col("doc_id") % 40).cast("string")).alias("qid"), F.col("doc_id").alias("unit_id"), "n_chars")
    by = lambda name, *order: d.select(F.lit(name).alias("run"), "qid", "unit_id", F.row_number().over(Window.partitionBy("qid").orderBy(*order)).alias("rank"))
    return by("long", F.desc("n_chars"), "unit_id").unionByName(by("id", "unit_id"))


RUNS = JUDGED + """, d as (select 'q' || (doc_id % 40) as qid, doc_id as unit_id, n_chars from documents where doc_id in (select doc_id from labels)),
runs as (select 'long' as run, qid, unit_id, row_number() over (partition by qid order by n_chars desc, unit_id) as rank from d
  union all select 'id', qid, unit_id, row_number() over (partition by qid order by unit_id) from d),
rel as (select qid, unit_id, least(a, b) as g from pairs)
"""


@query(
    RUNS + """select qid, unit_id, max(case run when 'id' then rank end)::integer as id_rank, max(case run when 'long' then rank end)::integer as long_rank
from runs where rank <= 5 group by all"""
)
def pool_union(spark, sf_dir):
    p = E.pool(label_runs(spark, sf_dir), 5)
    return p.select("qid", "unit_id", F.try_element_at("found_by", F.lit("id")).alias("id_rank"), F.try_element_at("found_by", F.lit("long")).alias("long_rank"))


METRICS = RUNS + """, pos as (select *, row_number() over (partition by qid order by g desc, unit_id) as i from rel where g > 0),
ideal as (select qid, count(*) as n, sum((g = 2)::int) as n2, sum(case when i <= 10 then g / log2(i + 1.0) else 0 end) as idcg from pos group by qid),
h as (select r.qid, sum(case when rank <= 10 then g / log2(rank + 1.0) else 0 end) as dcg, sum((rank <= 10)::int) as top, sum((rank <= 10 and g = 2)::int) as top2,
  sum((rank <= 100)::int) as far, min(case when rank <= 10 then rank end) as first from runs r join rel using (qid, unit_id) where g > 0 and run = 'long' group by r.qid)
"""


@query(METRICS + "select qid, round(coalesce(dcg, 0) / idcg, 6) as ndcg from ideal left join h using (qid)")
def ndcg_at_10(spark, sf_dir):
    return E.metrics(label_runs(spark, sf_dir).filter("run = 'long'"), settled(spark, sf_dir)).select("qid", "ndcg")


@query(
    METRICS + """select qid, round(coalesce(top, 0) / 10.0::double, 6) as precision, round(coalesce(top, 0) / n::double, 6) as recall, round(coalesce(1.0::double / first, 0), 6) as mrr,
  round(coalesce(far, 0) / n::double, 6) as recall_deep, case when n2 > 0 then round(coalesce(top2, 0) / n2::double, 6) end as recall_grade2 from ideal left join h using (qid)"""
)
def recall_precision_mrr(spark, sf_dir):
    return E.metrics(label_runs(spark, sf_dir).filter("run = 'long'"), settled(spark, sf_dir)).drop("ndcg")


@query(RUNS + "select rel.qid, unit_id, max(case run when 'id' then rank end)::integer as id, max(case run when 'long' then rank end)::integer as long from rel left join runs using (qid, unit_id) where g = 2 and (qid, unit_id) not in (select (qid, unit_id) from runs where run = 'long' and rank <= 10) group by all")
def failure_anti_join(spark, sf_dir):
    runs = label_runs(spark, sf_dir)
    return E.missed(settled(spark, sf_dir), runs.filter("run = 'long'").select("qid", "unit_id", "rank"), runs, ["id", "long"])


@query(
    """with p as (select o_orderpriority as name, round(avg(o_totalprice) / 1000000, 9) as p from orders group by 1),
s as (select *, least(1.0, (count(*) over () - row_number() over (order by p, name) + 1) * p) as x, row_number() over (order by p, name) as r from p)
select name, p, round(max(x) over (order by r rows unbounded preceding), 9) as adjusted from s"""
)
def holm(spark, sf_dir):
    p = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.round(F.avg("o_totalprice") / 1_000_000, 9).alias("p"))
    return E.holm(p).select("name", "p", F.round("adjusted", 9).alias("adjusted"))


@query(
    """select vec_id as part_id, case when vec_id % 3 <> 0 then 'stored' else 'new' end as origin, round(case when vec_id % 3 <> 0 then embedding[1]::double end, 6) as first from embeddings"""
)
def vector_reuse_left_join(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    key = S.input_hash(F.concat(F.lit("text of "), F.col("vec_id").cast("string")))
    inputs = e.select(F.col("vec_id").alias("part_id"), key.alias("input_hash"))
    stored = e.filter("vec_id % 3 <> 0").select(F.col("vec_id").alias("part_id"), key.alias("input_hash"), F.col("embedding").alias("vec"))
    have, lack = S.reusable_vectors(inputs, stored)
    return have.select("part_id", F.lit("stored").alias("origin"), F.round(F.col("vec")[0].cast("double"), 6).alias("first")).unionByName(
        lack.select("part_id", F.lit("new").alias("origin"), F.lit(None).cast("double").alias("first"))
    )


def label_scores(spark, sf_dir):
    m = E.metrics(label_runs(spark, sf_dir).filter("run = 'long'"), settled(spark, sf_dir)).select(F.lit("long").alias("run"), "qid", F.col("ndcg").alias("value"))
    n = E.metrics(label_runs(spark, sf_dir).filter("run = 'id'"), settled(spark, sf_dir)).select(F.lit("id").alias("run"), "qid", F.col("ndcg").alias("value"))
    return m.unionByName(n)


@query()
def bootstrap_ci(spark, sf_dir):
    return E.bootstrap_by_group(label_scores(spark, sf_dir), ["run"])


@query()
def randomization_p(spark, sf_dir):
    s = label_scores(spark, sf_dir)
    return E.paired_tests(s.filter("run = 'id'").select("qid", "value"), s.filter("run = 'long'").select("qid", "value"))


@query()
def tokenize_multilingual(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.tokenize("text").alias("tokens"))


@query()
def fake_embed(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.fake_embed("text", F.lit(64)).alias("vec"))


@query()
def split_parts(spark, sf_dir):
    return U.split_units(read(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("unit_id"), "text"), most=512)


@query()
def clean_mail_bodies(spark, sf_dir):
    from gleanwork.functions.mail import strip_quoted

    return read(spark, sf_dir, "documents").select("doc_id", strip_quoted("text", F.lit("")).alias("text"))


@query()
def language_detection(spark, sf_dir):
    from gleanwork.functions.language import detect_language

    return read(spark, sf_dir, "documents").select("doc_id", detect_language("text").alias("l")).select("doc_id", "l.lang", "l.mixed", "l.second")


# ---- relational shapes ----


@query(
    """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_discount), 6) as avg_disc, count(*) as n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by all"""
)
def pricing_summary(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


@query(
    """select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by n_name"""
)
def revenue_by_nation(spark, sf_dir):
    r = lambda n: read(spark, sf_dir, n)
    j = r("lineitem").join(r("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(r("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(r("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(r("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query(
    """select c_custkey, o_orderkey, o_totalprice, k::integer as k from (select c_custkey, o_orderkey, o_totalprice, row_number() over (partition by c_custkey order by o_totalprice desc, o_orderkey) as k
from customer join orders on c_custkey = o_custkey) where k <= 3"""
)
def top_orders_per_customer(spark, sf_dir):
    j = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    w = Window.partitionBy("c_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return j.withColumn("k", F.row_number().over(w)).filter("k <= 3").select("c_custkey", "o_orderkey", "o_totalprice", "k")


@query(
    """select c_custkey as k, 'anti' as kind from customer where c_custkey not in (select o_custkey from orders)
union all select c_custkey, 'semi' from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F')"""
)
def semi_and_anti_joins(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), read(spark, sf_dir, "orders")
    semi = c.join(o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), "k", "left_semi").withColumn("kind", F.lit("semi"))
    return c.join(o.select(F.col("o_custkey").alias("k")), "k", "left_anti").withColumn("kind", F.lit("anti")).unionByName(semi)


@query(
    """select coalesce(a.k, b.k) as k, a.n as suppliers, b.n as customers from (select s_nationkey as k, count(*) as n from supplier group by 1) a
full join (select c_nationkey as k, count(*) as n from customer where c_acctbal < 0 group by 1) b on a.k = b.k"""
)
def full_outer_counts(spark, sf_dir):
    a = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    b = read(spark, sf_dir, "customer").filter("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return a.join(b, "k", "full").select("k", "suppliers", "customers")


@query(
    """(select l_partkey as k, 'both' as kind from lineitem where l_returnflag = 'R' intersect select l_partkey, 'both' from lineitem where l_returnflag = 'A')
union all (select l_partkey, 'only' from lineitem where l_returnflag = 'R' except select l_partkey, 'only' from lineitem where l_returnflag = 'A')"""
)
def set_operations(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    r, a = (l.filter(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k")) for f in "RA")
    return r.intersect(a).withColumn("kind", F.lit("both")).unionByName(r.subtract(a).withColumn("kind", F.lit("only")))


from gleanwork import catalog_more  # noqa: E402, F401  registers more queries

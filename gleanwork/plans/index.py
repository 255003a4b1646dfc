"""Indexing from end to end: files to units, units to parts, parts to vectors, and the tables of an index."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanwork.functions import ids
from gleanwork.functions import text as X
from gleanwork.functions.language import detect_language
from gleanwork.functions.mail import body_of_message, is_ad_subject, is_forwarded, strip_quoted
from gleanwork.operators import search as S
from gleanwork.operators import units as U
from gleanwork.sources import files, mailbox
from gleanwork.sources.tables import IndexStore, check_failure_rate, read_or_none, remove

SEP = "\u0000"  # in no path or name

UNIT_COLUMNS = {
    "unit_id": "string", "unit_type": "string", "text": "string", "date": "string", "date_end": "string", "participants": "array<string>", "source_file": "string",
    "sender": "string", "sender_name": "string", "recipients": "array<string>", "recipient_names": "array<string>", "cc": "array<string>", "cc_names": "array<string>",
    "subject": "string", "message_id": "string", "in_reply_to": "string", "attachment_filenames": "array<string>", "folder_paths": "array<string>", "forwarded": "boolean",
    "room": "string", "filename": "string", "file_type": "string", "author": "string", "last_modified_by": "string", "created_date": "string", "last_modified": "string",
    "page": "int", "page_count": "int", "position": "string", "parent_unit_id": "string", "parent_kind": "string", "parent_subject": "string", "parent_sender": "string",
    "parent_recipients": "array<string>", "parent_date": "string", "chars_before": "bigint", "ord": "string",
}


def conform(df: DataFrame) -> DataFrame:
    """All unit columns, in order: what a source lacks is empty."""
    empty = lambda t: F.array().cast(t) if t.startswith("array") else F.lit("").cast(t) if t == "string" else F.lit(None).cast(t)
    return df.select(*[(F.coalesce(F.col(c).cast(t), empty(t)) if c in df.columns else empty(t)).alias(c) for c, t in UNIT_COLUMNS.items()])


def _lines(value: Column) -> Column:
    return F.filter(F.split(F.coalesce(value, F.lit("")), "\n"), lambda x: x != "")


def mail_units(documents: DataFrame) -> DataFrame:
    """Messages without advertisements; bodies cleaned."""
    m = lambda k: F.coalesce(F.try_element_at("meta", F.lit(k)), F.lit(""))
    body = body_of_message(F.coalesce(F.try_element_at("pages", F.lit(1)), F.lit("")))
    mails = documents.filter("file_type in ('eml', 'msg') and error is null").filter(~is_ad_subject(m("subject")))
    sender = F.when(m("sender_name") != "", m("sender_name")).otherwise(m("sender"))
    return conform(mails.select(
        ids.email_id(m("message_id"), m("sender"), m("date"), m("subject"), body).alias("unit_id"), F.lit("email").alias("unit_type"), strip_quoted(body, m("subject")).alias("text"),
        m("date").alias("date"), _lines(m("participants")).alias("participants"), F.col("path").alias("source_file"), m("sender").alias("sender"), sender.alias("sender_name"),
        _lines(m("recipients")).alias("recipients"), _lines(m("cc")).alias("cc"), m("subject").alias("subject"), m("message_id").alias("message_id"),
        m("in_reply_to").alias("in_reply_to"), F.transform("attachments", lambda a: a["filename"]).alias("attachment_filenames"), F.array("path").alias("folder_paths"),
        is_forwarded(m("subject")).alias("forwarded"), F.length(body).alias("chars_before"), F.col("path").alias("ord"),
    ))


def page_units(documents: DataFrame, kind: str = "document") -> DataFrame:
    """A unit for each page that isn't blank, with its own number; sheets: row blocks under their header row."""
    m = lambda k: F.try_element_at("meta", F.lit(k))
    usable = documents.filter("file_type not in ('eml', 'msg') and error is null")
    name = F.substring_index("path", "/", -1)
    shared = [F.col("path").alias("source_file"), name.alias("filename"), "file_type", m("author").alias("author"), m("last_modified_by").alias("last_modified_by"),
              m("created_date").alias("created_date"), m("last_modified").alias("last_modified"), F.coalesce(m("last_modified"), m("created_date")).alias("date")]
    paged = usable.filter("file_type not in ('xlsx', 'xls')").select("path", F.size("pages").alias("page_count"), F.posexplode("pages").alias("n", "text"), *shared)
    paged = paged.filter(F.trim("text") != "").withColumn("page", F.col("n") + 1)
    label = F.when(F.col("file_type") == "pptx", "슬라이드 ").otherwise("p.")
    place = F.when(F.col("page_count") > 1, F.concat(label, F.col("page").cast("string"), F.lit("/"), F.col("page_count").cast("string"))).otherwise("")
    paged = paged.withColumns({"unit_id": ids.document_id(F.col("path"), F.concat(F.lit(":p"), F.col("page").cast("string"))), "position": place})
    sheets = usable.filter("file_type in ('xlsx', 'xls')").select("path", "doc_no", F.coalesce(m("sheet_name"), F.lit("")).alias("sheet"), F.explode(blocks("pages", "rows")).alias("b"), *shared)
    rows = F.concat_ws("-", F.col("b.first").cast("string"), F.col("b.last").cast("string"))
    sheets = sheets.select("*", F.col("b.text").alias("text"), F.concat(F.col("sheet"), F.lit("!"), rows).alias("position"),
        ids.document_id(F.col("path"), F.concat(F.lit(":s"), (F.col("doc_no") + 1).cast("string"), F.lit("r"), rows)).alias("unit_id"))
    typed = lambda d: conform(d.withColumns({"unit_type": F.lit(kind), "ord": F.concat_ws("#", "path", "unit_id"), "chars_before": F.length("text").cast("bigint")}))
    return typed(paged).unionByName(typed(sheets))


def blocks(pages: str, rows: str) -> Column:
    from pyspark.sql import types as T

    kind = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))

    @F.pandas_udf(kind)
    def run(lines: pd.Series, numbers: pd.Series) -> pd.Series:
        made = [[{"text": t, "first": a, "last": z} for t, _, a, z in U.row_blocks(list(x), [int(i) for i in n])] for x, n in zip(lines, numbers)]
        return pd.Series(made, dtype=object)

    return run(pages, rows)


def attachment_units(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units of attachments that can be read, (path, ordinal, filename, status) of all): what is left out is counted, not lost."""
    subject = F.coalesce(F.try_element_at("meta", F.lit("subject")), F.lit(""))
    advert = F.col("file_type").isin("eml", "msg") & is_ad_subject(subject)  # goes with what is attached to it
    every = files.attachment_rows(documents.filter("error is null").filter(~advert))
    parents = mail_units(documents).select(
        F.col("source_file").alias("path"), F.col("unit_id").alias("parent_unit_id"), F.col("subject").alias("parent_subject"), F.col("sender").alias("parent_sender"),
        F.col("recipients").alias("parent_recipients"), F.col("date").alias("parent_date"),
    )
    key = F.concat_ws(SEP, "path", F.col("ordinal").cast("string"), "filename")
    parsed = files.parse_files(every.filter("status = 'ok'").select(key.alias("path"), "content"))
    field = lambda n: F.split_part("source_file", F.lit(SEP), F.lit(n))
    pages = page_units(parsed, "attachment").withColumns({"__path": field(1), "__n": field(2).cast("int")})
    suffix = F.concat(F.lit(":"), F.regexp_extract("unit_id", r"^doc:[0-9a-f]+:(.*)$", 1))
    kept = [c for c in pages.columns if not c.startswith("parent_") and c not in ("unit_id", "filename", "source_file")]
    pages = pages.select(*kept, field(3).alias("filename"), F.concat_ws("!", "__path", field(2), field(3)).alias("source_file"), suffix.alias("__suffix"))
    # Of a file that is no mail (a mailbox's own list), an attachment has no parent: it stands alone, by an id of its own.
    both = pages.join(parents.withColumnRenamed("path", "__path"), "__path", "left")
    owner = F.coalesce("parent_unit_id", ids.document_id(F.col("__path"), F.concat(F.lit(":orphan"), F.col("__n").cast("string"))))
    out = both.withColumn("unit_id", ids.attachment_id(owner, F.col("__n"), F.col("__suffix")))
    broken = parsed.filter("error is not null").select(F.col("path").alias("k"))
    status = F.when(F.col("k").isNotNull(), "error").otherwise(F.col("status"))
    counted = every.withColumn("key", key).join(broken, F.col("key") == F.col("k"), "left").select("path", "ordinal", "filename", status.alias("status"))
    return conform(out.withColumn("parent_kind", F.when(F.col("parent_unit_id").isNotNull(), "email"))), counted


def orphans(attached: DataFrame, units: DataFrame) -> DataFrame:
    """Units of attachments whose parent isn't among `units`."""
    return attached.join(units.select(F.col("unit_id").alias("parent_unit_id")), "parent_unit_id", "left_anti")


def finish(units: DataFrame, max_tokens: int = U.PART_TOKENS) -> DataFrame:
    """Duplicates merged (keep-first), then language, topics, header and parts: one row per part, ready to index."""
    first = U.keep_first(units, "unit_id", ["ord"], merge="folder_paths")
    told = first.withColumns({"text": X.strip("text"), "l": detect_language("text"), "topics": X.topics(F.col("text"))})
    header = F.when(F.col("unit_type") == "email", U.email_header()).when(F.col("unit_type") == "chat", U.chat_header())
    header = header.when(F.col("unit_type") == "attachment", U.attachment_header()).otherwise(U.document_header())
    told = told.withColumns({"header": header, "lang": F.col("l.lang"), "lang_mixed": F.col("l.mixed"), "lang_second": F.col("l.second"), "chars_after": F.length("text").cast("bigint")})
    parts = U.split_units(told.drop("l"), max_tokens)
    return parts.withColumn("content", U.full_text(F.col("header"), F.col("text")))


def chat_units(messages: DataFrame, source_file: str = "", gap_minutes: float = U.GAP_MINUTES) -> DataFrame:
    """Sessions of a room as units. messages: folder, topic, ts, sender, body, and n to order equal times by."""
    rooms = messages.withColumn("room", ids.room_key(F.col("folder"), F.col("topic")))
    s = U.session_units(rooms, gap_minutes)
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return conform(s.select(
        "unit_id", F.lit("chat").alias("unit_type"), "text", iso("start").alias("date"), iso("end").alias("date_end"), "participants", F.lit(source_file).alias("source_file"),
        "room", F.array(F.lit(source_file)).alias("folder_paths"), F.length("text").cast("bigint").alias("chars_before"), F.col("unit_id").alias("ord"),
    ))


def numbered(parts: DataFrame) -> DataFrame:
    """`parts` in order of unit and part number, with row_no, which ascends in that order (with gaps). Parts are dealt by
    ranges, so no task has all."""
    return parts.repartitionByRange("unit_id", "part_no").sortWithinPartitions("unit_id", "part_no").withColumn("row_no", F.monotonically_increasing_id())


# ---- embedding ----


class FakeEmbedder:
    """The model-free embedder, in the form that a client of a served model takes: a name, a dimension, a call per batch."""

    name, dim = "fake-hash", 64

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [X.fake_embedding(t, self.dim) for t in texts]


def batches_by_length(texts: list[str], most: int) -> Iterator[list[int]]:
    """Places of texts in batches of similar length."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    for k in range(0, len(order), most):
        yield order[k : k + most]


def embed_with_retry(embed: Callable, texts: list[str], attempts: int = 3, levels: int = 3, wait: float = 0.2) -> list[list[float] | None]:
    """A batch that fails is tried again, then halved, `levels` times at most; None for what still fails."""
    for k in range(attempts):
        try:
            return list(embed(texts))
        except Exception:
            time.sleep(wait * 2**k if k + 1 < attempts else 0)
    if len(texts) == 1 or levels == 0:
        return [None] * len(texts)
    half = len(texts) // 2
    return [v for part in (texts[:half], texts[half:]) for v in embed_with_retry(embed, part, 1, levels - 1, wait)]


VECTORS = "part_id string, input_hash string, vec array<double>, failed boolean"


def embed_parts(inputs: DataFrame, embedder, batch: int = 64) -> DataFrame:
    """part_id, input_hash, vec, failed. Blank inputs get the zero vector without a call."""

    def run(frames):
        for pdf in frames:
            vec: list = [[0.0] * embedder.dim for _ in range(len(pdf))]
            filled = [i for i, t in enumerate(pdf["content"]) if t and t.strip()]
            texts = [pdf["content"].iloc[i] for i in filled]
            for places in batches_by_length(texts, batch):
                for at, v in zip(places, embed_with_retry(embedder, [texts[k] for k in places])):
                    vec[filled[at]] = v
            yield pd.DataFrame({"part_id": pdf["part_id"], "input_hash": pdf["input_hash"], "vec": vec, "failed": [v is None for v in vec]})

    return inputs.select("part_id", "input_hash", "content").mapInPandas(run, VECTORS)


def embed_all(spark: SparkSession, folder: str, inputs: DataFrame, embedder, slices: int = 4) -> DataFrame:
    """part_id, input_hash, vec, failed of all `inputs`, kept in a table of `folder` as they are made, a slice at a time. A run
    that follows a crash embeds only what the table lacks; what failed is tried again."""
    done = lambda: read_or_none(spark, folder)
    for k in range(slices):
        todo = inputs.filter(F.pmod(F.xxhash64("part_id", "input_hash"), F.lit(slices)) == k)
        had = done()
        if had is not None:
            had = had.filter((F.col("model") == embedder.name) & ~F.col("failed"))
            todo = todo.join(had.select("part_id", "input_hash"), ["part_id", "input_hash"], "left_anti")
        embed_parts(todo, embedder).withColumn("model", F.lit(embedder.name)).write.mode("append").parquet(folder)
    every = spark.read.parquet(folder).filter(F.col("model") == embedder.name).join(inputs.select("part_id", "input_hash").distinct(), ["part_id", "input_hash"], "left_semi")
    return every.groupBy("part_id", "input_hash").agg(F.min_by("vec", "failed").alias("vec"), F.min("failed").alias("failed"))


def index_parts(spark: SparkSession, store: IndexStore, case: str, parts: DataFrame, embedder=None) -> str:
    """Writes an index of `parts` (see finish) and gives its version. Vectors of the version before are used again where
    part and input are the same; parts whose embedding failed are left out of all tables. Other profiles of the version before
    are carried over if they have a vector for every part. The rate of failures is checked after publishing: what could be
    embedded can be searched, and the caller knows."""
    embedder = embedder or FakeEmbedder()
    made = f"{store.root}/{case}/made-{time.time_ns()}"
    parts.withColumn("tokens", X.tokenize("content")).write.parquet(made)  # texts are split, told and tokenized once
    parts = spark.read.parquet(made)
    inputs = parts.withColumn("input_hash", S.input_hash(F.col("content")))
    before = store.latest(case)
    known = None
    if before is not None and before["tables"] and before["embed_model"] == embedder.name:
        stored = store.load(case)["vectors"].select("part_id", "input_hash", "vec")
        known, inputs_left = S.reusable_vectors(inputs.select("part_id", "input_hash"), stored)
        todo = inputs.join(inputs_left, ["part_id", "input_hash"], "left_semi")
    else:
        todo = inputs
    stage = f"{store.root}/{case}/embedded"
    new = embed_all(spark, stage, todo, embedder)
    counts = {r["failed"]: r["n"] for r in new.groupBy("failed").agg(F.count("*").alias("n")).collect()}
    vectors = new.filter("not failed").select("part_id", "input_hash", "vec")
    if known is not None:
        vectors = vectors.unionByName(known.select("part_id", "input_hash", "vec"))
    ready = numbered(parts.join(vectors.select("part_id"), "part_id", "left_semi"))
    lexical = S.lexical_index(ready)
    tables = {
        "parts": ready, "vectors": vectors, "failed": new.filter("failed").select("part_id", "input_hash"), "terms": lexical["terms"],
        # In order of terms, so that a query's terms are few row groups; a term that all parts have is several ranges.
        "postings": lexical["postings"].repartitionByRange("term", "part_id").sortWithinPartitions("term", "part_id"),
    }
    profiles = {} if before is None or not before["tables"] else store.profiles(case)
    version = store.write(case, tables, embedder.name, embedder.dim)
    for name, at in profiles.items():
        carry_profile(spark, store, case, name, at)
    for folder in (stage, made):
        remove(spark, folder)
    check_failure_rate(counts.get(False, 0), counts.get(True, 0))
    return version


def carry_profile(spark: SparkSession, store: IndexStore, case: str, name: str, at: str) -> bool:
    """Moves a profile's vectors to the newest version, if every part has one; else the profile is dropped."""
    parts = store.load(case)["parts"].select("part_id", S.input_hash(F.col("content")).alias("input_hash"))
    kept = spark.read.parquet(at).join(parts, ["part_id", "input_hash"], "left_semi")
    if not parts.join(kept, ["part_id", "input_hash"], "left_anti").isEmpty():
        return False
    store.write_profile(case, name, kept)
    return True


def build_profile(spark: SparkSession, store: IndexStore, case: str, name: str, embedder) -> None:
    """Adds or replaces one profile: vectors of another embedder for all parts. A part that fails is an error, and the profile
    stays as it was."""
    parts = store.load(case)["parts"].withColumn("input_hash", S.input_hash(F.col("content")))
    stage = f"{store.root}/{case}/embedded-{name}"
    made = embed_all(spark, stage, parts, embedder)
    if not made.filter("failed").isEmpty():
        raise RuntimeError(f"profile {name}: some parts could not be embedded")
    store.write_profile(case, name, made.select("part_id", "input_hash", "vec"))
    remove(spark, stage)


def index_files(spark: SparkSession, roots: list[str], store: IndexStore, case: str, embedder=None, messages: DataFrame | None = None) -> str:
    """Files below `roots`, with the mails and chats of mailboxes, and chat `messages` (see chat_units) to an index. Parsed
    documents are written, not cached: an executor that is lost costs no parsing again."""
    folder = f"{store.root}/{case}/parsed-{time.time_ns()}"
    plain = [e for e in files.SUPPORTED if e not in mailbox.READERS]
    mailbox.mailbox_messages(files.discover(spark, roots, sorted(mailbox.READERS))).write.parquet(f"{folder}/messages")
    found = spark.read.parquet(f"{folder}/messages")
    files.parse_files(files.discover(spark, roots, plain)).unionByName(mailbox.mail_documents(found)).write.parquet(f"{folder}/documents")
    documents = spark.read.parquet(f"{folder}/documents")
    chats = mailbox.chat_messages(found)
    messages = chats if messages is None else messages.select(chats.columns).unionByName(chats)
    try:
        attached, _ = attachment_units(documents)
        units = mail_units(documents).unionByName(page_units(documents)).unionByName(attached)
        units = units.unionByName(chat_units(messages))
        return index_parts(spark, store, case, finish(units), embedder)
    finally:
        remove(spark, folder)


# ---- questions ----
#: Dimensions of known embedding models, by name.
KNOWN_DIMENSIONS = {
    "qwen3-embedding:0.6b": 1024, "qwen3-embedding:4b": 2560, "qwen3-embedding:8b": 4096, "nomic-embed-text": 768, "bge-m3": 1024,
    "mxbai-embed-large": 1024, "all-minilm": 384, "snowflake-arctic-embed": 1024,
}
QUERY_TASK = "Given a search query, retrieve relevant passages that answer the query"


def known_dimension(model: str) -> int | None:
    """By the longest known name that the model's name contains; None for others."""
    name = model.lower()
    return max(((len(k), d) for k, d in KNOWN_DIMENSIONS.items() if k in name), default=(0, None))[1]


def embedded_query(query: str, model: str, task: str = QUERY_TASK) -> str:
    """What is embedded for a question: models of one family want an instruction before it; documents never have one."""
    name = model.lower().replace("_", "-")
    return f"Instruct: {task}\nQuery:{query}" if "qwen3-embedding" in name else query


def query_frame(spark: SparkSession, questions: dict[str, str], embedder=None) -> DataFrame:
    """qid, text, tokens, vec of questions: the same tokenizer and embedder as the index."""
    embedder = embedder or FakeEmbedder()
    rows = [(k, t, X.tokenize_text(t), list(map(float, embedder([embedded_query(t, embedder.name)])[0]))) for k, t in questions.items()]
    return spark.createDataFrame(rows, "qid string, text string, tokens array<string>, vec array<double>")


def top_overlap(a: DataFrame, b: DataFrame, queries_a: DataFrame, queries_b: DataFrame, k: int = 5) -> DataFrame:
    """qid, overlap: the share of its first k parts that two embedders have in common. a, b: part_id, vec; queries: qid, vec."""
    def top(vectors, queries, name):
        rows = vectors.select("part_id", F.col("part_id").alias("unit_id"), F.dense_rank().over(Window.orderBy("part_id")).alias("row_no"), "vec")
        return S.dense_ranked(rows, queries, k).groupBy("qid").agg(F.collect_set("part_id").alias(name))

    both = top(a, queries_a, "a").join(top(b, queries_b, "b"), "qid")
    return both.select("qid", (F.size(F.array_intersect("a", "b")) / F.lit(k)).alias("overlap"))


def embedding_parity(a: DataFrame, b: DataFrame, least: float = 0.99) -> DataFrame:
    """n, mean and least cosine of two embedders' vectors for the same parts, and whether the mean passes."""
    both = a.select("part_id", S.l2_normalize("vec").alias("a")).join(b.select("part_id", S.l2_normalize("vec").alias("b")), "part_id")
    c = both.select(S.dot(F.col("a"), F.col("b")).alias("c"))
    return c.agg(F.count("*").alias("n"), F.avg("c").alias("mean"), F.min("c").alias("least"), (F.avg("c") >= least).alias("passes"))

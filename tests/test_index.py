"""Files to an index and back to hits."""

import pytest
from pyspark.sql import functions as F

from gleanwork.operators.search import OverlapReranker, RetrievalConfig
from gleanwork.plans import index as I
from gleanwork.plans.retrieve import open_index, retrieve, source_context, sources
from gleanwork.sources import files
from gleanwork.sources.tables import IndexStore

MAIL = (
    "From: Kim <k@x.com>\r\nTo: a@x.com\r\nSubject: Budget\r\nDate: Mon, 01 Jan 2024 10:00:00 +0900\r\nMessage-ID: <m@x>\r\nMIME-Version: 1.0\r\n"
    'Content-Type: multipart/mixed; boundary="b"\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\nThe budget of the harbour project\r\n\r\nOn Mon, 1 Jan 2024, X wrote:\r\n> old\r\n'
    '--b\r\nContent-Type: text/plain\r\nContent-Disposition: attachment; filename="notes.txt"\r\n\r\nnotes on lighthouse repairs\r\n'
    '--b\r\nContent-Type: image/png\r\nContent-Disposition: attachment; filename="x.png"\r\n\r\nzz\r\n--b--\r\n'
)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "copy").mkdir(parents=True)
    for p in ("m.eml", "copy/m.eml"):
        (tmp_path / "in" / p).write_bytes(MAIL.encode())
    (tmp_path / "in" / "ad.eml").write_bytes(MAIL.replace("Budget", "(광고) sale").replace("<m@x>", "<n@x>").encode())
    (tmp_path / "in" / "report.txt").write_text("Report on the harbour and its cranes")
    return tmp_path


def test_index_and_search(spark, folder):
    store = IndexStore(spark, f"file://{folder}/index")
    I.index_files(spark, [f"file://{folder}/in"], store, "case")
    parts = store.load("case", "fake-hash")["parts"]
    rows = {r["unit_type"]: r for r in parts.collect()}
    assert set(rows) == {"email", "document", "attachment"} and parts.count() == 3
    assert rows["email"]["text"] == "The budget of the harbour project" and len(rows["email"]["folder_paths"]) == 2 and rows["email"]["header"].startswith("[이메일] 2024-01-01 10:00")
    assert rows["attachment"]["parent_unit_id"] == rows["email"]["unit_id"] and "부모 메일" in rows["attachment"]["header"] and rows["attachment"]["filename"] == "notes.txt"
    index = open_index(store, "case")
    hits = retrieve(I.query_frame(spark, {"q": "lighthouse repairs"}), parts, RetrievalConfig(), index=index)
    assert [r["part_id"] for r in parts.orderBy("row_no").collect()] == [r["part_id"] for r in parts.orderBy("unit_id", "part_no").collect()]
    table = parts.join(index["vectors"].select("part_id", "vec"), "part_id")
    plain = retrieve(I.query_frame(spark, {"q": "lighthouse repairs"}), table, RetrievalConfig())
    assert sorted(map(str, hits.collect())) == sorted(map(str, plain.collect()))
    again = retrieve(I.query_frame(spark, {"q": "lighthouse repairs"}), parts, RetrievalConfig(rerank=True, rerank_min_score=0.5), index=index, reranker=OverlapReranker())
    assert [r["unit_id"] for r in again.collect()] == [rows["attachment"]["unit_id"]]
    assert hits.orderBy("rank").first()["unit_id"] == rows["attachment"]["unit_id"]
    shown = sources(hits, parts.withColumn("source_type", F.col("unit_type")))
    assert "lighthouse" in shown.orderBy("n").select(source_context(shown.columns)).first()[0]


def test_vectors_are_used_again(spark, folder):
    store = IndexStore(spark, f"file://{folder}/index")
    I.index_files(spark, [f"file://{folder}/in"], store, "case")

    class Counting(I.FakeEmbedder):
        def __call__(self, texts):
            assert not any("harbour" in t for t in texts), "embedded before"
            return super().__call__(texts)

    (folder / "in" / "new.txt").write_text("something else entirely for the index")
    I.index_files(spark, [f"file://{folder}/in"], store, "case", Counting())
    assert store.load("case")["vectors"].count() == 4


def test_failures_are_left_out(spark, folder):
    class Broken(I.FakeEmbedder):
        def __call__(self, texts):
            if any("cranes" in t for t in texts):
                raise OSError("down")
            return super().__call__(texts)

    store = IndexStore(spark, f"file://{folder}/index")
    with pytest.raises(RuntimeError):
        I.index_files(spark, [f"file://{folder}/in"], store, "case", Broken())
    t = store.load("case")
    assert t["failed"].count() == 1 and t["parts"].filter("unit_type = 'document'").count() == 0 and t["postings"].filter("term = 'cranes'").count() == 0


def test_retry_halves_and_gives_up():
    calls = []

    def embed(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise OSError
        return [[1.0]] * len(texts)

    assert I.embed_with_retry(embed, ["a", "bad", "c", "d"], wait=0) == [[1.0], None, [1.0], [1.0]] and calls[:3] == [4, 4, 4]
    assert sorted(i for b in I.batches_by_length(["aaa", "b", "cc"], 2) for i in b) == [0, 1, 2]


def test_attachments_are_counted(spark, folder):
    from gleanwork.sources import files

    docs = files.parse_files(files.discover(spark, [f"file://{folder}/in/copy"]))
    assert {(r["filename"], r["status"]) for r in I.attachment_units(docs)[1].collect()} == {("notes.txt", "ok"), ("x.png", "excluded")}


def test_parity(spark):
    a = spark.createDataFrame([("p", [1.0, 0.0])], "part_id string, vec array<double>")
    assert I.embedding_parity(a, a).first()["passes"]


def test_profiles_are_built_carried_and_dropped(spark, folder):
    class Other(I.FakeEmbedder):
        name, dim = "other", 8

        def __call__(self, texts):
            return [[float(len(t) % 7)] + [1.0] * 7 for t in texts]

    store = IndexStore(spark, f"file://{folder}/index")
    I.index_files(spark, [f"file://{folder}/in"], store, "case")
    I.build_profile(spark, store, "case", "short", Other())
    assert store.load_profile("case", "short").count() == 3 and open_index(store, "case", profile="short")["vectors"].first()["vec"][1] == 1.0
    I.index_files(spark, [f"file://{folder}/in"], store, "case")
    assert set(store.profiles("case")) == {"short"}
    (folder / "in" / "new.txt").write_text("something that has no vector in the profile")
    I.index_files(spark, [f"file://{folder}/in"], store, "case")
    assert store.profiles("case") == {}
    with pytest.raises(ValueError):
        store.write_profile("case", "short", store.load("case")["vectors"].limit(1))
    store.clean("case", keep=1)
    assert store.load("case")["parts"].count() == 4


def test_embedding_goes_on_after_a_crash(spark, tmp_path):
    class Dies(I.FakeEmbedder):
        def __call__(self, texts):
            return super().__call__(texts)

    inputs = spark.createDataFrame([(f"p{k}", f"h{k}", f"text {k}") for k in range(20)], "part_id string, input_hash string, content string")
    at = f"file://{tmp_path}/embedded"
    I.embed_all(spark, at, inputs.limit(12), Dies())

    class Counts(I.FakeEmbedder):
        def __call__(self, texts):
            assert not set(texts) & {f"text {k}" for k in range(12)}
            return super().__call__(texts)

    assert I.embed_all(spark, at, inputs, Counts()).filter("not failed").count() == 20


def test_query_instruction_and_dimensions():
    assert I.embedded_query("q", "Qwen3-Embedding:4b").startswith("Instruct: ") and I.embedded_query("q", "bge-m3") == "q"
    assert I.known_dimension("hf.co/bge-m3:latest") == 1024 and I.known_dimension("Qwen3-embedding:0.6b-q8") == 1024 and I.known_dimension("x") is None


def test_chats_and_attachments_without_a_parent(spark):
    rows = [("inbox", "plan", "2024-01-01 10:00:00", "Ann", "hi", 1), ("inbox", "plan", "2024-01-01 10:20:00", "Bo", "yes", 2), ("inbox", "", "2024-01-01 10:21:00", "Bo", "other", 3)]
    chats = I.chat_units(spark.createDataFrame(rows, "folder string, topic string, ts string, sender string, body string, n int").withColumn("ts", F.col("ts").cast("timestamp")), "box.pst")
    got = {r["room"]: r for r in chats.collect()}
    assert set(got) == {"inbox__plan", "inbox"} and got["inbox__plan"]["text"] == "10:00 Ann: hi\n10:20 Bo: yes" and got["inbox__plan"]["participants"] == ["Ann", "Bo"]
    docs = spark.createDataFrame([("box!1.pst", 0, "pst", [], [], {}, [("a!b.txt", b"loose words", 11)], None)], files.DOCUMENTS)
    attached, counted = I.attachment_units(docs)
    one = attached.first()
    assert one["filename"] == "a!b.txt" and one["source_file"] == "box!1.pst!0!a!b.txt" and one["parent_unit_id"] == "" and one["unit_id"].startswith("att:") and counted.count() == 1
    assert I.orphans(attached, chats).count() == 1

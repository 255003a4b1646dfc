import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from gleanwork.operators import analytics as A
from gleanwork.operators import evaluation as E
from gleanwork.operators import search as S
from gleanwork.operators import units as U
from gleanwork.plans.retrieve import check_citations, prompts, retrieve, source_context
from gleanwork.sources import files
from gleanwork.sources import tables as T


def ranks(df):
    return [r["unit_id"] for r in df.orderBy("rank").collect()]


def ranked(spark, scores):
    df = spark.createDataFrame([("q", u, f"{u}#{i}", i, float(s)) for i, (u, s) in enumerate(scores)], "qid string, unit_id string, part_id string, row_no int, score double")
    return df


def test_rrf_values_ties_and_representative(spark):
    bm25 = S.rank_units(ranked(spark, [("a", 3), ("b", 2), ("c", 1), ("d", 0)]), 50, positive_only=True)
    dense = S.rank_units(ranked(spark, [("a", 0.8), ("b", 0.1), ("c", 0.9), ("d", 0.5)]), 50)
    rows = {r["unit_id"]: r for r in S.fuse({"bm25": bm25, "dense": dense}).collect()}
    assert rows["a"]["score"] == 1 / 61 + 1 / 62 and rows["c"]["score"] == 1 / 61 + 1 / 63 and rows["d"]["score"] == 1 / 63
    assert sorted(rows, key=lambda u: rows[u]["rank"]) == ["a", "c", "b", "d"]
    x = S.rank_units(ranked(spark, [("y", 1), ("m", 2), ("x", 3)]), 50)
    y = S.rank_units(ranked(spark, [("y", 3), ("m", 2), ("x", 1)]), 50)
    two = {r["unit_id"]: r["score"] for r in S.fuse({"bm25": x, "dense": y}).collect()}
    assert two["x"] == two["y"]


def test_collapse_and_rerank(spark):
    df = S.rank_units(ranked(spark, [("a", 0.5), ("a", 0.9), ("b", 0.7), ("c", 0.0)]), 50, positive_only=True)
    assert [(r["unit_id"], r["part_id"]) for r in df.orderBy("rank").collect()] == [("a", "a#1"), ("b", "b#2")]
    base = S.rank_units(ranked(spark, [(f"u{i}", 10 - i) for i in range(6)]), 50)
    scores = spark.createDataFrame([("q", "u0", 0.1), ("q", "u1", 0.9), ("q", "u2", 0.5)], "qid string, unit_id string, rerank double")
    assert ranks(S.rerank_head(base, scores, 3)) == ["u1", "u2", "u0", "u3", "u4", "u5"]
    tie = spark.createDataFrame([("q", "u0", 0.5), ("q", "u1", 0.5), ("q", "u2", 0.7)], "qid string, unit_id string, rerank double")
    assert ranks(S.rerank_head(base, tie, 3))[:3] == ["u2", "u0", "u1"]


def test_bm25_by_hand(spark):
    import math

    parts = spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, []), (4, None)], "part_id long, tokens array<string>")
    q = spark.createDataFrame([("q", ["a"])], "qid string, tokens array<string>")
    avg = 5 / 4
    want = (math.log(4 - 1 + 0.5) - math.log(1.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / avg))
    assert [(r["part_id"], pytest.approx(want)) for r in S.bm25_scores(parts, q).collect()] == [(1, S.bm25_scores(parts, q).first()["score"])]
    assert S.bm25_scores(parts.filter("part_id > 9"), q).count() == 0


def corpus(spark):
    rows = [
        (1, "m1", 0, "email", "2024-03-01", "", ["Kim"], ["alpha", "beta"], [1.0, 0.0]), (2, "m1", 1, "email", "2024-03-01", "", ["Kim"], ["alpha"], [0.9, 0.1]),
        (3, "m2", 2, "email", "2024-04-01", "", ["Lee"], ["gamma"], [0.0, 1.0]), (4, "c1", 3, "chat", "2024-03-01", "2024-03-10", ["Park", "Kim"], ["beta"], [-1.0, 0.0]),
        (5, "d1", 4, "document", "", "", [], ["alpha"], [0.0, 0.0]),
    ]
    return spark.createDataFrame(rows, "part_id long, unit_id string, row_no int, unit_type string, date string, date_end string, participants array<string>, tokens array<string>, vec array<double>")


def test_filters(spark):
    c = corpus(spark)
    of = lambda f: [r["part_id"] for r in S.apply_filters(c, f).orderBy("part_id").collect()]
    assert of({"source_type": "teams_chat"}) == [4]
    assert of({"_date_gte": "2024-03-01", "_date_lte": "2024-03-31"}) == [1, 2, 4]
    assert of({"_date_eq": "2024-03-08"}) == [4]
    assert of({"participants": ["kim"], "x": None, "$and": [1]}) == [1, 2, 4]
    assert of({"unit_id": ["m2", "d1"]}) == [3, 5] and of({"unknown": 1}) == []


def test_retrieve_end_to_end(spark):
    q = spark.createDataFrame([("q", ["beta"], [1.0, 0.0])], "qid string, tokens array<string>, vec array<double>")
    got = retrieve(q, corpus(spark), S.RetrievalConfig(rerank=True)).orderBy("rank").collect()
    assert got[0]["unit_id"] == "m1" and {r["unit_id"] for r in got} == {"m1", "m2", "c1", "d1"}
    only = retrieve(q, corpus(spark), S.RetrievalConfig(use_dense=False), {"source_type": "chat"}).collect()
    assert [r["unit_id"] for r in only] == ["c1"]


def at(minutes):
    return None if minutes is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_sessions_gap_is_inclusive_and_nulls_join(spark):
    rows = [("a", at(m), i) for i, m in enumerate([0, 10, 40, 71, 80])] + [("b", None, 9), ("b", at(500), 10)]
    df = spark.createDataFrame(rows, "room string, ts timestamp, n int")
    got = {(r["room"], r["n"]): r["session"] for r in U.sessionize(df, order=["n"]).collect()}
    assert [got["a", i] for i in range(5)] == [1, 1, 1, 2, 2] and got["b", 9] == got["b", 10] == 1


def test_session_units(spark):
    df = spark.createDataFrame([("r", at(0), 1, "Kim", "hi"), ("r", at(5), 2, "kim ", "yo"), ("r", at(9), 3, "Lee", "ok")], "room string, ts timestamp, n int, sender string, body string")
    r = U.session_units(df).first()
    assert r["participants"] == ["Kim", "Lee"] and r["chat_type"] == "direct" and r["text"].split("\n")[0] == "00:00 Kim: hi" and r["unit_id"].endswith(":20240101T000000")


def test_batch_and_stream_sessions_agree(spark, tmp_path):
    from gleanwork.streaming.sessions import session_stream

    rows = [("a", at(m)) for m in (0, 30, 61)] + [("b", at(5))]
    df = spark.createDataFrame(rows, "room string, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    batch = {(r["room"], r["n_messages"]) for r in session_stream(df).collect()}
    assert batch == {("a", 2), ("a", 1), ("b", 1)}
    stream = session_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["room"], r["n_messages"]) for r in spark.table("sessions").collect()} == batch


def test_keep_first_merges(spark):
    df = spark.createDataFrame([("x", 2, ["B"]), ("x", 1, ["A", "b"]), ("y", 3, ["C"])], "unit_id string, o int, folder_paths array<string>")
    got = {r["unit_id"]: (r["o"], r["folder_paths"], r["n_duplicates"]) for r in U.keep_first(df, "unit_id", ["o"], "folder_paths").collect()}
    assert got == {"x": (1, ["A", "b"], 1), "y": (3, ["C"], 0)}


def test_headers(spark):
    row = ("2024-03-01T10:00:00+00:00", "Kim", "k@x", ["a", "b", "c", "d", "e", "f"], [], [], [], "Hello", ["f.pdf"])
    df = spark.createDataFrame([row], "date string, sender_name string, sender string, recipient_names array<string>, recipients array<string>, cc_names array<string>, cc array<string>, subject string, attachment_filenames array<string>")
    assert df.select(U.email_header()).first()[0] == "[이메일] 2024-03-01 19:00 | 보낸이: Kim | 받는이: a, b, c, d, e 외 1명 | 제목: Hello | 첨부: f.pdf"


class Chars:
    def count(self, text):
        return len(text)

    def offsets(self, text):
        return list(range(len(text)))


def test_split_text():
    assert U.split_text("abc", 5, Chars()) == [("abc", 3)] and U.split_text("  ", 5, Chars()) == []
    assert U.split_text("ab\ncd\nef", 5, Chars()) == [("ab\ncd", 5), ("ef", 2)]
    assert U.split_text("abcdefgh\nx", 5, Chars()) == [("abcde", 5), ("fgh", 3), ("x", 1)]


def test_row_blocks():
    blocks = U.row_blocks(["h", "aa", "bb", "", "cc"], [1, 2, 3, 4, 5], 7, Chars())
    assert blocks == [("h\naa\nbb", 7, 2, 3), ("h\ncc", 4, 5, 5)]
    long = U.row_blocks(["header", "aaa", "bbb"], None, 8, Chars())
    assert long[0] == ("header\naaa\nbbb", 14, 1, 3)


def test_split_units_and_back(spark):
    df = spark.createDataFrame([("u", "x" * 40 + "\n" + "y" * 40), ("e", "")], "unit_id string, text string")
    parts = U.split_units(df, 25)
    assert {(r["part_id"], r["n_tokens"]) for r in parts.collect()} == {("u#1", 20), ("u#2", 20), ("e#1", 0)}
    assert {r["unit_id"]: r["text"] for r in U.unit_text(parts).collect()} == {r["unit_id"]: r["text"] for r in df.collect()}


def test_dashboard(spark):
    df = spark.createDataFrame([("email", ["a", "b"], "2024-01-05", ["t"]), ("chat", ["b", "a", "c"], "2024/01/09", ["t", "s"]), ("attachment", ["c"], "20240201", [])], "unit_type string, participants array<string>, date string, topics array<string>")
    d = {k: [tuple(r) for r in v.collect()] for k, v in A.dashboard(df).items()}
    assert d["edges"] == [("a", "b", 2)] and d["people"][0][:2] == ("a", 2) and d["topics"][0] == ("t", 2)
    assert sorted(d["timeline"]) == [("2024-01", 1, 1, 0), ("2024-02", 0, 0, 0)]


def test_statistics(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", float("nan"))], "name string, p double")
    got = {r["name"]: r["adjusted"] for r in E.holm(p).collect()}
    assert (got["a"], got["b"], got["c"]) == (pytest.approx(0.03), pytest.approx(0.06), pytest.approx(0.06)) and got["d"] is None
    assert E.sign_flip_p([1.0] * 6) == pytest.approx(2 / 64, abs=0.01) and E.bootstrap_interval([0.2] * 5) == (pytest.approx(0.2), pytest.approx(0.2))
    same = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "a int, b int")
    assert E.weighted_kappa(same).first()["kappa"] == 1 and E.weighted_kappa(same.filter("a = 9")).first()["kappa"] is None


def test_judgments(spark):
    rows = [("q", 1, "A", 2, 1), ("q", 1, "A", 1, 2), ("q", 1, "B", 1, 1), ("q", 2, "A", 0, 1), ("q", 2, "B", 2, 1), ("q", 2, "adjudicated", 2, 3)]
    j = E.latest_judgments(spark.createDataFrame(rows, "qid string, unit_id int, annotator string, grade int, seq int"))
    assert {(r["unit_id"], r["grade"]) for r in E.finalize(j).collect()} == {(1, 1), (2, 2)}
    assert [r["unit_id"] for r in E.disputed(j).collect()] == [2]
    with pytest.raises(ValueError):
        E.finalize(j.filter("annotator <> 'adjudicated'"))


def test_metrics_for_missing_queries(spark):
    qrels = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "z", 1), ("c", "w", 0)], "qid string, unit_id string, grade int")
    run = spark.createDataFrame([("a", "y", 1), ("a", "x", 2)], "qid string, unit_id string, rank int")
    got = {r["qid"]: r for r in E.metrics(run, qrels).collect()}
    assert set(got) == {"a", "b"} and got["b"]["ndcg"] == 0 and got["b"]["recall_grade2"] is None
    assert got["a"]["ndcg"] == pytest.approx((1 + 2 / 1.5849625) / (2 + 1 / 1.5849625), abs=1e-5) and got["a"]["mrr"] == 1


def test_trec_files(spark, tmp_path):
    q = spark.createDataFrame([("q1", "u", 2), ("q0", "v", 0)], "qid string, unit_id string, grade int")
    T.write_qrels(q, str(tmp_path / "qrels"))
    assert {tuple(r) for r in T.read_qrels(spark, str(tmp_path / "qrels")).collect()} == {("q1", "u", 2), ("q0", "v", 0)}
    (tmp_path / "bad").write_text("q 0 u 7\n")
    with pytest.raises(ValueError):
        T.read_qrels(spark, str(tmp_path / "bad"))
    T.write_run(spark.createDataFrame([("q", "u", 1), ("q", "v", 2)], "qid string, unit_id string, rank int"), "R", str(tmp_path / "run"), 1)
    assert [tuple(r) for r in T.read_run(spark, str(tmp_path / "run")).collect()] == [("q", "u", 1, 1.0, "R")]


def test_index_store_versions(spark, tmp_path):
    store = T.IndexStore(spark, str(tmp_path))
    with pytest.raises(LookupError):
        store.load("c")
    store.write("c", {"parts": spark.range(3)}, "m", 4)
    store.write("c", {"parts": spark.range(5)}, "m", 4)
    assert store.load("c", "m")["parts"].count() == 5
    with pytest.raises(ValueError):
        store.load("c", "other")
    store.delete("c")
    with pytest.raises(LookupError):
        store.load("c")


def test_cases(spark):
    old = dt.datetime(2020, 1, 1)
    c = spark.createDataFrame([("x", "n", "indexing", ["a"], None, old, 1)], T.CASES)
    assert T.recover_stuck(c).first()["status"] == "error" and T.add_sources(c, "x", ["a", "b"]).first()["sources"] == ["a", "b"]
    assert T.change_status(c, "x", "ready").first()["status"] == "ready"
    with pytest.raises(ValueError):
        T.change_status(c, "x", "archived")
    with pytest.raises(RuntimeError):
        T.check_failure_rate(8, 2)


EML = b"From: Kim <k@x.com>\r\nTo: a@x.com, B <b@x.com>\r\nSubject: Hi\r\nDate: Mon, 01 Jan 2024 10:00:00 +0900\r\nMessage-ID: <m@x>\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nBody\r\n"


def office(kind):
    b = io.BytesIO()
    w, s, a = ("http://schemas.openxmlformats.org/" + x + "/2006/main" for x in ("wordprocessingml", "spreadsheetml", "drawingml"))
    with zipfile.ZipFile(b, "w") as z:
        if kind == "docx":
            p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
            z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{p("A", "Heading1")}{p("one")}{p("B", "Heading1")}{p("two")}</w:body></w:document>')
        elif kind == "xlsx":
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}"><sheets><sheet name="S"/></sheets></workbook>')
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>x</t></si></sst>')
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>5</v></c></row><row r="4"/></sheetData></worksheet>')
        else:
            z.writestr("ppt/slides/slide1.xml", f'<s xmlns:a="{a}"><a:p><a:t>one</a:t></a:p></s>')
            z.writestr("ppt/slides/slide2.xml", f'<s xmlns:a="{a}"><a:p/></s>')
    return b.getvalue()


def test_parsers():
    m = files.parse_eml(EML)
    assert m.meta["sender"] == "k@x.com" and m.meta["recipients"] == "a@x.com\nb@x.com" and m.pages[0].strip() == "Body" and m.meta["date"] == "2024-01-01T10:00:00+09:00"
    assert files.detect_format(EML) == "eml" and files.detect_format(b"%PDF-1") == "pdf" and files.detect_format(b"<!DOCTYPE html>") == "html" and files.detect_format(b"xx") is None
    assert files.parse_bytes(office("docx"), "docx")[0].pages == ["A\none", "B\ntwo"]
    sheet = files.parse_bytes(office("xlsx"), "xlsx")[0]
    assert sheet.pages == ["x\t\t5"] and sheet.rows == [2] and sheet.meta["sheet_name"] == "S"
    assert files.parse_bytes(office("pptx"), "bin")[0].pages == ["one", ""]
    assert files.decode_text("안녕".encode("cp949")) == "안녕"
    assert files.merge_names(["Kim", "lee"], ["KIM", " ", "Park"]) == ["Kim", "lee", "Park"]


def test_files_to_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "m.eml").write_bytes(EML)
    (tmp_path / "b.txt").write_text("text")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "d.bin").write_bytes(b"no")
    docs = files.parse_files(files.discover(spark, [f"file://{tmp_path}"])).collect()
    assert {(r["path"].rpartition("/")[2], r["file_type"], bool(r["error"])) for r in docs} == {("m.eml", "eml", False), ("b.txt", "txt", False), ("c.pdf", None, True)}


def test_answers(spark):
    df = spark.createDataFrame([("[출처 1] a [출처 9] [출처 9]", 2), ("없음", 2), ("찾을 수 없습니다", 2), (None, 0)], "t string, n int")
    got = [tuple(r[0]) for r in df.select(check_citations(F.col("t"), F.col("n"))).collect()]
    assert got == [(3, [9], False), (0, [], True), (0, [], False), (0, [], True)]
    src = spark.createDataFrame([("q", 1, "email", "Hi", "k@x", ["a", "b"], "text")], "qid string, n int, source_type string, subject string, sender string, recipients array<string>, content string")
    one = src.withColumn("context", source_context(src.columns))
    assert one.first()["context"] == "[유형: 이메일 | 제목: Hi | From: k@x | To: a, b]\ntext"
    assert prompts(one).first()["context"].startswith("[출처 1]\n[유형")

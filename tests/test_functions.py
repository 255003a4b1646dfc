import pytest
from pyspark.sql import functions as F

from gleanwork.functions import ids
from gleanwork.functions import text as X
from gleanwork.functions.language import detect
from gleanwork.functions.mail import clean_body, is_ad_subject, is_forwarded
from gleanwork.plans.queries import merge_filters, parse_query


def test_tokens_whole_and_split():
    t = X.tokenize_text("Mail a.b@x-y.co.kr about EX-2024/7, 1,234,567.5 won. Café 東京都 회의록")
    assert "a.b@x-y.co.kr" in t and "ex-2024/7" in t and "1234567.5" in t
    assert "cafe" in t and {"東京", "京都"} <= set(t) and "회의록" in t and "회의" in t
    assert X.tokenize_text("") == [] and X.tokenize_text(None) == []
    assert X.tokenize_text("語") == ["語"]


def test_columns(spark):
    df = spark.createDataFrame([("<p>a&nbsp;b &amp; c</p><script>x</script>", "東京都", "abcde")], "h string, c string, t string")
    r = df.select(X.strip_html(F.col("h")), X.strip_mail_html(F.col("h")), X.cjk_bigrams(F.col("c")), X.token_estimate(F.col("t")), X.fold(F.lit("ÉTÉ"))).first()
    assert list(r) == ["a b & c", "a b & c", ["東京", "京都"], 2, "ete"]
    r = spark.range(1).select(X.truncate_bytes(F.lit("aé東"), F.lit(4)), X.sanitize(F.lit("a​  b\x07\nc"))).first()
    assert list(r) == ["aé", "a b\nc"]


def test_topics_ties_and_short_texts(spark):
    df = spark.createDataFrame([("zebra apple zebra apple mango the the",), ("short",), (None,)], "t string")
    assert [r[0] for r in df.select(X.topics(F.col("t"))).collect()] == [["zebra", "apple", "mango"], [], []]


def test_fake_embedding_is_unit_and_repeatable():
    v = X.fake_embedding("alpha beta beta")
    assert v == X.fake_embedding("alpha beta beta") and sum(x * x for x in v) == pytest.approx(1)
    assert X.fake_embedding("") == [0.0] * 64


@pytest.mark.parametrize(
    "body, subject, wanted",
    [
        ("Hi\n\nOn Mon, 1 Jan 2024, X wrote:\n> old", "", "Hi"),
        ("Hi\n-----Original Message-----\nold", "RE: x", "Hi"),
        ("Hi\nFrom: a\nTo: b\nold", "", "Hi"),
        ("Hi\nFrom: a\nTo: b\nold", "FW: x", "Hi\nFrom: a\nTo: b\nold"),
        ("From: a\nTo: b\nbody", "", "From: a\nTo: b\nbody"),
        ("a\n> one\nb", "", "a\n> one\nb"),
        ("a\n> one\n> two\nb", "", "a\nb"),
        ("text\n-- \nname", "", "text"),
        ("text\nSent from my iPhone", "", "text"),
        ("-----Original Message-----\nonly", "", "-----Original Message-----\nonly"),
        ("a\n\n\n\nb", "", "a\n\nb"),
        ("", "", ""),
        (None, None, None),
    ],
)
def test_clean_body(body, subject, wanted):
    assert clean_body(body, subject) == wanted


def test_subjects(spark):
    df = spark.createDataFrame([("Fwd: x", 1), ("RE: FW: x", 2), ("(광고) sale", 3), ("전달：x", 4), (None, 5)], "s string, n int")
    r = df.orderBy("n").select(is_forwarded(F.col("s")), is_ad_subject(F.col("s"))).collect()
    assert [tuple(x) for x in r] == [(True, False), (False, False), (False, True), (True, False), (False, False)]


def test_language():
    assert detect("the cat is in the house and it was good for us")["lang"] == "en"
    mixed = detect("회의 내용을 정리해서 보내 드립니다 확인 부탁\nthe plan is in the file and it was sent to all of you")
    assert {mixed["lang"], mixed["second"]} == {"ko", "en"} and mixed["mixed"]
    assert detect("東京でかな を使う日本語の文章です")["lang"] == "ja" and detect("ok")["lang"] == "und" and detect(None)["lang"] == "und"


def test_ids(spark):
    df = spark.createDataFrame([("<A@B>", "doc:abc:p3")], "m string, p string")
    e = F.lit("")
    r = df.select(
        ids.email_id(F.col("m"), e, e, e, e) == ids.email_id(F.lit("  <a@b> "), e, e, e, e), ids.attachment_id(F.col("p"), F.lit(2)),
        ids.chat_id(F.lit("room"), F.lit(None).cast("timestamp")).endswith(":00000000T000000"), ids.part_number(F.lit("u#10")), ids.room_key(F.lit("f"), F.lit("")),
    ).first()
    assert list(r) == [True, "att:abc:p3:2", True, 10, "f"]


@pytest.mark.parametrize(
    "query, filters, intent",
    [
        ("2025년 3월 메일에서 계약 요약", {"source_type": "email", "_date_gte": "2025-03-01", "_date_lte": "2025-04-01"}, "summarize"),
        ("2024-01-01 2024-02-01 budget", {"_date_gte": "2024-01-01", "_date_lte": "2024-02-01"}, "search"),
        ("2024-01-01 budget", {"_date_eq": "2024-01-01"}, "search"),
        ("1월부터 3월까지 비교", {"_date_gte": "2025-01-01", "_date_lte": "2025-04-01"}, "compare"),
        ("2023년 12월 타임라인", {"_date_gte": "2023-12-01", "_date_lte": "2023-12-31"}, "timeline"),
        ("홍길동이 보낸 자료", {"participants": ["홍길동"]}, "search"),
        ("written by alice and modified by bob", {"author": "alice", "last_modified_by": "bob"}, "search"),
        ("최근 3개월 회의", {}, "search"),
    ],
)
def test_parse_query(query, filters, intent):
    p = parse_query(query)
    assert (p.filters, p.intent) == (filters, intent)


def test_parse_query_cleaning_and_merge():
    assert parse_query("메일에서 계약서 내용").cleaned == "계약서 내용" and parse_query(" ").cleaned == " "
    assert merge_filters({"a": 1, "b": 2}, {"b": 3, "c": None}) == {"a": 1, "b": 3}

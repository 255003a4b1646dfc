"""Scalar text functions as Columns; what needs normalisation or sequential rules runs in Arrow-batched pandas UDFs."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: character ranges, word lists and patterns that results depend on ----
HANGUL = "가-힣ᄀ-ᇿ㄰-㆏"
CJK = "一-鿿㐀-䶿豈-﫿぀-ゟ゠-ヿ"
EMAIL_PATTERN = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
CODE_PATTERN = r"(?<!\w)[A-Za-z0-9]+(?:[-_/.][A-Za-z0-9]+)+(?!\w)"
AMOUNT_PATTERN = r"(?<!\d)\d{1,3}(?:,\d{3})+(?:\.\d+)?(?!\d)"
KO_STOPWORDS = (
    "있다 하다 되다 이다 것 수 등 및 또는 그리고 하는 있는 되는 위해 대한 통해 에서 으로 에서는 합니다 있습니다 됩니다 입니다 것입니다 바랍니다"
    " 이 그 저 이것 그것 여기 거기 무엇 어떤 않 못 안 더 매우 아주 정말 너무"
).split()
EN_STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might can shall must need"
    " i you he she it we they me him her us them my your his its our their this that these those what which who whom"
    " and or but if then so because as of in on at to for with by from about not no nor very too also just only"
).split()
# ---- end of fixed values ----

_EMAIL, _CODE, _AMOUNT = re.compile(EMAIL_PATTERN), re.compile(CODE_PATTERN), re.compile(AMOUNT_PATTERN)
_KO, _CJK = re.compile(f"[{HANGUL}]+"), re.compile(f"[{CJK}]+")
_OTHER = re.compile(f"[^\\W_{HANGUL}{CJK}]+")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def latin_words(text: Column) -> Column:
    """Lower-cased runs of letters a-z and digits: the part of the tokenizer that SQL can express."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def unicode_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def fold_word(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


def korean_fallback(run: str) -> list[str]:
    """Stands in for a morphological analyser, of which none is installed: the run itself and its bigrams."""
    return [run] if len(run) < 3 else [run, *(run[i : i + 2] for i in range(len(run) - 1))]


def tokenize_text(text: str | None, korean=korean_fallback) -> list[str]:
    """Tokens of one text: addresses, codes and amounts whole, then what each script's own rule gives. A multiset; the
    order has no meaning. `korean` splits one run of Hangul."""
    if not text:
        return []
    text = unicodedata.normalize("NFC", text)
    whole = [m.lower() for p in (_EMAIL, _CODE) for m in p.findall(text)]
    whole += [m.replace(",", "") for m in _AMOUNT.findall(text)]
    hangul = [t for run in _KO.findall(text) for t in korean(run)]
    han = [run[i : i + 2] for run in _CJK.findall(text) for i in range(max(1, len(run) - 1))]
    return whole + hangul + han + [fold_word(w) for w in _OTHER.findall(text)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokenize(text: pd.Series) -> pd.Series:
    """The engine's tokenizer, the same for documents and queries."""
    return text.map(tokenize_text)


@F.pandas_udf(T.StringType())
def fold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else fold_word(t))


def cjk_bigrams(run: Column) -> Column:
    """Two-letter windows of a run; a single letter stays."""
    return F.when(F.length(run) < 2, F.array(run)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
    )


def token_estimate(text: Column, chars_per_token: float = 2.0) -> Column:
    """max(1, characters / 2), rounded half to even; 0 for null."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(F.length(text) / F.lit(chars_per_token)).cast("int")))


def llm_token_estimate(text: Column) -> Column:
    """floor(max(bytes / 3, characters / 2))."""
    return F.floor(F.greatest(F.octet_length(text) / F.lit(3), F.length(text) / F.lit(2))).cast("long")


def code_counts(text: Column) -> Column:
    """How many addresses, codes and amounts a text holds."""
    t = F.coalesce(text, F.lit(""))
    count = lambda p: F.regexp_count(t, F.lit("(?U)" + p)).cast("long")
    return F.struct(count(EMAIL_PATTERN).alias("emails"), count(CODE_PATTERN).alias("codes"), count(AMOUNT_PATTERN).alias("amounts"))


def strip_html(source: Column) -> Column:
    """Text of an HTML document: scripts and styles go, tags become spaces, common entities are decoded, white space collapses."""
    t = F.regexp_replace(F.coalesce(source, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def strip_mail_html(source: Column) -> Column:
    """The mailbox variant: br and p end lines, four entities are decoded, line breaks stay."""
    t = F.regexp_replace(F.coalesce(source, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</?p[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", "")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def sanitize(text: Column) -> Column:
    """For an embedder: control and invisible characters go, runs of blanks become one; line feeds stay."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{Cc}&&[^\n\t]]|\p{Cf}|\p{Cs}|\p{Co}", "")
    return F.trim(F.regexp_replace(t, r"[ \t ]+", " "))


@F.pandas_udf(T.StringType())
def truncate_bytes(text: pd.Series, limit: pd.Series) -> pd.Series:
    """As many whole characters as fit into so many UTF-8 bytes."""
    return pd.Series([None if t is None else t.encode()[: int(n)].decode(errors="ignore") for t, n in zip(text, limit)])


def text_stats(text: Column) -> Column:
    """Characters, bytes, estimated tokens and shares (percent) of scripts among the letters."""
    t = F.coalesce(text, F.lit(""))
    of = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
    letters = F.greatest(of(r"\p{L}"), F.lit(1.0))
    share = lambda p: F.round(100 * of(p) / letters, 1)
    return F.struct(
        F.length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"), llm_token_estimate(t).alias("tokens"),
        share(f"[{HANGUL}]").alias("hangul"), share(f"[{CJK}]").alias("cjk"), share("[A-Za-z]").alias("latin"),
    )


def topic_words(text: Column) -> Column:
    """What can be a topic, in order: Korean words of two syllables, then English ones of three letters, without stop words;
    none for texts under ten characters."""
    t = F.coalesce(text, F.lit(""))
    ko = F.filter(F.regexp_extract_all(t, F.lit("[가-힣]{2,}"), F.lit(0)), lambda w: ~w.isin(KO_STOPWORDS))
    en = F.filter(F.regexp_extract_all(F.lower(t), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(EN_STOPWORDS))
    return F.when(F.length(F.trim(t)) < 10, F.array().cast("array<string>")).otherwise(F.concat(ko, en))


def topics(text: Column, most: int = 5) -> Column:
    """The most frequent of topic_words, of equals the one seen first, row by row. For whole tables see topics_of."""
    return _most_common(topic_words(text), F.lit(most))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _most_common(words: pd.Series, most: pd.Series) -> pd.Series:
    from collections import Counter

    return pd.Series([[w for w, _ in Counter(list(x)).most_common(int(n))] for x, n in zip(words, most)], dtype=object)


def topics_of(units: DataFrame, key: str, text: str = "text", most: int = 5) -> DataFrame:
    """key, topic, rank: the topics of every unit, by counts with partial results; no text leaves the JVM."""
    each = units.select(key, F.posexplode(topic_words(F.col(text))).alias("i", "topic"))
    counted = each.groupBy(key, "topic").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select(key, "topic", "rank")


def whitespace_words(text: Column) -> Column:
    """Lower-cased runs without white space, without punctuation at their ends: the plainest tokenizer."""
    edged = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: F.regexp_replace(w, r"(?U)^[\W_]+|[\W_]+$", ""))
    return F.filter(edged, lambda w: w != "")


def script_language(text: Column) -> Column:
    """ko, ja, zh, cs, es, en or unknown, by shares of scripts and some letters, in the first 3,000 characters."""
    t = F.substring(F.coalesce(text, F.lit("")), 1, 3000)
    of = lambda p: F.regexp_count(t, F.lit(p))
    hangul, han, kana = of("[가-힣ㄱ-ㆎ]"), of("[一-鿿]"), of("[぀-ヿ]")
    latin = of(r"[\p{L}&&[^가-힣ㄱ-ㆎ一-鿿぀-ヿ]]")
    letters = hangul + han + kana + latin
    return (
        F.when(letters == 0, "unknown").when(hangul / letters >= 0.2, "ko").when(kana / letters >= 0.1, "ja").when(han / letters >= 0.3, "zh")
        .when(of("[ěščřžůťďňĚŠČŘŽŮŤĎŇ]") >= 2, "cs").when((of("[ñÑ]") >= 1) | (of("[áéíóúÁÉÍÓÚ]") >= 3), "es").otherwise("en")
    )


def language_group(text: Column, ko_least: float = 0.7, en_most: float = 0.1) -> Column:
    """ko, en or mixed by the share of Hangul among Hangul and a-z; with fewer than five such letters, by script_language."""
    t = F.substring(F.coalesce(text, F.lit("")), 1, 3000)
    hangul, latin = (F.regexp_count(t, F.lit(p)) for p in ("[가-힣ㄱ-ㆎ]", "[A-Za-z]"))
    lang, share = script_language(t), hangul / (hangul + latin)
    few = F.when(lang.isin("unknown", "ko", "en"), lang).otherwise("other")
    return F.when(hangul + latin < 5, few).when(share >= ko_least, "ko").when(share <= en_most, "en").otherwise("mixed")


def fake_embedding(text: str | None, dim: int = 64) -> list[float]:
    """A deterministic embedding without a model: tokens hashed by blake2b into signed buckets, normalised."""
    v = [0.0] * dim
    for token in tokenize_text(text):
        h = hashlib.blake2b(token.encode(), digest_size=8).digest()
        v[int.from_bytes(h[:4], "little") % dim] += 1.0 if h[4] & 1 else -1.0
    norm = sum(x * x for x in v) ** 0.5
    return [x / norm for x in v] if norm else v


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def fake_embed(text: pd.Series, dim: pd.Series) -> pd.Series:
    return pd.Series([fake_embedding(t, int(d)) for t, d in zip(text, dim)], dtype=object)

"""Cleaning of mail bodies: quoted replies, signatures and disclaimers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: what mail programs write ----
SEPARATORS = [
    r"-{2,}\s*Original Message\s*-{2,}", r"-{2,}\s*원본\s*(?:메시지|메일)\s*-{2,}", r"-{2,}\s*Původní zpráva\s*-{2,}",
    r"-{2,}\s*Mensaje original\s*-{2,}", r"-{2,}\s*Ursprüngliche Nachricht\s*-{2,}", r"-{2,}\s*Message d'origine\s*-{2,}",
    r"-{2,}\s*原始邮件\s*-{2,}", r"-{2,}\s*原始郵件\s*-{2,}", r"^_{10,}\s*$",
]
WROTE_LINES = [
    r"^On .{4,200}wrote:\s*$", r"^El .{4,200}escribió:\s*$", r"^Dne .{4,200}napsal(?:\(a\)|a)?:\s*$", r"^Am .{4,200}schrieb .{0,200}:\s*$",
    r"^Le .{4,200}a écrit\s*:\s*$", r"^在.{2,200}写道[:：]\s*$", r"^.{2,100}님이 작성:\s*$",
]
HEADER_LABELS = (
    "From|Sent|To|Cc|Subject|Date|보낸 사람|받는 사람|보낸 날짜|참조|제목|Od|Odesláno|Komu|Kopie|Předmět|De|Enviado|Enviado el|Para|CC|Asunto"
    "|Von|Gesendet|An|Betreff|Envoyé|À|Objet|发件人|发送时间|收件人|抄送|主题|寄件者|寄件日期|收件者|副本|主旨"
).split("|")
SIGNATURES = [r"^-- \s*$", r"^Sent from my (?:iPhone|iPad|Galaxy|Android|mobile)\s*$"]
DISCLAIMERS = [
    r"^This (?:email|message|e-mail) (?:and any attachments? )?(?:is|are) (?:intended |)?(?:solely )?(?:for |confidential)",
    r"^(?:본\s*(?:메일|이메일|메시지)은?\s*.{0,20}기밀)",
    r"^CONFIDENTIALITY\s+(?:NOTICE|WARNING)",
]
FORWARD_SUBJECT = r"^\s*(?:fw|fwd|전달|转发|轉寄|rv|př|wg)\s*[:：]"
AD_SUBJECT = r"^\s*[\[(（【〔<［]\s*광\s*고\s*[\])）】〕>］]"
# ---- end of fixed values ----

_QUOTE = re.compile("|".join(SEPARATORS + WROTE_LINES), re.I | re.M)
_LABEL = re.compile(r"\s*\*?(?:" + "|".join(re.escape(x) for x in sorted(HEADER_LABELS, key=len, reverse=True)) + r")\*?\s*[:：]", re.I)
_SIGNATURE, _DISCLAIMER = (re.compile("|".join(p), re.I | re.M) for p in (SIGNATURES, DISCLAIMERS))


def is_header_line(line: str) -> bool:
    return _LABEL.match(line) is not None


def quote_start(text: str) -> int | None:
    """Where a quoted reply begins: at a separator, at a line that says who wrote, or at two header lines that aren't the
    text's first; the earliest of these."""
    places = [m.start() for m in [_QUOTE.search(text)] if m]
    at, before, before_at = 0, False, 0
    for n, line in enumerate(text.split("\n")):
        label = is_header_line(line)
        if label and before:
            if n - 1 > 0:
                places.append(before_at)
            break
        before, before_at = label, at
        at += len(line) + 1
    found = min(places, default=len(text))
    return found if found < len(text) else None


def drop_quoted_lines(text: str) -> str:
    """Without runs of two or more lines that begin with >."""
    kept, run = [], []
    for line in [*text.split("\n"), None]:
        if line is not None and line.lstrip().startswith(">"):
            run.append(line)
            continue
        if len(run) < 2:
            kept += run
        run = []
        if line is not None:
            kept.append(line)
    return "\n".join(kept)


def clean_body(body: str | None, subject: str | None = "") -> str | None:
    """The body without quotes (kept if the subject says that it is a forward), signature and disclaimer; if nothing is
    left, the body, trimmed."""
    if not body:
        return body
    text = body.replace("\r\n", "\n")
    if not re.match(FORWARD_SUBJECT, subject or "", re.I):
        text = text[: quote_start(text)]
    text = drop_quoted_lines(text)
    for pattern in (_SIGNATURE, _DISCLAIMER):
        m = pattern.search(text)
        text = text[: m.start()] if m else text
    return re.sub(r"\n{3,}", "\n\n", text).strip() or body.strip()


@F.pandas_udf(T.StringType())
def strip_quoted(body: pd.Series, subject: pd.Series) -> pd.Series:
    return pd.Series([clean_body(b, s) for b, s in zip(body, subject)], dtype=object)


def is_forwarded(subject: Column) -> Column:
    return F.coalesce(subject.rlike("(?iu)" + FORWARD_SUBJECT), F.lit(False))


def is_ad_subject(subject: Column) -> Column:
    return F.coalesce(subject.rlike(AD_SUBJECT), F.lit(False))


def body_of_message(text: Column) -> Column:
    """What follows the first blank line, if a block of header lines comes before it."""
    head = F.substring_index(text, "\n\n", 1)
    return F.when(head.rlike(r"^(From|To|Cc|Subject|Date): ") & text.contains("\n\n"), F.substring(text, F.length(head) + 3, F.length(text))).otherwise(text)

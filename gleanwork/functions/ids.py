"""Deterministic identifiers of evidence units, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sha(text: Column, n: int) -> Column:
    return F.substring(F.sha1(text), 1, n)


def email_id(message_id: Column, sender: Column, date: Column, subject: Column, body: Column) -> Column:
    """By the message id; without one, by sender, date, subject and the body's first 200 characters."""
    known = F.lower(F.trim(F.coalesce(message_id, F.lit(""))))
    blank = lambda c: F.coalesce(c, F.lit(""))
    other = F.concat_ws("|", blank(sender), blank(date), blank(subject), F.substring(blank(body), 1, 200))
    return F.concat(F.lit("em:"), F.when(known != "", _sha(known, 16)).otherwise(_sha(other, 16)))


def chat_id(room: Column, start: Column) -> Column:
    """By room and start (UTC); zeros for a session without a time."""
    when = F.coalesce(F.date_format(start, "yyyyMMdd'T'HHmmss"), F.lit("00000000T000000"))
    return F.concat(F.lit("ch:"), _sha(room, 10), F.lit(":"), when)


def document_id(path: Column, suffix: Column | None = None) -> Column:
    return F.concat(F.lit("doc:"), _sha(path, 12), F.lit("") if suffix is None else suffix)


def attachment_id(parent: Column, ordinal: Column, suffix: Column | None = None) -> Column:
    return F.concat(F.lit("att:"), F.regexp_replace(parent, "^[^:]*:", ""), F.lit(":"), ordinal.cast("string"), F.lit("") if suffix is None else suffix)


def room_key(folder: Column, topic: Column) -> Column:
    return F.when(F.coalesce(topic, F.lit("")) != "", F.concat_ws("__", folder, topic)).otherwise(folder)


def part_number(part_id: Column) -> Column:
    """Numeric, so that #10 comes after #9."""
    return F.substring_index(part_id, "#", -1).cast("int")

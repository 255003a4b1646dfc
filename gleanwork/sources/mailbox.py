"""Mailbox files to mails and chats: a reader gives the messages of a file with their folders; folders of chats are told by
their names. Readers of PST and OST need a library and are registered; mbox files are read here."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions.text import strip
from gleanwork.sources.files import parse_files

#: Names of folders of chats, or parts of them.
CHAT_FOLDERS = ["Teams Chat", "Conversation History", "Team Chat", "TeamsMessagesData"]
MESSAGES = "path string, folder string, n int, content binary, error string"


def read_mbox(content: bytes) -> Iterator[tuple[str, bytes]]:
    """Messages begin with a line `From `, at the top or after a blank line; `>From ` in them is `From `. The folder is
    that of the header X-Folder, or none."""
    lines = list(re.finditer(rb"(?:\A|(?<=\n\n)|(?<=\r\n\r\n))From [^\n]*\n", content))
    for a, z in zip((m.end() for m in lines), [*(m.start() for m in lines[1:]), len(content)]):
        message = re.sub(rb"(?m)^>(>*From )", rb"\1", content[a:z])
        head = re.split(rb"\r?\n\r?\n", message, maxsplit=1)[0]
        folder = re.search(rb"(?mi)^X-Folder:[ \t]*([^\r\n]*)", head)
        yield (folder[1].decode("utf-8", "replace").strip() if folder else ""), message


READERS: dict[str, Callable[[bytes], Iterator[tuple[str, bytes]]]] = {"mbox": read_mbox}


def register_mailbox(extension: str, reader: Callable[[bytes], Iterator[tuple[str, bytes]]]) -> None:
    """reader: the bytes of a mailbox to (folder, message as in an EML file)."""
    READERS[extension.lower().lstrip(".")] = reader


def mailbox_messages(files: DataFrame) -> DataFrame:
    """path, folder, n, content, error of each message. files: path, content. What a reader gave before it failed is kept;
    the failure is a row of its own, as is a file without a reader."""
    readers = dict(READERS)

    def run(batches):
        columns = ["path", "folder", "n", "content", "error"]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                n, rows, held = 0, [], 0
                try:
                    for folder, message in readers[path.rpartition(".")[2].lower()](bytes(content or b"")):
                        rows.append((path, folder, n, message, None))
                        n, held = n + 1, held + len(message)
                        if held > 16_000_000:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                except Exception as e:  # a broken file is a result, not a failure of the job
                    rows.append((path, None, n, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, MESSAGES)


def is_chat_folder(folder: Column) -> Column:
    return F.lower(F.coalesce(folder, F.lit(""))).rlike("|".join(re.escape(name.lower()) for name in CHAT_FOLDERS))


def mail_documents(messages: DataFrame) -> DataFrame:
    """Documents (see files.parse_files) of messages outside chats' folders. Their paths are the mailbox's, folder and
    number, so that each message is a file of its own. Failures are rows with an error."""
    own = F.concat(F.col("path"), F.lit("/"), F.coalesce("folder", F.lit("")), F.lit("#"), F.col("n").cast("string"), F.lit(".eml"))
    good = messages.filter("error is null").filter(~is_chat_folder(F.col("folder")))
    parsed = parse_files(good.select(own.alias("path"), "content"))
    bad = messages.filter("error is not null").select(
        "path", *[F.lit(None).cast(f.dataType).alias(f.name) for f in parsed.schema.fields if f.name not in ("path", "error")], "error"
    )
    return parsed.unionByName(bad.withColumn("doc_no", F.lit(0)))


def chat_messages(messages: DataFrame) -> DataFrame:
    """folder, topic, ts, sender, body, n of messages in chats' folders: see plans.index.chat_units. The topic is the subject.
    A message that can't be parsed has no sender and an empty body."""
    chats = messages.filter("error is null").filter(is_chat_folder(F.col("folder")))
    # A path carries what belongs to a message through the parser; "\0" is in no path or folder.
    key = F.concat_ws("\0", "path", "folder", F.col("n").cast("string"))
    parsed = parse_files(chats.select(F.concat(key, F.lit("\0.eml")).alias("path"), "content"))
    of = F.split("path", "\0")
    m = lambda k: F.coalesce(F.try_element_at("meta", F.lit(k)), F.lit(""))
    return parsed.select(
        of[1].alias("folder"), m("subject").alias("topic"), F.try_to_timestamp(m("date")).alias("ts"), F.when(m("sender_name") != "", m("sender_name")).otherwise(m("sender")).alias("sender"),
        strip(F.coalesce(F.try_element_at("pages", F.lit(1)), F.lit(""))).alias("body"), of[2].cast("int").alias("n"),
    )

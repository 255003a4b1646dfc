"""Mailboxes to mails and chats."""

from pyspark.sql import functions as F

from gleanwork.plans import index as I
from gleanwork.sources import mailbox
from gleanwork.sources.tables import IndexStore


def message(subject: str, text: str, folder: str = "", minute: int = 0) -> bytes:
    head = f"From - x\nFrom: Kim <k@x.com>\nTo: a@x.com\nSubject: {subject}\nDate: Mon, 01 Jan 2024 10:{minute:02d}:00 +0000\nMessage-ID: <{subject}-{minute}@x>\n"
    return (head + (f"X-Folder: {folder}\n" if folder else "") + f"\n{text}\n\n").encode()


BOX = message("Budget", "the budget of the harbour project\n>From here on") + message("crew", "hello all", "Inbox/Teams Chat", 1) + message("crew", "good morning", "Inbox/Teams Chat", 5)


def test_mbox():
    found = list(mailbox.read_mbox(BOX))
    assert [f for f, _ in found] == ["", "Inbox/Teams Chat", "Inbox/Teams Chat"] and b"\nFrom here on" in found[0][1]
    assert list(mailbox.read_mbox(b"")) == [] and list(mailbox.read_mbox(b"no message")) == []


def test_routing(spark):
    late = message("late", "kept")[9:]

    def broken(content):
        yield "Conversation History", late
        raise OSError("cut off")

    mailbox.register_mailbox(".PST", broken)
    try:
        rows = [("a.mbox", bytearray(BOX)), ("b.pst", bytearray(b"x")), ("c.ost", bytearray(b"x")), ("d.mbox", None)]
        found = mailbox.mailbox_messages(spark.createDataFrame(rows, "path string, content binary"))
        assert found.filter("error is null").count() == 4 and {r["path"] for r in found.filter("error is not null").collect()} == {"b.pst", "c.ost"}
        mails = {r["path"]: r for r in mailbox.mail_documents(found).collect()}
        assert set(mails) == {"a.mbox/#0.eml", "b.pst", "c.ost"} and mails["a.mbox/#0.eml"]["meta"]["subject"] == "Budget" and "cut off" in mails["b.pst"]["error"]
        chats = mailbox.chat_messages(found).orderBy("topic", "n").collect()
        assert [(c["folder"], c["topic"], c["sender"], c["body"], c["n"]) for c in chats] == [
            ("Inbox/Teams Chat", "crew", "Kim", "hello all", 1), ("Inbox/Teams Chat", "crew", "Kim", "good morning", 2), ("Conversation History", "late", "Kim", "kept", 0),
        ]
        assert all(c["ts"] is not None for c in chats)
    finally:
        del mailbox.READERS["pst"]


def test_mailbox_in_an_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mbox").write_bytes(BOX)
    store = IndexStore(spark, f"file://{tmp_path}/index")
    I.index_files(spark, [f"file://{tmp_path}/in"], store, "case")
    parts = {r["unit_type"]: r for r in store.load("case")["parts"].select("unit_type", "text", "source_file").collect()}
    assert set(parts) == {"email", "chat"} and "harbour" in parts["email"]["text"] and "hello all" in parts["chat"]["text"] and "good morning" in parts["chat"]["text"]

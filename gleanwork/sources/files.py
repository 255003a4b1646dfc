"""Files to documents: discovery, format detection and parsers that need no more than the standard library.

PST and OST mailboxes need a library that may be missing: register a parser for them; without one their rows say so in
`error`, and nothing is made up. Pictures of pages: see sources.ocr.
"""

from __future__ import annotations

import email
import email.policy
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.sources.ole import read_msg, read_xls
from gleanwork.sources.pdf import read_pdf

# ---- fixed values ----
SUPPORTED = ["pdf", "docx", "pptx", "xlsx", "xls", "html", "htm", "txt", "eml", "msg", "pst", "ost"]
CHARSETS = ["utf-8", "utf-8-sig", "cp949", "euc-kr", "latin-1"]
EXCLUDED = ["png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "svg", "webp", "ico", "mp3", "mp4", "wav", "avi", "mov", "zip", "7z", "rar", "exe", "dll", "ics", "vcf"]
# ---- end of fixed values ----
W, A, S = ("{http://schemas.openxmlformats.org/" + x + "/2006/main}" for x in ("wordprocessingml", "drawingml", "spreadsheetml"))


@dataclass
class Parsed:
    """pages: texts in order (a blank one keeps its number); rows: for sheets, original row numbers."""

    file_type: str
    pages: list[str] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)
    meta: dict[str, str] = field(default_factory=dict)
    attachments: list[tuple[str, bytes]] = field(default_factory=list)


def detect_format(content: bytes) -> str | None:
    """By what the bytes are, not by the name."""
    if content.startswith(b"%PDF"):
        return "pdf"
    if content.startswith(b"PK\x03\x04"):
        try:
            names = zipfile.ZipFile(io.BytesIO(content)).namelist()
        except zipfile.BadZipFile:
            return None
        return next((ext for folder, ext in (("word/", "docx"), ("ppt/", "pptx"), ("xl/", "xlsx")) if any(n.startswith(folder) for n in names)), None)
    if content.startswith(b"\xd0\xcf\x11\xe0"):
        return "msg" if "__properties_version".encode("utf-16-le") in content else "xls"
    head = content[:4096].decode("latin-1")
    if len(re.findall(r"(?mi)^(?:from|to|cc|subject|date|message-id|received|mime-version|return-path):", head.split("\n\n")[0].replace("\r", ""))) >= 2:
        return "eml"
    if re.match(r"(?is)\s*(?:<!doctype html|<html|<head|<body)", head):
        return "html"
    return None


def decode_text(content: bytes) -> str:
    """The first charset that fits; the last of them always does."""
    for name in CHARSETS:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return ""


def html_text(content: bytes | str) -> str:
    import html

    t = content if isinstance(content, str) else decode_text(content)
    t = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", t)
    t = re.sub(r"(?s)<[^>]+>", " ", t)
    return " ".join(html.unescape(t).split())


def pdf_date(value: Column) -> Column:
    """D:YYYYMMDDHHmmSS and what follows, as an ISO time; missing digits are 0, the zone is dropped; as it is if that is no time."""
    digits = F.rpad(F.substring(F.regexp_replace(value, "[^0-9]", ""), 1, 14), 14, "0")
    at = F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), value, F.lit(""))


def addresses(value: str | None) -> list[str]:
    return [a for _, a in getaddresses([value or ""]) if a]


def display_names(value: str | None) -> list[str]:
    return [n.strip() or a for n, a in getaddresses([value or ""]) if n.strip() or a]


def merge_names(*lists: list[str]) -> list[str]:
    """In order; of names that differ in case only, the first."""
    found: dict[str, str] = {}
    for name in (n.strip() for names in lists for n in names):
        if name:
            found.setdefault(name.lower(), name)
    return list(found.values())


def parse_eml(content: bytes) -> Parsed:
    """Headers as metadata, the plain body before the HTML one; a message inside is one attachment, not opened."""
    m = email.message_from_bytes(content, policy=email.policy.default)
    body = m.get_body(preferencelist=("plain", "html")) if not m.is_multipart() or m.get_content_type() != "message/rfc822" else None
    text = ""
    if body is not None:
        raw = body.get_payload(decode=True) or b""
        try:
            text = raw.decode(body.get_content_charset() or "utf-8")
        except (LookupError, UnicodeDecodeError):
            text = decode_text(raw)
        text = html_text(text) if body.get_content_type() == "text/html" else text
    attached = []
    for n, part in enumerate(m.iter_attachments() if m.is_multipart() else [], 1):
        if part.get_content_type() == "message/rfc822":
            inner = part.get_payload()[0] if isinstance(part.get_payload(), list) else None
            attached.append((f"{(inner['subject'] if inner else None) or f'message-{n}'}.eml", inner.as_bytes() if inner else b""))
        else:
            attached.append((part.get_filename() or f"attachment-{n}", part.get_payload(decode=True) or b""))
    try:
        date = parsedate_to_datetime(m["date"]).isoformat() if m["date"] else ""
    except (TypeError, ValueError):
        date = ""
    meta = {
        "subject": str(m["subject"] or ""), "sender": next(iter(addresses(m["from"])), ""), "sender_name": next(iter(display_names(m["from"])), ""),
        "recipients": "\n".join(addresses(m["to"])), "cc": "\n".join(addresses(m["cc"])), "date": date, "message_id": str(m["message-id"] or "").strip("<> "),
        "in_reply_to": str(m["in-reply-to"] or "").strip("<> "), "references": "\n".join(re.findall(r"<([^>]+)>", str(m["references"] or ""))),
        "participants": "\n".join(merge_names(addresses(m["from"]), addresses(m["to"]), addresses(m["cc"]))),
    }
    return Parsed("eml", [text], meta=meta, attachments=attached)


def _core_properties(z: zipfile.ZipFile) -> dict[str, str]:
    names = {"creator": "author", "lastModifiedBy": "last_modified_by", "created": "created_date", "modified": "last_modified"}
    try:
        root = ET.fromstring(z.read("docProps/core.xml"))
    except (KeyError, ET.ParseError):
        return {}
    return {names[k]: e.text or "" for e in root if (k := e.tag.rpartition("}")[2]) in names}


def parse_docx(content: bytes) -> Parsed:
    """Sections between headings (levels 1-3 and title); tables follow as a section of their own."""
    z = zipfile.ZipFile(io.BytesIO(content))
    body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
    sections: list[list[str]] = [[]]
    tables = []
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{W}t"))
    for e in body if body is not None else []:
        if e.tag == f"{W}p":
            style = e.find(f"{W}pPr/{W}pStyle")
            if style is not None and re.fullmatch(r"(?i)title|heading\s?[1-3]|[1-3]", style.get(f"{W}val") or "") and any(x.strip() for x in sections[-1]):
                sections.append([])
            sections[-1].append(text(e))
        elif e.tag == f"{W}tbl":
            tables.append("[표]\n" + "\n".join("\t".join(text(c) for c in r.iter(f"{W}tc")) for r in e.iter(f"{W}tr")))
    return Parsed("docx", [s for x in sections if (s := "\n".join(x).strip())] + tables, meta=_core_properties(z))


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def parse_pptx(content: bytes) -> Parsed:
    """A page for each slide; notes aren't read."""
    z = zipfile.ZipFile(io.BytesIO(content))
    slides = [ET.fromstring(z.read(n)) for n in _numbered(z, r"ppt/slides/slide(\d+)\.xml")]
    return Parsed("pptx", ["\n".join(p for x in s.iter(f"{A}p") if (p := "".join(t.text or "" for t in x.iter(f"{A}t"))).strip()) for s in slides], meta=_core_properties(z))


def parse_xlsx(content: bytes) -> list[Parsed]:
    """A document for each sheet: cells between tabs, blank rows left out, the others with their numbers."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S}si")]
    names = [s.get("name") or "" for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet")]
    out = []
    for k, path in enumerate(_numbered(z, r"xl/worksheets/sheet(\d+)\.xml")):
        pages, rows = [], []
        for number, row in enumerate(ET.fromstring(z.read(path)).iter(f"{S}row"), 1):
            cells: dict[int, str] = {}
            for c in row.iter(f"{S}c"):
                at = 0
                for ch in re.match(r"[A-Z]*", c.get("r") or "")[0]:
                    at = at * 26 + ord(ch) - 64
                value = c.findtext(f"{S}v") or "".join(t.text or "" for t in c.iter(f"{S}t"))
                cells[at or len(cells) + 1] = shared[int(value)] if c.get("t") == "s" and value else value
            line = "\t".join(cells.get(i, "") for i in range(1, max(cells, default=0) + 1))
            if line.strip():
                pages.append(line)
                rows.append(int(row.get("r") or number))
        out.append(Parsed("xlsx", pages, rows, {"sheet_name": names[k] if k < len(names) else f"Sheet{k + 1}", **_core_properties(z)}))
    return out


def parse_pdf(content: bytes) -> Parsed:
    """A page for each page, empty ones included."""
    pages, meta = read_pdf(content)
    return Parsed("pdf", pages, meta=meta)


def parse_msg(content: bytes) -> Parsed:
    """As parse_eml; the plain body before the HTML one."""
    body, f, attached = read_msg(content, decode_text, html_text)
    address, name = ([x[k] for x in f["recipients"] + f["cc"]] for k in (0, 1))
    n = len(f["recipients"])
    meta = {
        "recipients": "\n".join(address[:n]), "recipient_names": "\n".join(name[:n]), "cc": "\n".join(address[n:]), "cc_names": "\n".join(name[n:]),
        "references": "\n".join(f["references"]), "participants": "\n".join(merge_names([f["sender"]], address)),
    }
    return Parsed("msg", [body.strip()], meta={k: f[k] for k in ("subject", "sender", "sender_name", "date", "message_id", "in_reply_to")} | meta, attachments=attached)


def parse_xls(content: bytes) -> list[Parsed]:
    """As parse_xlsx."""
    return [Parsed("xls", lines, numbers, {"sheet_name": name}) for name, lines, numbers in read_xls(content)]


PARSERS: dict[str, Callable[[bytes], Parsed | list[Parsed]]] = {
    "eml": parse_eml, "docx": parse_docx, "pptx": parse_pptx, "xlsx": parse_xlsx, "pdf": parse_pdf, "msg": parse_msg, "xls": parse_xls,
    "html": lambda b: Parsed("html", [html_text(b)]), "htm": lambda b: Parsed("html", [html_text(b)]), "txt": lambda b: Parsed("txt", [decode_text(b)]),
}


def register_parser(extension: str, parser: Callable[[bytes], Parsed | list[Parsed]]) -> None:
    PARSERS[extension.lower().lstrip(".")] = parser


def parse_bytes(content: bytes, extension: str) -> list[Parsed]:
    """By the name's extension if there is a parser for it, else by what the bytes are."""
    kind = extension.lower().lstrip(".")
    if kind not in PARSERS:
        kind = detect_format(content) or kind
    if kind not in PARSERS:
        raise ValueError(f"no parser for {kind or 'this format'}")
    found = PARSERS[kind](content)
    return found if isinstance(found, list) else [found]


DOCUMENTS = (
    "path string, doc_no int, file_type string, pages array<string>, rows array<int>, meta map<string,string>,"
    " attachments array<struct<filename:string,content:binary,size:bigint>>, error string"
)


def discover(spark: SparkSession, roots: list[str], extensions: list[str] | None = None) -> DataFrame:
    """path, length, modificationTime and content of the files below the roots, each once."""
    wanted = "*.{" + ",".join(e for x in extensions or SUPPORTED for e in (x, x.upper())) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", wanted)
    every = None
    for root in roots:
        one = found.load(root)
        every = one if every is None else every.unionByName(one)
    return every.dropDuplicates(["path"]) if len(roots) > 1 else every


def relative_path(path: Column, roots: list[str]) -> Column:
    """The last three folders of the root and what follows; of roots that fit, the longest."""
    out = path
    for root in sorted(roots, key=len):
        tail = "/".join(root.rstrip("/").split("/")[-3:])
        cut = F.concat(F.lit(tail + "/"), F.substring(path, len(root.rstrip("/")) + 2, F.length(path)))
        out = F.when(path.startswith(root.rstrip("/") + "/"), cut).otherwise(out)
    return out


def fingerprint() -> Column:
    return F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", F.sha2("content", 256))


def parse_files(files: DataFrame) -> DataFrame:
    """files: path, content. A row per document (sheets of a workbook are documents); errors are rows, too."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    for n, d in enumerate(parse_bytes(bytes(content or b""), path.rpartition(".")[2])):
                        attached = [{"filename": f, "content": c, "size": len(c)} for f, c in d.attachments]
                        rows.append((path, n, d.file_type, d.pages, d.rows, d.meta, attached, None))
                except Exception as e:  # a broken file is a result, not a failure of the job
                    rows.append((path, 0, None, [], [], {}, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "doc_no", "file_type", "pages", "rows", "meta", "attachments", "error"])

    return files.select("path", "content").mapInPandas(run, DOCUMENTS)


def attachment_rows(documents: DataFrame) -> DataFrame:
    """path, ordinal, filename, content, status (ok, excluded, empty, unsupported): every attachment, whatever becomes of it."""
    each = documents.select("path", F.posexplode("attachments").alias("ordinal", "a"))
    ext = F.lower(F.regexp_extract("a.filename", r"\.([^.]+)$", 1))
    status = (
        F.when(ext.isin(EXCLUDED), "excluded").when(F.col("a.size") == 0, "empty").when(~ext.isin(SUPPORTED), "unsupported").otherwise("ok")
    )
    return each.select("path", "ordinal", "a.filename", "a.content", status.alias("status"))

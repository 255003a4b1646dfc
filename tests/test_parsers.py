"""PDF, compound files (messages, old workbooks) and pictures of pages, from files made here."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from gleanwork.plans import index as I
from gleanwork.sources import files, ocr
from gleanwork.sources.ole import SIGNATURE, Compound
from gleanwork.sources.pdf import headings, iso_date, read_pdf, sparse_images, values


# ---- PDF ----
def pdf(objects: dict[int, bytes], trailer: bytes = b"<< /Root 1 0 R /Info 9 0 R >>") -> bytes:
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items()) + b"trailer\n" + trailer + b"\nstartxref\n0\n%%EOF"


def stream(body: bytes, head: bytes = b"", packed: bool = True) -> bytes:
    body = zlib.compress(body) if packed else body
    return b"<< %s /Length %d%s >>\nstream\n%s\nendstream" % (head, len(body), b" /Filter /FlateDecode" if packed else b"", body)


PAGES = {
    1: b"<< /Type /Catalog /Pages 2 0 R >>",
    2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /Font << /F1 5 0 R /F2 6 0 R >> /XObject << /Im 12 0 R >> >> >>",
    3: b"<< /Type /Page /Parent 2 0 R /Contents [7 0 R 8 0 R] >>",
    4: b"<< /Type /Page /Parent 2 0 R /Contents 10 0 R >>",
    5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Times-Bold /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /eacute /quotedblleft] >> >>",
    6: b"<< /Type /Font /Subtype /Type0 /BaseFont /X /DescendantFonts [<< /DW 1000 >>] /ToUnicode 11 0 R >>",
    7: stream(b"BT /F1 24 Tf 72 700 Td (Caf\\001 \\(draft\\)) Tj ET"),
    8: stream(b"BT /F1 10 Tf 72 650 Td [(The harbour) -600 (proj) 20 (ect has many)] TJ 0 -14 Td (cranes and ships in its yards, all of them old) Tj /F2 10 Tf 0 -14 Td <00010002> Tj ET"),
    9: b"<< /Author (Kim) /Title <FEFFD55CAE00> /CreationDate (D:20240301120000+09'00') >>",
    10: stream(b"q 10 0 0 10 0 0 cm /Im Do Q BI /W 1 /H 1 ID \x00(( EI", packed=False),
    11: stream(b"1 beginbfchar <0001> <D55C> endbfchar 1 beginbfrange <0002> <0003> <AE00> endbfrange"),
    12: stream(b"\x00\x40\x80\xff", b"/Subtype /Image /Width 2 /Height 2 /ColorSpace /DeviceGray /BitsPerComponent 8"),
}


def test_pdf_pages():
    pages, meta = read_pdf(pdf(PAGES))
    assert pages == ["Café (draft)\nThe harbour project has many\ncranes and ships in its yards, all of them old\n한글", ""]
    assert (meta["author"], meta["title"], meta["created_date"], meta["page_count"], meta["sparse_pages"], meta["scan_pdf"]) == ("Kim", "한글", "2024-03-01T12:00:00", "2", "1", "true")
    assert [(s["title"], s["page"], s["offset"]) for s in json.loads(meta["sections"])] == [("Café (draft)", 0, 0)]


def test_pdf_object_streams_and_later_definitions():
    inner = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>"]
    body = b"1 0 2 %d " % (len(inner[0]) + 1)
    packed = stream(body + b" ".join(inner), b"/Type /ObjStm /N 2 /First %d" % len(body))
    others = {k: PAGES[k] for k in (3, 5, 7, 8)}
    page = b"<< /Type /Page /Contents 7 0 R /Resources << /Font << /F1 5 0 R >> >> >>"
    content = pdf(others | {20: packed}) + pdf({3: page})
    assert read_pdf(content)[0] == ["Café (draft)"]


def test_pdf_broken():
    assert read_pdf(pdf(PAGES, b"<< /Root 1 0 R /Encrypt << /V 1 >> >>"))[0] == []
    assert read_pdf(pdf(PAGES, b"<< /Root 1 0 R /Encrypt << /V 1 >> >>"))[1]["is_encrypted"] == "true"
    with pytest.raises(ValueError):
        read_pdf(b"%PDF-1.4 nothing")
    pages, meta = read_pdf(pdf(PAGES | {8: b"<< /Filter /FlateDecode /Length 4 >>\nstream\nabcd\nendstream"}))
    assert pages == ["", ""] and meta["page_failures"] == "1"
    for cut in range(0, len(pdf(PAGES)), 97):  # whatever is cut off, it ends
        try:
            read_pdf(pdf(PAGES)[:cut])
        except ValueError:
            pass
    loop = PAGES | {2: b"<< /Type /Pages /Kids [2 0 R 3 0 R] >>", 3: PAGES[3].replace(b"/Parent", b"/Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> /Parent")}
    assert len(read_pdf(pdf(loop))[0]) == 1


def test_pdf_values():
    found = [v for v, _ in values(rb"<< /A#20B [1 -2.5 (a\)\101) <4 1>] /C 3 0 R >> true null Tj % said")]
    assert found == [{"A B": [1, -2.5, b"a)A", b"A"], "C": (3, 0)}, True, None, "Tj"]
    assert list(values(b"[ (open")) == [] and list(values(b"] >> 1")) == [(1, 6)]
    assert iso_date("D:2024") == "D:2024" and iso_date("D:20240102") == "2024-01-02T00:00:00" and iso_date("soon") == "soon"


def test_headings():
    lines = [(0, "A title", 20.0, False), (0, "bold", 12.0, True), (1, "plain", 12.0, False)] + [(1, "text", 10.0, False)] * 5
    assert [(h["title"], h["offset"]) for h in headings(lines)] == [("A title", 0), ("bold", 8)] and headings([]) == []


def test_ocr(spark):
    content = pdf(PAGES)
    ((page, image),) = sparse_images(content)
    assert page == 1 and image.startswith(b"\x89PNG") and zlib.decompress(image[41 : image.index(b"IEND") - 8]) == b"\0\x00\x40\0\x80\xff"
    rows = spark.createDataFrame([("a.pdf", bytearray(content)), ("b.pdf", bytearray(content)), ("c.txt", bytearray(b"text"))], "path string, content binary")
    images = ocr.page_images(rows)
    assert images.count() == 2
    ocr.register_ocr("tesseract", lambda b: f" read {len(b)} bytes ")
    assert ocr.ocr_engine("paddle") is ocr.ocr_engine("auto") is ocr.ENGINES["tesseract"]
    cache = spark.createDataFrame([], "image_hash string, text string")
    new = ocr.read_images(images, cache, ocr.ocr_engine())
    assert new.count() == 1 and ocr.read_images(images, new, ocr.ocr_engine()).isEmpty()
    documents = files.parse_files(rows)
    done = {r["path"]: r for r in ocr.with_ocr(documents, images, new).collect()}
    assert done["a.pdf"]["pages"][1] == f"read {len(image)} bytes" and done["a.pdf"]["pages"][0].startswith("Café")
    assert (done["a.pdf"]["meta"]["is_ocr"], done["a.pdf"]["meta"]["ocr_pages"]) == ("true", "1") and "scan_pdf" not in done["a.pdf"]["meta"]
    assert done["c.txt"]["pages"] == ["text"] and sorted(done["c.txt"]["meta"]) == []
    plain = {r["path"]: r for r in ocr.with_ocr(documents, images, cache).collect()}
    assert plain["a.pdf"]["pages"][1] == "" and plain["a.pdf"]["meta"]["is_ocr"] == "false"
    del ocr.ENGINES["tesseract"]
    assert ocr.ocr_engine() is None


# ---- compound files ----
def compound(tree: dict) -> bytes:
    """A compound file of 512-byte sectors; small streams go to the mini stream. tree: names to bytes or trees."""
    entries = [["Root Entry", 5, 0xFFFFFFFF, 0, b""]]
    right: dict[int, int] = {}

    def add(children: dict) -> int:
        first = before = 0xFFFFFFFF
        for name, inside in children.items():
            n = len(entries)
            entries.append([name, 2 if isinstance(inside, bytes) else 1, 0xFFFFFFFF, 0, inside if isinstance(inside, bytes) else b""])
            if before == 0xFFFFFFFF:
                first = n
            else:
                right[before] = n
            before = n
            if isinstance(inside, dict):
                entries[n][2] = add(inside)
        return first

    entries[0][2] = add(tree)
    sectors: list[bytes] = []
    chain: list[int] = []

    def put(data: bytes) -> int:
        start, n = len(sectors), max(1, -(-len(data) // 512))
        for k in range(n):
            sectors.append(data[512 * k : 512 * k + 512].ljust(512, b"\0"))
            chain.append(start + k + 1 if k + 1 < n else 0xFFFFFFFE)
        return start

    mini, mini_chain = b"", []
    for e in entries[1:]:
        if e[1] == 2 and len(e[4]) >= 4096:
            e[3] = put(e[4])
        elif e[1] == 2:
            n = max(1, -(-len(e[4]) // 64))
            e[3] = len(mini_chain)
            mini_chain += [*range(e[3] + 1, e[3] + n), 0xFFFFFFFE]
            mini += e[4].ljust(64 * n, b"\0")
    entries[0][3], entries[0][4] = put(mini), mini
    table = put(struct.pack(f"<{len(mini_chain)}I", *mini_chain).ljust(-(-max(1, len(mini_chain)) // 128) * 512, b"\xff"))
    rows = b""
    for n, (name, kind, child, start, content) in enumerate(entries):
        raw = name.encode("utf-16-le")
        rows += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, 0xFFFFFFFF, right.get(n, 0xFFFFFFFF), child) + bytes(36) + struct.pack("<III", start, len(content), 0)
    directory = put(rows)
    n_fat = 1
    while n_fat * 128 < len(sectors) + n_fat:
        n_fat += 1
    at = len(sectors)
    fat = chain + [0xFFFFFFFD] * n_fat
    fat += [0xFFFFFFFF] * (n_fat * 128 - len(fat))
    sectors += [struct.pack("<128I", *fat[128 * k : 128 * k + 128]) for k in range(n_fat)]
    head = SIGNATURE + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<II", 0, n_fat)
    head += struct.pack("<IIIIIII", directory, 0, 4096, table, -(-max(1, len(mini_chain)) // 128), 0xFFFFFFFE, 0)
    head += struct.pack("<109I", *range(at, at + n_fat), *[0xFFFFFFFF] * (109 - n_fat))
    return head + b"".join(sectors)


def test_compound():
    tree = {"a": b"small", "b": {"c": b"x" * 9000, "d": b""}, "e": bytes(range(256)) * 3}
    file = Compound(compound(tree))
    assert file.streams == {("a",): b"small", ("b", "c"): b"x" * 9000, ("b", "d"): b"", ("e",): bytes(range(256)) * 3} and file.storages == [("b",)]
    with pytest.raises(ValueError):
        Compound(b"\xd0\xcf\x11\xe0")
    whole = compound(tree)
    for cut in range(512, len(whole), 700):
        try:
            Compound(whole[:cut])
        except (ValueError, struct.error):
            pass


def u(t: str) -> bytes:
    return t.encode("utf-16-le")


def prop(n: int, kind: int, value: bytes) -> bytes:
    return struct.pack("<HHI", kind, n, 6) + value.ljust(8, b"\0")


MSG = {
    "__substg1.0_0037001F": u("Budget 예산"), "__substg1.0_1000001F": u("The budget of the harbour"), "__substg1.0_0C1A001F": u("Kim"), "__substg1.0_0C1F001E": b"k@x.com",
    "__substg1.0_1035001F": u("<m@x>"), "__substg1.0_1039001F": u("<r1@x> <r2@x>"), "__substg1.0_0E03001F": u("Lee; Cho"),
    "__properties_version1.0": bytes(32) + prop(0x0039, 0x40, struct.pack("<Q", 133485408000000000)),
    "__recip_version1.0_#00000000": {"__substg1.0_3001001F": u("Ann"), "__substg1.0_39FE001F": u("a@x.com"), "__properties_version1.0": bytes(8) + prop(0x0C15, 3, struct.pack("<i", 1))},
    "__attach_version1.0_#00000000": {"__substg1.0_3707001F": u("notes.txt"), "__substg1.0_37010102": b"notes on lighthouse repairs", "__properties_version1.0": bytes(8)},
    "__attach_version1.0_#00000001": {"__substg1.0_3704001F": u("inner.msg"), "__substg1.0_3701000D": {"__substg1.0_0037001F": u("inside")}, "__properties_version1.0": bytes(8)},
}


def test_msg():
    content = compound(MSG)
    assert files.detect_format(content) == "msg"
    d = files.parse_msg(content)
    assert d.pages == ["The budget of the harbour"] and d.attachments == [("notes.txt", b"notes on lighthouse repairs"), ("inner.msg", b"")]
    m = d.meta
    assert (m["subject"], m["sender"], m["sender_name"], m["date"], m["message_id"]) == ("Budget 예산", "k@x.com", "Kim", "2024-01-01T00:00:00+00:00", "m@x")
    assert (m["recipients"], m["recipient_names"], m["cc"], m["references"], m["participants"]) == ("a@x.com", "Ann", "Lee\nCho", "r1@x\nr2@x", "k@x.com\na@x.com\nLee\nCho")
    html = {k: v for k, v in MSG.items() if "1000001F" not in k} | {"__substg1.0_10130102": b"<p>Some <b>HTML</b></p>"}
    assert files.parse_msg(compound(html)).pages == ["Some HTML"]
    assert files.parse_msg(compound({"__properties_version1.0": bytes(32)})).pages == [""]


def record(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def workbook() -> bytes:
    text = lambda t: struct.pack("<HB", len(t), 1) + u(t)
    shared = struct.pack("<II", 3, 3) + struct.pack("<HB", 4, 0) + b"name" + struct.pack("<HB", 6, 0) + b"har"  # goes on in wide characters
    xf = lambda f: record(0xE0, struct.pack("<HH", 0, f) + bytes(16))
    sheet = record(0x809, bytes(16))
    sheet += record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + record(0xFD, struct.pack("<HHHI", 0, 1, 0, 1))
    sheet += record(0x203, struct.pack("<HHHd", 2, 0, 0, 42.0)) + record(0x203, struct.pack("<HHHd", 2, 1, 1, 45292.5)) + record(0x27E, struct.pack("<HHHI", 2, 2, 0, (1234 << 2) | 3))
    sheet += record(0xBD, struct.pack("<HHHIHIH", 3, 1, 0, (7 << 2) | 2, 2, (45292 << 2) | 2, 2)) + record(0x205, struct.pack("<HHHBB", 3, 4, 0, 1, 0))
    sheet += record(0x06, struct.pack("<HHH", 4, 0, 0) + b"\0" * 6 + b"\xff\xff" + bytes(8)) + record(0x207, text("sum")) + record(0xFD, struct.pack("<HHHI", 6, 0, 0, 2))
    sheet += record(0x0A, b"")
    head = lambda at: (
        record(0x809, bytes(16)) + xf(0) + xf(14) + xf(170) + record(0x41E, struct.pack("<H", 170) + text('yyyy"년"')) + record(0x85, struct.pack("<IBBBB", at, 0, 0, 5, 0) + b"Sheet")
        + record(0xFC, shared) + record(0x3C, b"\x01" + u("bor") + struct.pack("<HB", 1, 0) + b" ") + record(0x0A, b"")
    )
    return head(len(head(0))) + sheet


def test_xls():
    content = compound({"Workbook": workbook().ljust(5000, b"\0")})
    assert files.detect_format(content) == "xls"
    (d,) = files.parse_xls(content)
    assert d.meta == {"sheet_name": "Sheet"} and d.rows == [1, 3, 4, 5]
    assert d.pages == ["name\tharbor", "42\t2024-01-01 12:00:00\t12.34", "\t7\t2024-01-01 00:00:00\t\tTrue", "sum"]
    with pytest.raises(ValueError):
        files.parse_xls(compound({"Book": b""}))
    with pytest.raises(ValueError):
        files.parse_xls(compound({"Workbook": record(0x809, bytes(16)) + record(0x2F, b"")}))


def test_units_of_new_formats(spark, tmp_path):
    for name, content in {"a.pdf": pdf(PAGES), "b.xls": compound({"Workbook": workbook()}), "c.msg": compound(MSG), "d.pdf": b"%PDF-1"}.items():
        (tmp_path / name).write_bytes(content)
    documents = files.parse_files(files.discover(spark, [f"file://{tmp_path}"]))
    assert {r["path"][-5:]: r["error"] is None for r in documents.collect()} == {"a.pdf": True, "b.xls": True, "c.msg": True, "d.pdf": False}
    (mail,) = I.mail_units(documents).collect()
    assert mail["subject"] == "Budget 예산" and mail["recipients"] == ["a@x.com"] and mail["attachment_filenames"] == ["notes.txt", "inner.msg"]
    pages = I.page_units(documents).filter(F.col("unit_type") == "document").collect()
    assert sorted((r["file_type"], r["position"]) for r in pages) == [("pdf", "p.1/2"), ("xls", "Sheet!3-5")]

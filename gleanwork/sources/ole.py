"""Compound files and what is kept in them: messages (MSG) and old workbooks (XLS, from BIFF8 on)."""

from __future__ import annotations

import re
import struct
from datetime import datetime, timedelta

# ---- fixed values ----
SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
LAST_SECTOR = 0xFFFFFFFA  # sector numbers from here on are marks
DATE_FORMATS = [*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)]
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
# ---- end of fixed values ----


class Compound:
    """streams: content by path, a tuple of names."""

    def __init__(self, data: bytes):
        if not data.startswith(SIGNATURE) or len(data) < 512:
            raise ValueError("not a compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini_shift > shift:
            raise ValueError("a compound file of other sectors")
        self.size, self.mini = 1 << shift, 1 << mini_shift
        directory, _, cutoff, mini_table, _, more, _ = struct.unpack_from("<IIIIIII", data, 48)
        tables = list(struct.unpack_from("<109I", data, 76))
        seen = set()
        while more < LAST_SECTOR and more not in seen:
            seen.add(more)
            *numbers, more = struct.unpack(f"<{self.size // 4}I", self._sector(more))
            tables += numbers
        self.next = [n for t in tables if t < LAST_SECTOR for n in struct.unpack(f"<{self.size // 4}I", self._sector(t))]
        mini = self._chain(mini_table)
        mini_next = struct.unpack(f"<{len(mini) // 4}I", mini)
        entries = self._chain(directory)
        root = struct.unpack_from("<I", entries, 116)[0]
        small = self._chain(root)
        self.streams: dict[tuple[str, ...], bytes] = {}
        self.storages: list[tuple[str, ...]] = []
        todo, seen = [(struct.unpack_from("<I", entries, 76)[0], ())], set()
        while todo:
            n, above = todo.pop()
            if n in seen or (n + 1) * 128 > len(entries):
                continue
            seen.add(n)
            e = entries[n * 128 : n * 128 + 128]
            length, kind = struct.unpack_from("<HB", e, 64)
            left, right, child = struct.unpack_from("<III", e, 68)
            start, size = struct.unpack_from("<II", e, 116)
            path = (*above, e[: max(0, min(length, 64) - 2)].decode("utf-16-le", "replace"))
            todo += [(left, above), (right, above)]
            if kind == 1:
                self.storages.append(path)
                todo.append((child, path))
            elif kind == 2 and size >= cutoff:
                self.streams[path] = self._chain(start)[:size]
            elif kind == 2:
                self.streams[path] = b"".join(small[k * self.mini : (k + 1) * self.mini] for k in self._follow(start, mini_next))[:size]

    def _sector(self, n: int) -> bytes:
        return self.data[(n + 1) * self.size : (n + 2) * self.size].ljust(self.size, b"\0")

    @staticmethod
    def _follow(n: int, table) -> list[int]:
        out: list[int] = []
        while n < len(table) and len(out) <= len(table):
            out.append(n)
            n = table[n]
        if len(out) > len(table):
            raise ValueError("a chain of sectors without an end")
        return out

    def _chain(self, start: int) -> bytes:
        return b"".join(map(self._sector, self._follow(start, self.next)))


# ---- messages ----
class Properties:
    """The properties of one storage of a message, by their numbers."""

    def __init__(self, file: Compound, at: tuple[str, ...], decode):
        self.decode, self.values = decode, {}
        for path, content in file.streams.items():
            m = re.fullmatch(r"__substg1\.0_([0-9A-F]{4})([0-9A-F]{4})", path[-1]) if path[:-1] == at else None
            if m:
                self.values[int(m[1], 16)] = (int(m[2], 16), content)
        fixed = file.streams.get((*at, "__properties_version1.0"), b"")
        # What comes before the entries: more at the top than in a message inside, least elsewhere.
        for i in range(32 if not at else 8, len(fixed) - 15, 16):
            kind, number, _, value = struct.unpack_from("<HHI8s", fixed, i)
            self.values.setdefault(number, (kind, value))

    def text(self, *numbers: int) -> str:
        """The first of them that isn't blank."""
        for n in numbers:
            kind, content = self.values.get(n, (0, b""))
            t = content.decode("utf-16-le", "replace") if kind == 0x1F else self.decode(content) if kind in (0x1E, 0x102) else ""
            if t.strip("\0 \t\r\n"):
                return t.rstrip("\0")
        return ""

    def number(self, n: int) -> int | None:
        kind, content = self.values.get(n, (0, b""))
        return struct.unpack_from("<i", content)[0] if kind == 3 else None

    def time(self, *numbers: int) -> str:
        for n in numbers:
            kind, content = self.values.get(n, (0, b""))
            ticks = struct.unpack_from("<Q", content)[0] if kind == 0x40 else 0
            if 0 < ticks < 2_650_467_744_000_000_000:
                return (datetime(1601, 1, 1) + timedelta(microseconds=ticks // 10)).isoformat(timespec="seconds") + "+00:00"
        return ""


def read_msg(content: bytes, decode, plain) -> tuple[str, dict, list[tuple[str, bytes]]]:
    """Text, fields and attachments. decode: bytes to text; plain: HTML to text. Of messages inside, only the name."""
    file = Compound(content)
    top = Properties(file, (), decode)
    body = top.text(0x1000)
    if not body.strip():
        body = plain(top.text(0x1013))
    people: dict[int, list[tuple[str, str]]] = {}
    inside = lambda start: sorted(s[0] for s in file.storages if len(s) == 1 and s[0].startswith(start))
    for name in inside("__recip_version1.0_#"):
        p = Properties(file, (name,), decode)
        people.setdefault(p.number(0x0C15) or 1, []).append((p.text(0x3001), p.text(0x39FE, 0x3003)))
    for kind, number in ((1, 0x0E04), (2, 0x0E03)):
        if kind not in people:
            people[kind] = [(x.strip(), "") for x in re.split(r"[;,]", top.text(number)) if x.strip()]
    both = lambda kind: [(address or name, name or address) for name, address in people[kind] if name or address]
    sender = top.text(0x5D01, 0x0C1F, 0x0C1A)
    fields = {
        "subject": top.text(0x0037), "sender": sender, "sender_name": top.text(0x0C1A) or sender, "recipients": both(1), "cc": both(2), "date": top.time(0x0039, 0x0E06),
        "message_id": top.text(0x1035).strip("<> "), "in_reply_to": top.text(0x1042).strip("<> "), "references": re.findall(r"<([^>]+)>", top.text(0x1039)),
    }
    attached = []
    for name in inside("__attach_version1.0_#"):
        p = Properties(file, (name,), decode)
        kind, data = p.values.get(0x3701, (0, b""))
        attached.append((p.text(0x3707, 0x3704, 0x3001) or "unnamed", data if kind == 0x102 else b""))
    return body, fields, attached


# ---- workbooks ----
class _Pieces:
    """Bytes of a record and of those that continue it. A text that goes on in the next begins there with its flags."""

    def __init__(self, records: list[bytes]):
        self.records, self.record, self.at = records, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n and self.record < len(self.records):
            here = self.records[self.record][self.at : self.at + n]
            out, n, self.at = out + here, n - len(here), self.at + len(here)
            if self.at >= len(self.records[self.record]) and n:
                self.record, self.at = self.record + 1, 0
        if n:
            raise ValueError("a workbook that ends within a text")
        return out

    def text(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = []
        while n:
            if self.at >= len(self.records[self.record]):
                self.record, self.at = self.record + 1, 0
                flags = self.take(1)[0]
            wide = 2 if flags & 1 else 1
            fit = min(n, (len(self.records[self.record]) - self.at) // wide)
            if not fit:
                raise ValueError("a character cut in two")
            out.append(self.take(fit * wide).decode("utf-16-le" if wide == 2 else "latin-1", "replace"))
            n -= fit
        self.take(4 * runs + extra)
        return "".join(out)


def _is_date_format(code: str) -> bool:
    return bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.|general', "", code.lower()))) and "e+" not in code.lower()


def _rk(value: int) -> float:
    number = struct.unpack("<i", struct.pack("<I", value))[0] >> 2 if value & 2 else struct.unpack("<d", struct.pack("<Q", (value & 0xFFFFFFFC) << 32))[0]
    return number / 100 if value & 1 else number


def read_xls(content: bytes) -> list[tuple[str, list[str], list[int]]]:
    """Of each sheet: name, rows that aren't blank (cells between tabs), their numbers. Dates are ISO, whole numbers have
    no point, formulas have their stored values."""
    file = Compound(content)
    book = next((file.streams[p] for p in (("Workbook",), ("WORKBOOK",)) if p in file.streams), None)
    if book is None:
        raise ValueError("no workbook of a known version")
    records, at = [], 0
    while at + 4 <= len(book):
        kind, size = struct.unpack_from("<HH", book, at)
        records.append((at, kind, book[at + 4 : at + 4 + size]))
        at += 4 + size
    sheets, shared, formats, styles, base = [], [], {}, [], datetime(1899, 12, 30)
    k = 0
    while k < len(records):
        _, kind, r = records[k]
        k += 1
        if kind == 0x2F:
            raise ValueError("an encrypted workbook")
        elif kind == 0x85:
            start, _, _, n, wide = struct.unpack_from("<IBBBB", r)
            sheets.append((start, r[8:].decode("utf-16-le" if wide & 1 else "latin-1", "replace")[:n]))
        elif kind == 0x22 and r[:2] == b"\1\0":
            base = datetime(1904, 1, 1)
        elif kind == 0x41E:
            formats[struct.unpack_from("<H", r)[0]] = _Pieces([r[2:]]).text()
        elif kind == 0xE0:
            styles.append(struct.unpack_from("<H", r, 2)[0])
        elif kind == 0xFC:
            to = k
            while to < len(records) and records[to][1] == 0x3C:
                to += 1
            pieces = _Pieces([r] + [records[i][2] for i in range(k, to)])
            _, n = struct.unpack("<II", pieces.take(8))
            shared, k = [pieces.text() for _ in range(n)], to
        elif kind == 0x0A:
            break  # the sheets follow
    dates = {f for f, code in formats.items() if _is_date_format(code)} | (set(DATE_FORMATS) - set(formats))

    def number(value: float, style: int) -> str:
        if style < len(styles) and styles[style] in dates:
            try:
                return (base + timedelta(days=round(value * 86400) / 86400)).isoformat(sep=" ", timespec="seconds")
            except OverflowError:
                return str(value)
        return str(int(value)) if float(value).is_integer() else str(value)

    place = {offset: i for i, (offset, _, _) in enumerate(records)}
    out = []
    for start, name in sheets:
        cells: dict[int, dict[int, str]] = {}
        waiting = None  # the cell of a formula whose text follows
        depth = 0
        for _, kind, r in records[place.get(start, len(records)) :]:
            if kind == 0x809:
                depth += 1
            elif kind == 0x0A:
                depth -= 1
                if depth <= 0:
                    break
            if depth != 1:
                continue  # of a chart within
            row, column, style = struct.unpack_from("<HHH", r) if len(r) >= 6 else (0, 0, 0)
            put = lambda c, t, row=row: cells.setdefault(row, {}).__setitem__(c, t)
            if kind == 0xFD:
                put(column, shared[struct.unpack_from("<I", r, 6)[0]])
            elif kind == 0x204:
                put(column, _Pieces([r[6:]]).text())
            elif kind == 0x203:
                put(column, number(struct.unpack_from("<d", r, 6)[0], style))
            elif kind == 0x27E:
                put(column, number(_rk(struct.unpack_from("<I", r, 6)[0]), style))
            elif kind == 0xBD:
                for i in range((len(r) - 6) // 6):
                    style, value = struct.unpack_from("<HI", r, 4 + 6 * i)
                    put(column + i, number(_rk(value), style))
            elif kind == 0x205:
                put(column, ERRORS.get(r[6], "") if r[7] else str(bool(r[6])))
            elif kind == 0x06:
                if r[12:14] != b"\xff\xff":
                    put(column, number(struct.unpack_from("<d", r, 6)[0], style))
                elif r[6] == 0:
                    waiting = (row, column)
                else:
                    put(column, {1: str(bool(r[8])), 2: ERRORS.get(r[8], "")}.get(r[6], ""))
            elif kind == 0x207 and waiting:
                cells.setdefault(waiting[0], {})[waiting[1]] = _Pieces([r]).text()
                waiting = None
        rows = [(n, "\t".join(c.get(i, "") for i in range(max(c) + 1)).rstrip("\t")) for n, c in sorted(cells.items())]
        rows = [(n + 1, line) for n, line in rows if line.strip()]
        out.append((name, [line for _, line in rows], [n for n, _ in rows]))
    return out

"""Text of PDF pages from their text layer; standard library only.

Objects are found by their headers (whatever the cross-reference table says) and in object streams. A page's text comes
from its content streams: shown strings, decoded by the font's ToUnicode map or else as Latin-1, with a space where
a gap between strings is wide and a line break where the line moves. Pages with little text or with images are reported
as not inspected (their pixels need OCR); encrypted files and unknown filters are refused or reported.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

#: A page with fewer characters that aren't white space counts as scanned.
MIN_TEXT_CHARS = 16
MAX_PAGES, MAX_STREAM = 500, 64 << 20
_SPACE = b"\0\t\n\x0c\r "
_DELIMITERS = b"()<>[]{}/%"


class Name(str):
    """A PDF name."""


class Operator(str):
    """A word of a content stream that is no value."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Reader:
    """Values from bytes: numbers, names, strings, arrays, dictionaries, references; everything else is an operator."""

    data: bytes
    at: int = 0

    def skip(self) -> None:
        while self.at < len(self.data):
            c = self.data[self.at]
            if c in _SPACE:
                self.at += 1
            elif c == 0x25:
                while self.at < len(self.data) and self.data[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def value(self, depth: int = 0):
        """The next value; None at the end."""
        self.skip()
        d, a = self.data, self.at
        if a >= len(d) or depth > 60:
            self.at = len(d)
            return None
        c = d[a : a + 1]
        if c == b"/":
            self.at = a + 1
            return Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), self._word().decode("latin-1")))
        if c == b"(":
            return self._string()
        if d[a : a + 2] == b"<<":
            self.at, out = a + 2, {}
            while True:
                self.skip()
                if self.data[self.at : self.at + 2] == b">>" or self.at >= len(d):
                    self.at += 2
                    return out
                key, got = self.value(depth + 1), self.value(depth + 1)
                if isinstance(key, str):
                    out[str(key)] = got
        if c == b"<":
            end = d.find(b">", a)
            end = len(d) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[a + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at, out = a + 1, []
            while True:
                self.skip()
                if self.at >= len(d) or d[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return out
                out.append(self.value(depth + 1))
        if c in (b")", b"]", b"{", b"}", b">"):
            self.at = a + 1
            return Operator(c.decode())
        word = self._word()
        if re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", word):
            if m := re.compile(rb"\s+\d+\s+R(?![A-Za-z0-9])").match(d, self.at) if word.isdigit() else None:
                self.at = m.end()
                return Ref(int(word))
            return float(word)
        return {b"true": True, b"false": False}.get(word, Operator(word.decode("latin-1")))

    def _word(self) -> bytes:
        start = self.at
        while self.at < len(self.data) and self.data[self.at] not in _SPACE and self.data[self.at] not in _DELIMITERS:
            self.at += 1
        if self.at == start:
            self.at += 1
        return self.data[start : self.at]

    def _string(self) -> bytes:
        out, level, self.at = bytearray(), 1, self.at + 1
        while self.at < len(self.data):
            c = self.data[self.at]
            self.at += 1
            if c == 0x5C and self.at < len(self.data):
                e = self.data[self.at : self.at + 1]
                if m := re.compile(rb"[0-7]{1,3}").match(self.data, self.at):
                    out.append(int(m[0], 8) & 255)
                    self.at = m.end()
                    continue
                self.at += 1
                if e == b"\r" and self.data[self.at : self.at + 1] == b"\n":
                    self.at += 1
                out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\r": b"", b"\n": b""}.get(e, e)
                continue
            level += (c == 0x28) - (c == 0x29)
            if not level:
                break
            out.append(c)
        return bytes(out)


@dataclass
class Document:
    objects: dict[int, object] = field(default_factory=dict)
    streams: dict[int, bytes] = field(default_factory=dict)

    def get(self, value):
        for _ in range(20):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value.number)
        return None

    def decoded(self, number: int) -> bytes:
        """A stream's bytes; filters other than Flate and ASCII are not decoded."""
        head, data = self.objects.get(number), self.streams.get(number, b"")
        filters = self.get(head.get("Filter")) if isinstance(head, dict) else None
        for f in filters if isinstance(filters, list) else [filters] if filters else []:
            f = self.get(f)
            if f in ("FlateDecode", "Fl"):
                data = zlib.decompressobj().decompress(data, MAX_STREAM)
                parms = self.get(head.get("DecodeParms")) or {}
                parms = self.get(parms[0]) if isinstance(parms, list) and parms else parms
                if isinstance(parms, dict) and (parms.get("Predictor") or 1) >= 10:
                    data = _unpredicted(data, int(parms.get("Columns") or 1) * int(parms.get("Colors") or 1))
            elif f in ("ASCIIHexDecode", "AHx"):
                data = Reader(b"<" + data + b">").value()
            else:
                raise ValueError(f"filter {f}")
        return data


def _unpredicted(data: bytes, width: int) -> bytes:
    """PNG predictors of one byte a sample."""
    out, before = bytearray(), bytes(width)
    for k in range(0, len(data), width + 1):
        kind, row = data[k], bytearray(data[k + 1 : k + 1 + width])
        for i in range(len(row)):
            left, up, corner = row[i - 1] if i else 0, before[i], before[i - 1] if i else 0
            paeth = min((left, up, corner), key=lambda x: abs(left + up - corner - x))
            row[i] = (row[i] + (0, left, up, (left + up) // 2, paeth)[kind if kind < 5 else 0]) & 255
        out += row
        before = bytes(row).ljust(width, b"\0")
    return bytes(out)


def read_pdf(content: bytes) -> Document:
    doc = Document()
    if b"/Encrypt" in content:
        raise ValueError("encrypted")
    for m in re.finditer(rb"(?<![0-9])(\d{1,10})\s+\d{1,5}\s+obj(?![A-Za-z])", content):
        reader, number = Reader(content, m.end()), int(m[1])
        doc.objects[number] = reader.value()
        reader.skip()
        if content[reader.at : reader.at + 6] == b"stream":
            start = reader.at + 6
            start += 2 if content[start : start + 2] == b"\r\n" else 1
            head = doc.objects[number]
            size = head.get("Length") if isinstance(head, dict) else None
            end = start + int(size) if isinstance(size, float) else -1
            if end < 0 or not content[end : end + 20].lstrip().startswith(b"endstream"):
                end = content.find(b"endstream", start)
                end = len(content) if end < 0 else end
            doc.streams[number] = content[start:end]
    for number in list(doc.streams):
        head = doc.objects.get(number)
        if isinstance(head, dict) and head.get("Type") == "ObjStm":
            data = doc.decoded(number)
            first, reader = int(head.get("First") or 0), Reader(data)
            table = [reader.value() for _ in range(2 * int(head.get("N") or 0))]
            for k, at in zip(table[::2], table[1::2], strict=False):
                if isinstance(k, float) and isinstance(at, float):
                    doc.objects.setdefault(int(k), Reader(data, first + int(at)).value())
    return doc


def pages_of(doc: Document) -> list[dict]:
    """Pages in order, with what they inherit."""
    out: list[dict] = []

    def walk(node, inherited: dict, seen: frozenset) -> None:
        if not isinstance(node, dict) or id(node) in seen or len(out) > MAX_PAGES:
            return
        own = {**inherited, **{k: node[k] for k in ("Resources",) if k in node}}
        if node.get("Type") == "Page" or ("Kids" not in node and "Contents" in node):
            out.append({**own, **node})
        for kid in doc.get(node.get("Kids")) or []:
            walk(doc.get(kid), own, seen | {id(node)})

    root = next((o for o in doc.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), {})
    walk(doc.get(root.get("Pages")), {}, frozenset())
    return out or [o for o in doc.objects.values() if isinstance(o, dict) and o.get("Type") == "Page"]


def unicode_map(data: bytes) -> tuple[dict[bytes, str], int]:
    """A ToUnicode map, and the bytes of a code."""
    out, width, reader, stack = {}, 1, Reader(data), []
    text = lambda b: b.decode("utf-16-be", "replace")
    while (v := reader.value()) is not None:
        if not isinstance(v, Operator):
            stack.append(v)
            continue
        if v == "endcodespacerange" and stack and isinstance(stack[-1], bytes):
            width = max(1, len(stack[-1]))
        elif v == "endbfchar":
            out |= {a: text(b) for a, b in zip(stack[::2], stack[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
        elif v == "endbfrange":
            for a, b, to in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                if not isinstance(a, bytes) or not isinstance(b, bytes):
                    continue
                for k in range(min(int.from_bytes(b, "big") - int.from_bytes(a, "big") + 1, 65536)):
                    code = (int.from_bytes(a, "big") + k).to_bytes(len(a), "big")
                    if isinstance(to, list):
                        out |= {code: text(to[k])} if k < len(to) and isinstance(to[k], bytes) else {}
                    elif isinstance(to, bytes) and to:
                        last = int.from_bytes(to[-2:], "big") + k
                        out[code] = text(to[:-2] + (last & 0xFFFF).to_bytes(min(len(to), 2), "big"))
        stack = []
    return out, width


def fonts_of(doc: Document, resources) -> dict[str, tuple[dict[bytes, str], int]]:
    out = {}
    fonts = doc.get((doc.get(resources) or {}).get("Font")) or {}
    for name, ref in fonts.items() if isinstance(fonts, dict) else ():
        font = doc.get(ref)
        to = font.get("ToUnicode") if isinstance(font, dict) else None
        if isinstance(to, Ref) and to.number in doc.streams:
            out[name] = unicode_map(doc.decoded(to.number))
    return out


def shown(font: tuple[dict[bytes, str], int] | None, code: bytes) -> str:
    if font is None:
        return code.decode("cp1252", "replace")
    table, width = font
    return "".join(table.get(code[k : k + width], "") for k in range(0, len(code), width))


def content_text(data: bytes, fonts: dict) -> str:
    """Text of a content stream in the order in which it is shown."""
    out, stack, font, size, line, reader = [], [], None, 1.0, None, Reader(data)

    def add(code) -> None:
        if isinstance(code, bytes):
            out.append(shown(font, code))

    def move(y: float | None, x: float = 0.0) -> None:
        if y:
            out.append("\n")
        elif x:
            out.append(" ")

    while (v := reader.value()) is not None:
        if not isinstance(v, Operator):
            stack.append(v)
            continue
        numbers = [x for x in stack if isinstance(x, float)]
        if v == "Tf" and stack:
            font = fonts.get(next((str(x) for x in stack if isinstance(x, Name)), ""))
            size = abs(numbers[-1]) or 1.0 if numbers else size
        elif v == "Tj" and stack:
            add(stack[-1])
        elif v == "TJ" and stack and isinstance(stack[-1], list):
            for x in stack[-1]:
                if isinstance(x, float):
                    out.append(" " if x < -200 else "")
                add(x)
        elif v in ("'", '"') and stack:
            out.append("\n")
            add(stack[-1])
        elif v in ("Td", "TD") and len(numbers) >= 2:
            move(numbers[-1], numbers[-2])
        elif v == "T*":
            out.append("\n")
        elif v == "Tm" and len(numbers) >= 6:
            move(line is not None and abs(numbers[-1] - line) > 0.1, 1.0)
            line = numbers[-1]
        elif v == "BI":  # an inline image: its bytes are no operators
            end = re.compile(rb"\sEI(?=\s|\Z)").search(data, reader.at)
            reader.at = end.end() if end else len(data)
        elif v == "ET":
            out.append("\n")
        stack = []
    text = "".join(out)
    return re.sub(r"\n{2,}", "\n", re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r" {2,}", " ", text))).strip()


def pdf_pages(content: bytes) -> tuple[list[str], list[str]]:
    """(a text for each page, warnings): PDF_SCANNED_PAGE where a page has little text or shows images."""
    doc = read_pdf(content)
    pages, texts, warnings = pages_of(doc), [], set()
    if not pages:
        raise ValueError("no pages")
    if len(pages) > MAX_PAGES:
        raise ValueError("too many pages")
    for page in pages:
        parts = doc.get(page.get("Contents")) if not (isinstance(page.get("Contents"), Ref) and page["Contents"].number in doc.streams) else page["Contents"]
        try:
            data = b"\n".join(doc.decoded(r.number) for r in (parts if isinstance(parts, list) else [parts]) if isinstance(r, Ref))
            text = content_text(data, fonts_of(doc, page.get("Resources")))
        except (ValueError, zlib.error):
            text = ""
        objects = doc.get((doc.get(page.get("Resources")) or {}).get("XObject")) or {}
        drawn = [doc.get(o) for o in objects.values()] if isinstance(objects, dict) else []
        if len(re.sub(r"\s", "", text)) < MIN_TEXT_CHARS or any(isinstance(o, dict) and o.get("Subtype") in ("Image", "Form") for o in drawn):
            warnings.add("PDF_SCANNED_PAGE")
        texts.append(text)
    return texts, sorted(warnings)

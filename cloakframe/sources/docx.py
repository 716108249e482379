"""Word documents: text of every part as segments, and writing replacements back; standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from bisect import bisect_right
from dataclasses import dataclass
from html import escape

MAX_ENTRIES, MAX_TOTAL, MAX_RATIO, RATIO_FROM = 2000, 200 << 20, 200, 1 << 20
# Text elements of the streams, attributes with text, parts by what they hold, and properties that are blanked.
STREAMS = ("w:t", "w:delText", "w:instrText", "a:t", "m:t")
ATTRIBUTES = ("w:instr", "w:tooltip", "descr", "title")
TEXT_PARTS = re.compile(r"word/(document|header[0-9]*|footer[0-9]*|footnotes|endnotes|comments(Extended|Extensible)?|glossary/document|charts/chart[0-9]*|diagrams/(data|drawing)[0-9]*)\.xml\Z")
UNREAD_PARTS = re.compile(r"word/(media/[^/]+|(embeddings|activeX)/.+|[^/]+\.(html?|mht|mhtml|rtf|txt))\Z", re.I)
AUTHORS = ("w:author", "w:initials", "w15:author", "w15:userId", "w15:providerId")
CUSTOM_PARTS = re.compile(r"customXml/item[0-9]+\.xml\Z")
PROPERTIES = ("dc:creator", "cp:lastModifiedBy", "dc:title", "dc:subject", "dc:description", "cp:keywords", "cp:category", "cp:contentStatus", "Company", "Manager", "HyperlinkBase", "Template")
_ENTITY = re.compile(r"&(?:#x([0-9A-Fa-f]+)|#([0-9]+)|(amp|lt|gt|quot|apos));")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def decode(text: str) -> str:
    return _ENTITY.sub(lambda m: chr(int(m[1], 16)) if m[1] else chr(int(m[2])) if m[2] else _NAMED[m[3]], text)


@dataclass
class Node:
    start: int  # in the part's XML
    end: int
    at: int  # in the segment's text
    text: str


@dataclass
class Segment:
    part: str
    stream: str
    text: str
    nodes: list[Node]


def read_zip(content: bytes) -> dict[str, bytes]:
    """Entries of an archive; bombs and unsafe paths are refused."""
    out: dict[str, bytes] = {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        entries = z.infolist()
        if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_TOTAL:
            raise ValueError("the archive is too large")
        for e in entries:
            if e.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", e.filename) or ":" in e.filename:
                raise ValueError("unsafe path in the archive")
            if e.file_size > RATIO_FROM and e.file_size > MAX_RATIO * max(e.compress_size, 1):
                raise ValueError("suspicious compression")
            with z.open(e) as f:
                data = f.read(e.file_size + 1)
            if len(data) != e.file_size:
                raise ValueError("an entry's size is not what it says")
            out[e.filename] = data
    return out


def check(parts: dict[str, bytes]) -> None:
    types = parts.get("[Content_Types].xml", b"").decode("utf-8", "replace")
    if "word/document.xml" not in parts or not types:
        raise ValueError("not a word document")
    if "macroEnabled" in types or "vbaProject" in types or any("vbaProject" in p for p in parts):
        raise ValueError("documents with macros are refused")
    if any(p.endswith((".xml", ".rels")) and re.search(rb"<!(DOCTYPE|ENTITY)", d[:4096], re.I) for p, d in parts.items()):
        raise ValueError("document type declarations are refused")


def part_segments(part: str, xml: str) -> list[Segment]:
    out = []
    for stream in STREAMS if TEXT_PARTS.match(part) else ():
        main = stream == "w:t"
        breaks = r"|</w:p>|<w:br(?:\s[^>]*)?/>|<w:cr(?:\s[^>]*)?/>|<w:tab(?:\s[^>]*)?/>" if main else r"|</w:p>"
        text, nodes = [], []
        size = 0
        for m in re.finditer(rf"<{stream}(?:\s[^>]*)?>([^<]*)</{stream}>{breaks}", xml):
            if m[1] is None:
                piece = "\t" if m[0].startswith("<w:tab") else "\n"
            else:
                piece = decode(m[1])
                nodes.append(Node(m.start(1), m.end(1), size, piece))
            text.append(piece)
            size += len(piece)
        if nodes:
            out.append(Segment(part, stream, "".join(text), nodes))
    for m in re.finditer(rf'\s(?:{"|".join(ATTRIBUTES)})="([^"]*)"', xml) if TEXT_PARTS.match(part) else ():
        piece = decode(m[1])
        if piece.strip():
            out.append(Segment(part, "attribute", piece, [Node(m.start(1), m.end(1), 0, piece)]))
    if CUSTOM_PARTS.match(part):
        for m in re.finditer(r">([^<>]*[^<>\s][^<>]*)<", xml):
            piece = decode(m[1])
            out.append(Segment(part, "custom", piece, [Node(m.start(1), m.end(1), 0, piece)]))
    if part.endswith(".rels"):
        for tag in re.finditer(r"<Relationship\s[^>]*>", xml):
            m = re.compile(r'\sTarget="([^"]*)"').search(xml, *tag.span())
            if m and 'TargetMode="External"' in tag[0]:
                piece = decode(m[1])
                out.append(Segment(part, "target", piece, [Node(m.start(1), m.end(1), 0, piece)]))
    return out


def unread(parts: dict[str, bytes]) -> list[str]:
    """Warnings of what a word document holds beside readable text: media and objects, and text in forms that the streams don't cover."""
    out = []
    if any(UNREAD_PARTS.match(p) for p in parts):
        out.append("EMBEDDED_MEDIA_NOT_INSPECTED")
    for p, d in parts.items():
        if TEXT_PARTS.match(p):
            xml = d.decode("utf-8", "replace")
            opened = len(re.findall(rf"<(?:{'|'.join(STREAMS)})(?=[\s>])(?![^>]*/>)", xml))
            whole = sum(len(re.findall(rf"<{s}(?:\s[^>]*)?>[^<]*</{s}>", xml)) for s in STREAMS)
            if "<![CDATA[" in xml or opened != whole:
                out.append("DOCUMENT_STRUCTURE_UNSUPPORTED")
                break
    return out


def docx_read(content: bytes) -> tuple[list[Segment], list[str]]:
    """Segments of every part, and warnings of what could not be read."""
    parts = read_zip(content)
    check(parts)
    return [s for p, d in parts.items() if p.endswith((".xml", ".rels")) for s in part_segments(p, d.decode("utf-8", "replace"))], unread(parts)


def docx_segments(content: bytes) -> list[Segment]:
    return docx_read(content)[0]


def without_metadata(name: str, data: bytes) -> bytes:
    """A part without authors and document properties."""
    if name.startswith("docProps/"):
        xml = data.decode("utf-8", "replace")
        for p in (*PROPERTIES, "vt:lpwstr"):
            xml = re.sub(rf"(<{p}(?:\s[^>]*)?>).*?(</{p}>)", r"\1\2", xml, flags=re.S)
        return xml.encode()
    if TEXT_PARTS.match(name) or name == "word/people.xml":
        for a in AUTHORS:
            data = re.sub(rf'(?<![\w:]){a}="[^"]*"'.encode(), f'{a}=""'.encode(), data)
    return data


def docx_apply(content: bytes, edits: list[tuple[int, int, int, str]]) -> bytes:
    """edits: (segment number, start, end, replacement). The replacement goes to the first node, covered text leaves later ones; metadata is blanked."""
    parts, found = read_zip(content), docx_segments(content)
    changed: dict[str, dict[tuple[int, int], str]] = {}
    by: dict[int, list[tuple[int, int, str]]] = {}
    for number, *edit in edits:
        by.setdefault(number, []).append(tuple(edit))
    for number, mine in by.items():
        segment, mine = found[number], sorted(mine)
        ends = [e for _, e, _ in mine]
        for node in segment.nodes:
            out, at, end = [], node.at, node.at + len(node.text)
            k = bisect_right(ends, node.at)  # the first edit that reaches into the node
            while k < len(mine) and mine[k][0] < end:
                s, e, new = mine[k]
                out.append(segment.text[at : max(s, at)])
                if s >= node.at:
                    out.append(new)
                at = min(max(e, at), end)
                k += 1
            out.append(segment.text[at:end])
            text = "".join(out)
            if text != node.text:
                changed.setdefault(segment.part, {})[node.start, node.end] = text
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            if name in changed:
                xml = data.decode("utf-8", "replace")
                pieces, at = [], 0
                for (s, e), text in sorted(changed[name].items()):
                    pieces += [xml[at:s], escape(text, quote=True)]
                    at = e
                data = "".join([*pieces, xml[at:]]).encode()
            data = without_metadata(name, data)
            z.writestr(name, data)
    return buffer.getvalue()

"""Extractors: bytes or text to a normalised text with blocks.

A block is a span of the text with its kind. Every extractor is a plain function over one
document, run over Arrow batches; the registry routes by media type, then by extension.
"""

from __future__ import annotations

import io
import re
import unicodedata
import zipfile
from collections.abc import Callable
from dataclasses import dataclass
from xml.etree import ElementTree

from sheafwork.errors import SheafError

#: Bytes looked at to tell an encoding, and the bounds of a package's parts.
PROBE, MOST_PART, MOST_DEPTH = 64 << 10, 256 << 20, 256
BOMS = [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]


@dataclass(frozen=True)
class Block:
    """A span of the text; ``level`` of a heading, else 0; ``page`` from 1, -1 where there are none."""

    kind: str
    start: int
    end: int
    level: int = 0
    page: int = -1


Extracted = tuple[str, list[Block], dict[str, str]]


def decode(data: bytes, strict: bool = False) -> str:
    """Text of unknown encoding: a byte order mark decides, then UTF-8 if the beginning is valid, else Latin-1 (``strict``: an error)."""
    for mark, name in BOMS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    head = data[:PROBE]
    for cut in range(4):  # the last character may be split
        try:
            head[: len(head) - cut].decode("utf-8")
            return data.decode("utf-8", "replace")
        except UnicodeDecodeError as e:
            if len(data) <= PROBE or e.start < len(head) - 4:
                break
    if strict:
        raise SheafError(6106)
    return data.decode("latin-1")


def normalize(text: str) -> str:
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    text = text.translate({0xA0: " ", 0x2007: " ", 0x202F: " "})
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def _block(kind: str, text: str, a: int, b: int, level: int = 0, page: int = -1) -> Block | None:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return Block(kind, a, b, level, page) if a < b else None


def plain_text(text: str) -> Extracted:
    """Paragraphs between blank lines."""
    text = normalize(text)
    out, at = [], 0
    for m in [*re.finditer(r"\n[^\S\n]*(?:\n[^\S\n]*)+", text), None]:
        if x := _block("Paragraph", text, at, m.start() if m else len(text)):
            out.append(x)
        at = m.end() if m else at
    return text, out, {}


_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]|$)")
_UNDER = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"( *)(?:[-*+]|\d{1,9}[.)])(?:[ \t]+|$)")
_TABLE = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r" {0,3}\[[^\]]+\]:[ \t]*\S+")
_META = re.compile(r"([A-Za-z_][\w-]*):[ \t]*(.*)$")


def markdown(text: str) -> Extracted:
    """Top-level blocks of Markdown: headings, code, quotes, a block per list item and table row; front matter is metadata."""
    text = normalize(text)
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    out: list[Block | None] = []
    meta: dict[str, str] = {}
    i, n = 0, len(lines)
    if lines[0][1].rstrip() == "---":
        end = next((k for k in range(1, n) if lines[k][1].rstrip() in ("---", "...")), None)
        if end is not None and all(not s.strip() or s[0] in " \t#-" or _META.match(s) for _, s in lines[1:end]):
            meta = {m.group(1): m.group(2).strip().strip("'\"") for _, s in lines[1:end] if (m := _META.match(s))}
            i = end + 1
    stop = lambda k: lines[k][0] + len(lines[k][1])
    while i < n:
        a, line = lines[i]
        if not line.strip():
            i += 1
            continue
        if m := _FENCE.match(line):
            k = i + 1
            while k < n and not re.match(rf" {{0,3}}{re.escape(m.group(1)[0])}{{{len(m.group(1))},}}[ \t]*$", lines[k][1]):
                k += 1
            k = min(k, n - 1)
            out.append(_block("Code", text, a, stop(k)))
            i = k + 1
        elif m := _ATX.match(line):
            out.append(_block("Heading", text, a, stop(i), len(m.group(1))))
            i += 1
        elif _BREAK.match(line):
            i += 1
        elif _DEFINITION.match(line):
            i += 1
        elif line.lstrip().startswith(">"):
            k = i
            while k + 1 < n and lines[k + 1][1].strip():
                k += 1
            out.append(_block("Quote", text, a, stop(k)))
            i = k + 1
        elif "|" in line and i + 1 < n and "|" in lines[i + 1][1] and _TABLE.match(lines[i + 1][1]):
            out.append(_block("TableRow", text, a, stop(i)))
            i += 2
            while i < n and "|" in lines[i][1] and lines[i][1].strip():
                out.append(_block("TableRow", text, lines[i][0], stop(i)))
                i += 1
        elif (m := _ITEM.match(line)) and len(m.group(1)) <= 3:
            k, start = i, i
            while k + 1 < n:
                nxt = lines[k + 1][1]
                top = (x := _ITEM.match(nxt)) and len(x.group(1)) <= 3
                if top:
                    out.append(_block("ListItem", text, lines[start][0], stop(k)))
                    start = k + 1
                elif not nxt.strip():
                    j = k + 2
                    while j < n and not lines[j][1].strip():
                        j += 1
                    if j >= n or not (lines[j][1].startswith(("  ", "\t")) or ((x := _ITEM.match(lines[j][1])) and len(x.group(1)) <= 3)):
                        break
                elif not lines[k][1].strip() and not nxt.startswith((" ", "\t")):
                    break
                k += 1
            out.append(_block("ListItem", text, lines[start][0], stop(k)))
            i = k + 1
        elif line.startswith(("    ", "\t")):
            k = i
            while k + 1 < n and (lines[k + 1][1].startswith(("    ", "\t")) or not lines[k + 1][1].strip()):
                k += 1
            out.append(_block("Code", text, a, stop(k)))
            i = k + 1
        else:
            k, level = i, 0
            while k + 1 < n and lines[k + 1][1].strip():
                nxt = lines[k + 1][1]
                if u := _UNDER.match(nxt):
                    level = 1 if u.group(1)[0] == "=" else 2
                    break
                if _FENCE.match(nxt) or _ATX.match(nxt) or nxt.lstrip().startswith(">") or re.match(r" {0,3}[-*+][ \t]+\S", nxt):
                    break
                k += 1
            out.append(_block("Heading" if level else "Paragraph", text, a, stop(k), level))
            i = k + (2 if level else 1)
    return text, [x for x in out if x], meta


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx(data: bytes) -> Extracted:
    """Body, headers, footers and notes of a word-processing package; tables as rows joined by bars, deleted text left out."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())

    def part(name: str) -> ElementTree.Element | None:
        if name not in names:
            return None
        if z.getinfo(name).file_size > MOST_PART:
            raise SheafError(6101, "a part is too large")
        return ElementTree.fromstring(z.read(name))  # noqa: S314 - no entities are resolved by it

    levels: dict[str, int] = {}
    styles = part("word/styles.xml")
    based: dict[str, str] = {}
    for s in styles.iter(f"{_W}style") if styles is not None else []:
        sid = s.get(f"{_W}styleId", "")
        lvl = s.find(f"{_W}pPr/{_W}outlineLvl")
        if lvl is not None and (lvl.get(f"{_W}val") or "").isdigit():
            levels[sid] = int(lvl.get(f"{_W}val"))
        up = s.find(f"{_W}basedOn")
        if up is not None:
            based[sid] = up.get(f"{_W}val", "")
    for sid in list(based):
        seen, k = set(), sid
        while k not in levels and k in based and k not in seen:
            seen.add(k)
            k = based[k]
        if k in levels:
            levels[sid] = levels[k]
    texts: list[str] = []
    blocks: list[tuple[str, int]] = []

    def words(p: ElementTree.Element, depth: int = 0) -> str:
        if depth > MOST_DEPTH:
            raise SheafError(6101, "elements are nested too deep")
        out = []
        for e in p:
            tag = e.tag.rpartition("}")[2]
            if tag in ("del", "moveFrom", "pPr", "rPr", "instrText", "Fallback", "txbxContent"):
                continue
            if tag == "t":
                out.append(e.text or "")
            elif tag == "tab":
                out.append("\t")
            elif tag in ("br", "cr"):
                out.append("\n")
            elif tag == "noBreakHyphen":
                out.append("-")
            else:
                out.append(words(e, depth + 1))
        return "".join(out)

    def add(kind: str, t: str, level: int = 0) -> None:
        if t.strip():
            texts.append(t.strip())
            blocks.append((kind, level))

    def paragraph(p: ElementTree.Element, kind: str | None) -> None:
        own = p.find(f"{_W}pPr/{_W}outlineLvl")
        style = p.find(f"{_W}pPr/{_W}pStyle")
        level = int(own.get(f"{_W}val", "9")) if own is not None else levels.get(style.get(f"{_W}val", ""), 9) if style is not None else 9
        if kind is None and level < 6:
            add("Heading", words(p), level + 1)
        else:
            add(kind or ("ListItem" if p.find(f"{_W}pPr/{_W}numPr") is not None else "Paragraph"), words(p))
        for box in p.iter(f"{_W}txbxContent"):
            if not any(box in list(f.iter()) for f in p.iter("{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback")):
                walk(box, kind)

    def walk(e: ElementTree.Element, kind: str | None, depth: int = 0) -> None:
        if depth > MOST_DEPTH:
            raise SheafError(6101, "elements are nested too deep")
        for x in e:
            tag = x.tag.rpartition("}")[2]
            if tag == "p":
                paragraph(x, kind)
            elif tag == "tbl":
                for row in x.iter(f"{_W}tr"):
                    cells = [" ".join(filter(None, (words(p).strip() for p in c.iter(f"{_W}p")))) for c in row.findall(f"{_W}tc")]
                    add("TableRow", " | ".join(cells) if any(cells) else "")
            elif tag in ("sdt", "sdtContent", "customXml", "body", "ins", "footnote", "endnote", "smartTag"):
                walk(x, kind, depth + 1)

    body = part("word/document.xml")
    if body is None:
        raise SheafError(6101, "no document part")
    walk(body, None)
    for name in sorted(names):
        if re.fullmatch(r"word/(?:header|footer)\d*\.xml", name) or name in ("word/footnotes.xml", "word/endnotes.xml"):
            root = part(name)
            if root is not None:
                walk(root, "Footer")
    out, found, at = [], [], 0
    for t, (kind, level) in zip((normalize(t) for t in texts), blocks, strict=True):
        found.append(Block(kind, at, at + len(t), level))
        out.append(t)
        at += len(t) + 2
    return "\n\n".join(out), found, {}


def pdf(data: bytes) -> Extracted:
    """Text of PDF pages, if a library for it is there."""
    try:
        import pypdf
    except ImportError as e:
        raise SheafError(6101, "no PDF library is installed") from e
    out, found, at = [], [], 0
    for no, page in enumerate(pypdf.PdfReader(io.BytesIO(data)).pages, 1):
        t = re.sub(r"(?<=\w)-\n(?=[a-z])", "", normalize(page.extract_text() or "")).strip()
        if t:
            found += [Block("Paragraph", at + b.start, at + b.end, 0, no) for b in plain_text(t)[1]]
            out.append(t)
            at += len(t) + 2
    return "\n\n".join(out), found, {}


Extractor = Callable[[bytes], Extracted]


class Registry:
    """Extractors by media type and extension; those added come before the built-in ones, an id may be there once."""

    def __init__(self) -> None:
        self._all: list[tuple[str, frozenset[str], frozenset[str], Extractor]] = []
        self._versions: dict[str, int] = {}
        self._built = [
            ("plain-text", frozenset({"text/plain"}), frozenset("txt log csv text".split()), lambda d: plain_text(decode(d))),
            ("markdown", frozenset({"text/markdown"}), frozenset("md markdown".split()), lambda d: markdown(decode(d))),
            ("docx", frozenset({"application/vnd.openxmlformats-officedocument.wordprocessingml.document"}), frozenset({"docx"}), docx),
            ("pdf", frozenset({"application/pdf"}), frozenset({"pdf"}), pdf),
        ]

    def add(self, name: str, media_types: set[str], extensions: set[str], extractor: Extractor, version: int = 1) -> None:
        if any(name == n for n, *_ in self._all):
            raise ValueError(f"an extractor {name!r} is there already")
        self._all.append((name, frozenset(media_types), frozenset(extensions), extractor))
        self._versions[name] = version

    def fingerprint(self, media_type: str | None, path: str | None) -> str:
        """The name and version of the extractor that takes a document; 'none' where there is none."""
        got = self.find(media_type, path)
        return f"{got[0]}:{self._versions.get(got[0], 1)}" if got else "none"

    def find(self, media_type: str | None, path: str | None) -> tuple[str, Extractor] | None:
        kind = (media_type or "").split(";")[0].strip().lower()
        ext = (path or "").rpartition(".")[2].lower() if "." in (path or "") else ""
        for k in (1, 2):
            for x in [*self._all, *self._built]:
                if (k == 1 and kind in x[1]) or (k == 2 and ext in x[2]):
                    return x[0], x[3]
        return None


def extract_text(text: str, media_type: str) -> Extracted:
    """Blocks of a text that is at hand already."""
    return markdown(text) if media_type.split(";")[0].strip().lower() == "text/markdown" else plain_text(text)

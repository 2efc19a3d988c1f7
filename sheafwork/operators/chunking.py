"""Chunkers: blocks merged under a token budget, token windows with overlap, and sections by headings.

The cores work on one text in plain Python and are run over Arrow batches; all offsets are code
points. A chunk's budget holds for its whole span, which is counted again when blocks are
merged, since tokens need not add up over what stands between them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.errors import SheafError
from sheafwork.functions.text import SEPARATOR
from sheafwork.sources.extract import Block

Counter = Callable[[str], int]

GRAPHEME = regex.compile(r"\X")
SIMPLE = regex.compile(r"[\n -~\u00a0-\u02ff\u0370-\u0482\u048a-\u058f\u2010-\u2027\u3001-\u3029\u3041-\u3096\u30a1-\u30ff\u4e00-\u9fff\uff01-\uff9d]*+")
UNIT = regex.compile(r"[\p{L}\p{N}]{1,8}|[^\p{L}\p{N}\s]")
#: Signs that end a sentence before white space, and abbreviations whose point doesn't.
SENTENCE_END = regex.compile(r"[.!?…。！？](?=\s|$)")
ABBREVIATIONS = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "St.", "e.g.", "i.e.", "etc.", "vs.", "No.", "Fig.")
INITIAL = regex.compile(r"(?:^|\P{L})[A-Z]\.$")
PARAGRAPH = regex.compile(r"\s*\n\s*\n\s*")
LOOK_BACK = 0.15


def units(text: str) -> int:
    """The default counter: a token for every started eight letters or digits of a run and for any other sign."""
    return sum(1 for _ in UNIT.finditer(text))


ITEM = regex.compile(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")


def unit_spans(text: str) -> Callable[[int, int], int]:
    """``units`` of any span of one text, each in logarithmic time: runs and signs are found once."""
    starts, ends, before = [], [], [0]
    for m in ITEM.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
        before.append(before[-1] + (m.end() - m.start() + 7) // 8)

    def count(a: int, b: int) -> int:
        i, j = bisect_right(ends, a), bisect_left(starts, b) - 1
        if i > j:
            return 0
        part = lambda k: (min(ends[k], b) - max(starts[k], a) + 7) // 8
        return part(i) if i == j else part(i) + before[j] - before[i + 1] + part(j)

    return count


units.spans = unit_spans  # type: ignore[attr-defined]


def spans_of(text: str, count: Counter) -> Callable[[int, int], int]:
    """A counter of spans of one text; a counter may bring its own as ``spans``."""
    own = getattr(count, "spans", None)
    return own(text) if own else lambda a, b: count(text[a:b])


@dataclass(frozen=True)
class Options:
    """A resolved budget. ``overflow``: split, truncate or throw."""

    max_tokens: int
    overlap_tokens: int
    min_tokens: int
    heading_budget: int = 32
    split_levels: tuple[int, ...] = (1, 2, 3)
    prepend_headings: bool = True
    include_preamble: bool = True
    merge_short: bool = True
    sentence_aware: bool = True
    repeat_header: bool = True
    overflow: str = "split"


def resolve(sequence: int, overhead: int = 2, prefix: int = 0, heading_budget: int = 32, max_tokens: int | None = None, overlap_tokens: int | None = None, min_tokens: int | None = None, **kw) -> Options:  # noqa: ANN003
    """Options from a model's sequence length: what isn't given is derived, what cannot be is an error."""
    most = max_tokens if max_tokens is not None else sequence - overhead - heading_budget - prefix
    over = overlap_tokens if overlap_tokens is not None else max(8, most * 15 // 100 // 8 * 8)
    least = min_tokens if min_tokens is not None else max(16, most // 8)
    if heading_budget <= 0 or most <= 0 or most + overhead + heading_budget + prefix > sequence:
        raise SheafError(6003, f"{most} + {overhead} + {heading_budget} + {prefix} against {sequence}")
    if not 0 <= over < most / 2:
        raise SheafError(6153, f"{over} of {most}")
    if not 0 < least < most:
        raise SheafError(6003, f"min {least} of {most}")
    return Options(most, over, least, heading_budget, **kw)


def resolve_for(model: str, **kw) -> Options:  # noqa: ANN003
    """The same for a model of ``embedding.PRESETS``, whose sequence length bounds a chunk."""
    from sheafwork.operators.embedding import PRESETS

    if model not in PRESETS:
        raise SheafError(6003, f"unknown model {model}")
    return resolve(PRESETS[model][1], **kw)


@dataclass(frozen=True)
class Chunk:
    """A piece of a text; ``embed_text`` is the breadcrumb, a blank line and the text."""

    ordinal: int
    start: int
    end: int
    tokens: int
    path: tuple[str, ...]
    text: str
    embed_text: str
    kind: str
    page: int


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def _natural(text: str, lo: int, cut: int) -> int | None:
    """The best end in (lo, cut]: before a blank line, after a sentence, before white space; none if there is none."""
    part = text[lo:cut]
    for m in reversed(list(PARAGRAPH.finditer(part))):
        if m.start() > 0:
            return lo + m.start()
    for m in reversed(list(SENTENCE_END.finditer(text, lo, min(len(text), cut + 1)))):
        if m.end() <= cut and not (m.group() == "." and (text.endswith(ABBREVIATIONS, 0, m.end()) or INITIAL.search(text[max(0, m.end() - 3) : m.end()]))):
            return m.end()
    spaces = list(regex.finditer(r"\s+", part))
    return next((lo + m.start() for m in reversed(spaces) if m.start() > 0), None)


def windows(text: str, a: int, b: int, o: Options, count: Counter) -> Iterator[tuple[int, int, int]]:
    """(start, end, tokens) of windows within the budget, each beginning inside the one before."""
    a, b = _trim(text, a, b)
    if a >= b:
        return
    simple = SIMPLE.fullmatch(text, a, b)  # every character is a grapheme
    edges = range(a, b + 1) if simple else [a, *(m.end() for m in GRAPHEME.finditer(text, a, b))]
    n = spans_of(text, count)
    at = 0
    while at < len(edges) - 1:
        start = edges[at]
        step, hi = 64, at + 1  # gallop, then halve
        while hi < len(edges) - 1 and n(start, edges[min(hi + step, len(edges) - 1)]) <= o.max_tokens:
            hi = min(hi + step, len(edges) - 1)
            step *= 2
        lo, top = hi, min(hi + step, len(edges) - 1)
        while lo < top:
            mid = (lo + top + 1) // 2
            if n(start, edges[mid]) <= o.max_tokens:
                lo = mid
            else:
                top = mid - 1
        stop = edges[max(lo, at + 1)]
        if stop < b and o.sentence_aware:
            back = max(1, int((stop - start) * LOOK_BACK))
            better = _natural(text, max(start, stop - back), stop)
            if better is not None and better > start and not text[start:better].isspace():
                stop = edges[bisect_left(edges, better)]
        if not text[start:stop].isspace():
            yield start, stop, n(start, stop)
        if stop >= b:
            return
        k = bisect_left(edges, stop)
        nxt = k
        if o.overlap_tokens > 0:
            lo, hi = at, k
            while lo < hi:
                mid = (lo + hi) // 2
                if n(edges[mid], stop) <= o.overlap_tokens:
                    hi = mid
                else:
                    lo = mid + 1
            if lo > at:
                nxt = lo
                if not text[edges[lo] - 1].isspace():  # to the start of a word, if one follows in the window
                    w = regex.compile(r"\s+(?=\S)").search(text, edges[lo], stop)
                    nxt = bisect_left(edges, w.end()) if w and w.end() < stop else lo
        at = nxt if nxt > at else k


def fit_path(path: tuple[str, ...], o: Options, count: Counter) -> tuple[str, ...]:
    """Headings within their budget: the outermost go first, then the last one is cut."""
    path = tuple(p for p in path if p)
    while len(path) > 1 and count(SEPARATOR.join(path)) > o.heading_budget:
        path = path[1:]
    if path and count(path[0]) > o.heading_budget and len(path) == 1:
        if o.overflow == "throw":
            raise SheafError(6152, path[0][:40])
        edges = [0, *(m.end() for m in GRAPHEME.finditer(path[0]))]
        keep = max((e for e in edges if count(path[0][:e]) <= o.heading_budget), default=0)
        path = (path[0][:keep],) if keep else ()
    return path


def _chunk(ordinal: int, text: str, a: int, b: int, n: int, path: tuple[str, ...], o: Options, count: Counter, kind: str, page: int, body: str | None = None) -> Chunk:
    p = fit_path(path, o, count)
    body = text[a:b] if body is None else body
    return Chunk(ordinal, a, b, n, p, body, (SEPARATOR.join(p) + "\n\n" + body) if p and o.prepend_headings else body, kind, page)


def _last_row(text: str, blocks: list[Block], header: str, i: int, o: Options, count: Counter) -> int:
    """The last row that fits with those from ``i`` under the header: gallop, then halve, so that rows are counted a few times and not once each."""

    def fits(j: int) -> bool:
        return count(f"{header}\n{text[blocks[i].start : blocks[j].end]}") <= o.max_tokens

    step, lo = 1, i
    while lo + step < len(blocks) and fits(lo + step):
        lo, step = lo + step, 2 * step
    hi = min(lo + step, len(blocks) - 1)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if fits(mid) else (lo, mid - 1)
    return lo


def _oversize(text: str, blocks: list[Block], path: tuple[str, ...], o: Options, count: Counter, first: int) -> Iterator[Chunk]:
    """Pieces of a stretch over the budget: rows of a table under its header, or windows."""
    a, b = blocks[0].start, blocks[-1].end
    if o.overflow == "throw":
        raise SheafError(6151, f"{count(text[a:b])} tokens of {o.max_tokens}")
    out: list[Chunk] = []
    if o.repeat_header and len(blocks) > 1 and all(x.kind == "TableRow" for x in blocks):
        header, i = text[blocks[0].start : blocks[0].end], 1
        while i < len(blocks):
            j = _last_row(text, blocks, header, i, o, count)
            body = f"{header}\n{text[blocks[i].start : blocks[j].end]}"
            n = count(body)
            if n <= o.max_tokens:
                out.append(_chunk(first + len(out), text, blocks[i].start, blocks[j].end, n, path, o, count, "TableRow", blocks[0].page, body))
            else:
                out += [_chunk(first + len(out) + k, text, s, e, n, path, o, count, "TableRow", blocks[0].page) for k, (s, e, n) in enumerate(windows(text, blocks[i].start, blocks[j].end, o, count))]
            i = j + 1
    else:
        out = [_chunk(first + k, text, s, e, n, path, o, count, blocks[0].kind, blocks[0].page) for k, (s, e, n) in enumerate(windows(text, a, b, o, count))]
    return iter(out[:1] if o.overflow == "truncate" else out)


def plain(text: str, blocks: list[Block], o: Options, count: Counter = units) -> list[Chunk]:
    """Blocks in order, merged while their span keeps the budget."""
    out: list[Chunk] = []
    n = spans_of(text, count)
    open_: list[Block] = []
    for x in [*(x for x in blocks if text[x.start : x.end].strip()), None]:
        if open_ and (x is None or n(open_[0].start, x.end) > o.max_tokens):
            a, b = open_[0].start, open_[-1].end
            out.append(_chunk(len(out), text, a, b, n(a, b), (), o, count, open_[0].kind, open_[0].page))
            open_ = []
        if x is not None:
            if n(x.start, x.end) > o.max_tokens:
                out += _oversize(text, [x], (), o, count, len(out))
            else:
                open_.append(x)
    return out


def token_window(text: str, o: Options, count: Counter = units) -> list[Chunk]:
    """Windows over the whole text."""
    return [_chunk(i, text, a, b, n, (), o, count, "Paragraph", -1) for i, (a, b, n) in enumerate(windows(text, 0, len(text), o, count))]


def by_headings(text: str, blocks: list[Block], o: Options, count: Counter = units) -> list[Chunk]:
    """Sections between headings, with their path; short ones take in those that follow."""
    sections: list[tuple[tuple[str, ...], list[Block], bool]] = []
    stack: dict[int, str] = {}
    path: tuple[str, ...] = ()
    body: list[Block] = []
    lead = True
    for x in [*blocks, None]:
        if x is None or (x.kind == "Heading" and x.level in o.split_levels):
            if body and text[body[0].start : body[-1].end].strip():
                sections.append((path, body, lead))
            if x is None:
                break
            body, lead = [], False
            stack = {k: v for k, v in stack.items() if k < x.level} | {x.level: heading_title(text[x.start : x.end])}
            path = tuple(stack[k] for k in sorted(stack) if stack[k])
        elif x.end > x.start:
            body.append(x)
    if not o.include_preamble:
        sections = [s for s in sections if not s[2]]
    out: list[Chunk] = []
    i = 0
    while i < len(sections):
        path, body, lead = sections[i]
        i += 1
        a, n = body[0].start, count(text[body[0].start : body[-1].end])
        while o.merge_short and not lead and n < o.min_tokens and i < len(sections) and not sections[i][2]:
            more = count(text[a : sections[i][1][-1].end])
            if more > o.max_tokens:
                break
            body, n, i = [*body, *sections[i][1]], more, i + 1
        if n <= o.max_tokens:
            out.append(_chunk(len(out), text, a, body[-1].end, n, path, o, count, body[0].kind, body[0].page))
        else:
            out += _oversize(text, body, path, o, count, len(out))
    return out


def heading_title(raw: str) -> str:
    """A heading's text: the first line without number signs, on one line, without separators of paths."""
    line = raw.split("\n", 1)[0].strip()
    m = regex.fullmatch(r"#{1,6}(?:[ \t]+(.*?))?(?:(?<=[ \t])#+|(?<=^#+[ \t]*)#+)?[ \t]*", line)
    title = regex.sub(r"[\p{Cc}\s]+", " ", (m.group(1) or "") if m else line)
    while SEPARATOR in title:
        title = title.replace(SEPARATOR, " ")
    return title.strip()


def chunk_text(text: str, blocks: list[Block], media_type: str, o: Options, chunker: str = "auto", count: Counter = units) -> list[Chunk]:
    """The chunks of one document; ``auto`` goes by the media type, headings only work on Markdown."""
    if chunker not in ("auto", "plain", "token-window", "markdown-heading"):
        raise SheafError(6005, chunker)
    if chunker == "token-window":
        return token_window(text, o, count)
    if chunker != "plain" and media_type == "text/markdown":
        return by_headings(text, blocks, o, count)
    return plain(text, blocks, o, count)


CHUNK = "ordinal int, char_start int, char_end int, token_count int, heading_path array<string>, text string, embed_text string, kind string, page int"


def chunk_documents(df: DataFrame, key: str, text: str, media_type: str, o: Options, chunker: str = "auto", count: Counter = units) -> DataFrame:
    """One row per chunk: ``key`` and the columns of ``CHUNK``. Null and blank texts have none."""
    from sheafwork.sources.extract import extract_text

    schema = T.StructType([df.schema[key], *T._parse_datatype_string(CHUNK).fields])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, got = [], []
            for i, (t, m) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if t and t.strip():
                    norm, blocks, _ = extract_text(t, m or "text/plain")
                    cs = chunk_text(norm, blocks, m or "text/plain", o, chunker, count)
                    rows += [i] * len(cs)
                    got += [(c.ordinal, c.start, c.end, c.tokens, list(c.path), c.text, c.embed_text, c.kind, c.page) for c in cs]
            cols = list(zip(*got, strict=True)) if got else [()] * 9
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.names)

    return df.select(key, text, F.col(media_type)).mapInArrow(of, schema)


def chunk_extracted(docs: DataFrame, o: Options, chunker: str = "auto", count: Counter = units) -> DataFrame:
    """The chunks of extracted documents (``document_id``, ``text``, ``blocks``, ``media_type``), and ``error``.

    A document that the chunker fails on gives one row with its error and nothing else, so that it fails alone.
    """
    schema = T.StructType([T.StructField("document_id", T.StringType()), *T._parse_datatype_string(CHUNK + ", error string").fields])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
        for b in batches:
            got: list[tuple] = []
            for i, t, blocks, m in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                try:
                    cs = chunk_text(t, [Block(**x) for x in blocks or []], (m or "text/plain").split(";")[0].strip().lower(), o, chunker, count) if t and t.strip() else []
                    got += [(i, c.ordinal, c.start, c.end, c.tokens, list(c.path), c.text, c.embed_text, c.kind, c.page, None) for c in cs]
                except Exception as e:  # noqa: BLE001
                    got.append((i, *[None] * 9, str(e)[:500]))
            cols = list(zip(*got, strict=True)) if got else [()] * 11
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)

    return docs.select("document_id", "text", "blocks", "media_type").mapInArrow(of, schema)

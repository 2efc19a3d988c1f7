"""Between extracted documents and a model of elements, without loss in either direction.

Other pipelines hand documents on as lists of elements (a heading, a paragraph, a table row, each with its own text) and not as
one text with spans. ``elements`` takes an extracted document apart and ``from_elements`` puts one together; what lies between
blocks is kept as elements of kind ``Gap``, so that taking apart and putting together gives the same text and blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

GAP = "Gap"
ELEMENTS = "array<struct<kind:string,text:string,level:int,page:int>>"
BLOCKS = "array<struct<kind:string,start:int,end:int,level:int,page:int>>"


def apart(text: str, blocks: list[dict]) -> list[dict]:
    """The elements of a text: its blocks in order, and what lies between them."""
    out, at = [], 0
    for b in sorted(blocks, key=lambda b: (b["start"], b["end"])):
        if b["start"] > at:
            out.append({"kind": GAP, "text": text[at : b["start"]], "level": 0, "page": -1})
        # a block that begins before the last one's end shares text with it; the shared part stays with the first
        out.append({"kind": b["kind"], "text": text[max(at, b["start"]) : max(at, b["end"])], "level": b["level"], "page": b["page"]})
        at = max(at, b["end"])
    return [*out, {"kind": GAP, "text": text[at:], "level": 0, "page": -1}] if at < len(text) else out


def together(elements: list[dict]) -> tuple[str, list[dict]]:
    """A text and its blocks. Elements that no gap parts, as those of another model, are parted by a blank line."""
    parts, blocks, at = [], [], 0
    gaps = any(e["kind"] == GAP for e in elements)
    for k, e in enumerate(elements):
        if k and not gaps:
            parts.append("\n\n")
            at += 2
        t = e["text"] or ""
        if e["kind"] != GAP:
            blocks.append({"kind": e["kind"] or "Paragraph", "start": at, "end": at + len(t), "level": e["level"] or 0, "page": -1 if e["page"] is None else e["page"]})
        parts.append(t)
        at += len(t)
    return "".join(parts), blocks


def _over(df: DataFrame, drop: list[str], takes: list[str], adds: T.StructType, f) -> DataFrame:  # noqa: ANN001
    keep = [c for c in df.columns if c not in drop and c not in adds.names]
    schema = T.StructType([*df.select(*keep).schema.fields, *adds.fields])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(x.dataType) for x in adds.fields]
        for b in batches:
            rows = [f(*x) for x in zip(*(b.column(len(keep) + i).to_pylist() for i in range(len(takes))), strict=True)]
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *made], names=schema.names)

    return df.select(*keep, *takes).mapInArrow(of, schema)


def elements(extracted: DataFrame) -> DataFrame:
    """Extracted documents with ``elements`` in the place of ``text`` and ``blocks``; a null text gives null."""
    adds = T.StructType([T.StructField("elements", T._parse_datatype_string(ELEMENTS))])
    return _over(extracted, ["text", "blocks"], ["text", "blocks"], adds, lambda t, b: (None if t is None else apart(t, b or []),))


def from_elements(df: DataFrame) -> DataFrame:
    """Documents with ``text`` and ``blocks`` in the place of ``elements``; null gives nulls."""
    adds = T.StructType([T.StructField("text", T.StringType()), T.StructField("blocks", T._parse_datatype_string(BLOCKS))])
    return _over(df, ["elements"], ["elements"], adds, lambda e: (None, None) if e is None else together(e))

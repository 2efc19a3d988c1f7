"""Column expressions on text and on ISO 8601 instants."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode White_Space, as a body of a character class.
WHITE_SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """``c`` without Unicode white space at either end."""
    return F.regexp_replace(c, f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "")


def media_type(c: Column) -> Column:
    """A media type without parameters, case and outer white space."""
    return F.lower(strip(F.substring_index(c, ";", 1)))


def usable_digest(c: Column) -> Column:
    """``c``, or null where it is empty or holds only zero bytes."""
    return F.when(F.regexp_replace(F.hex(c), "0", "") != "", c)


def instant(c: Column) -> Column:
    """A struct that orders ISO 8601 texts by instant, to the ninth decimal of a second.

    ``at`` is the whole second (an offset is honoured, none means UTC), ``nanos`` the rest.
    Text that is no instant gives nulls, which order before all others.
    """
    text = strip(c)
    whole = F.regexp_replace(text, r"[.,]\d+", "")
    frac = F.regexp_extract(text, r"[.,](\d+)", 1)
    at = F.try_to_timestamp(F.when(whole.rlike(r"(Z|z|[+-]\d\d:?\d\d)$"), whole).otherwise(F.concat(whole, F.lit("Z"))))
    return F.struct(at.alias("at"), F.when(at.isNotNull(), F.rpad(F.substring(frac, 1, 9), 9, "0").cast("int")).alias("nanos"))


#: Last extensions of a path and their media types.
EXTENSIONS = {
    "txt": "text/plain", "log": "text/plain", "csv": "text/plain", "text": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
#: Fixed value: what joins the headings of a path.
SEPARATOR = " › "


def media_type_of_path(path: Column) -> Column:
    """The media type of a path's last extension; octet-stream for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    known = F.create_map(*[x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(known, ext), F.lit("application/octet-stream"))


def normalized(text: Column, nfc: bool = True) -> Column:
    """Text without a byte order mark, with ``\\n`` for line ends, plain spaces for fixed ones and composed characters."""
    t = F.regexp_replace(text, "^﻿", "")
    t = F.translate(F.regexp_replace(t, "\r\n?", "\n"), "   ", "   ")
    return composed(t) if nfc else t


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """Canonical composition; ASCII passes as it is."""
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s))


def content_hash(*parts: Column) -> Column:
    """A 128-bit digest of the parts, joined by the unit separator, in hexadecimal."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def chunk_key(source: Column, document: Column, embed_text: Column, duplicate: Column) -> Column:
    """A chunk's key from what it is, wherever it stands: digests of source, document and text, and its number among equal ones."""
    return content_hash(content_hash(source), content_hash(document), content_hash(embed_text), duplicate)


def heading(title: Column) -> Column:
    """A heading on one line: control characters and runs of white space become a space, separators of paths go."""
    t = F.regexp_replace(title, r"[\p{Cntrl}\p{IsWhite_Space}]+", " ")
    t = F.regexp_replace(t, r"(?: ›)+(?= )|(?:(?<=^)› )+", "")
    return F.trim(t)


def breadcrumb(path: Column) -> Column:
    """Headings joined by the separator; null for none."""
    return F.when(F.size(path) > 0, F.array_join(path, SEPARATOR))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.floor((F.length(F.coalesce(text, F.lit(""))) + 3) / 4)


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, trimmed; blank ones are left out."""
    return F.filter(F.transform(F.split(text, r"\n[^\S\n]*(?:\n[^\S\n]*)+"), strip), lambda p: p != "")

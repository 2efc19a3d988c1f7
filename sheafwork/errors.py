"""Numbered errors of the data paths."""

from __future__ import annotations

#: Error codes and what they mean.
CODES = {
    5201: "collection not found", 5202: "no key column", 5203: "unsupported key type", 5204: "unsupported column type", 5205: "reserved column name", 5206: "no vector column",
    5207: "several vector columns", 5208: "dimensions out of range", 5209: "unsupported distance function", 5210: "too many neighbours asked for", 5211: "unsupported filter",
    5212: "wrong number of dimensions", 5213: "full-text column must be named", 6003: "invalid chunk options", 6005: "unknown chunker", 6008: "another run is active",
    6009: "recipe has changed", 6010: "run aborted after failures in a row", 6052: "document too large", 6053: "document unreadable", 6054: "document delivered twice in a run", 6101: "no extractor accepts this media type", 6106: "text is not valid in its encoding", 6151: "chunk exceeds its budget", 6152: "heading exceeds its budget",
    6153: "overlap exceeds the budget", 6154: "empty chunk", 6206: "embedding window failed", 7201: "no retriever", 7202: "retrieval failed", 7203: "collection cannot be searched that way", 7204: "context budget too small",
}


class SheafError(ValueError):
    """An error with a code of ``CODES``."""

    def __init__(self, code: int, detail: str = ""):
        self.code = code
        super().__init__(f"{code}: {CODES[code]}" + (f" ({detail})" if detail else ""))

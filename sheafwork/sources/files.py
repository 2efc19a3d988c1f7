"""Documents from folders, lists of files and tables, as rows of one schema."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.functions.text import media_type_of_path
from sheafwork.sources.extract import Registry

#: Fixed value: bytes from which a document isn't read.
MOST_BYTES = 32 << 20


def folder(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(``document_id``, ``path``, ``media_type``, ``size_bytes``, ``modified_utc``, ``content``) of a folder's files.

    The id is the path below the folder. Content is a column like others: a plan that doesn't ask for it
    doesn't read it, and a filter on ``size_bytes`` is pushed to the listing.
    """
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern.rpartition("/")[2]).option("recursiveFileLookup", str(recursive).lower())
    root = path.rstrip("/") + ("/" + pattern.rpartition("/")[0] if "/" in pattern else "")
    bare = path.rstrip("/").removeprefix("file://").removeprefix("file:")
    df = r.load(root)
    rel = F.regexp_replace("path", r"^file:/+", "/")
    return df.select(
        F.substring(rel, len(bare) + 2, 1 << 30).alias("document_id"), "path", media_type_of_path(F.col("path")).alias("media_type"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_utc"), "content",
    )


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same for a list of files; the id is the path."""
    df = spark.read.format("binaryFile").load(paths)
    return df.select(F.regexp_replace("path", r"^file:/+", "/").alias("document_id"), "path", media_type_of_path(F.col("path")).alias("media_type"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_utc"), "content")


def items(df: DataFrame, document_id: str, text: str, media_type: str | None = None) -> DataFrame:
    """The same for texts of a table."""
    kind = F.lit("text/plain") if media_type is None else F.coalesce(F.col(media_type), F.lit("text/plain"))
    return df.select(F.col(document_id).cast("string").alias("document_id"), F.lit(None).cast("string").alias("path"), kind.alias("media_type"), F.octet_length(text).cast("long").alias("size_bytes"), F.lit(None).cast("timestamp").alias("modified_utc"), F.encode(F.col(text), "UTF-8").alias("content"))


EXTRACTED = "document_id string, status string, error string, extractor_id string, text string, blocks array<struct<kind:string,start:int,end:int,level:int,page:int>>, metadata map<string,string>"


def extract(docs: DataFrame, registry: Registry | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per document with ``status`` Indexed, NoTextLayer, Unsupported or Failed; an error fails its row, not the job."""
    reg = registry or Registry()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("document_id", pa.string()), ("status", pa.string()), ("error", pa.string()), ("extractor_id", pa.string()), ("text", pa.string()), ("blocks", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("level", pa.int32()), ("page", pa.int32())]))), ("metadata", pa.map_(pa.string(), pa.string()))])
        for b in batches:
            rows = []
            for r in b.to_pylist():
                got = reg.find(r["media_type"], r["path"])
                row = {"document_id": r["document_id"], "status": "Unsupported", "error": "6101: no extractor accepts this media type", "extractor_id": None, "text": None, "blocks": [], "metadata": []}
                if r["size_bytes"] is not None and r["size_bytes"] > most_bytes:
                    row |= {"status": "Failed", "error": f"larger than {most_bytes} bytes"}
                elif got:
                    row["extractor_id"] = got[0]
                    try:
                        text, blocks, meta = got[1](bytes(r["content"] or b""))
                        row |= {"status": "Indexed" if text.strip() else "NoTextLayer", "error": None, "text": text, "blocks": [vars(x) for x in blocks], "metadata": list(meta.items())}
                    except Exception as e:  # noqa: BLE001
                        row |= {"status": "Unsupported" if "no PDF library" in str(e) else "Failed", "error": str(e)[:500]}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    big = F.when(F.col("size_bytes") <= most_bytes, F.col("content"))
    return docs.select("document_id", "path", "media_type", "size_bytes", big.alias("content")).mapInArrow(of, EXTRACTED)

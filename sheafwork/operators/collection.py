"""Record collections: a versioned table with typed columns, one vector column and optional full-text columns."""

from __future__ import annotations

import dataclasses
import datetime
import types
import typing
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.errors import SheafError
from sheafwork.functions import vectors
from sheafwork.functions.filters import Predicate, where
from sheafwork.operators import search
from sheafwork.operators.embedding import Embedder, embed_distinct
from sheafwork.operators.fulltext import TextIndex
from sheafwork.operators.state import last_wins, next_keys
from sheafwork.runtime import materialize, small_enough
from sheafwork.sources.versioned import VersionedTable

#: Column types of record attributes.
TYPES = {int: T.LongType(), bool: T.BooleanType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(), uuid.UUID: T.StringType(), datetime.datetime: T.TimestampType(), datetime.date: T.DateType(), datetime.time: T.StringType()}
KEY_TYPES = (T.IntegerType, T.LongType, T.StringType)
RESERVED = "_rowid"


@dataclass(frozen=True)
class Definition:
    """A collection's columns: a key, data columns and exactly one vector."""

    key: str
    vector: str
    dimensions: int
    schema: T.StructType
    metric: str = "cosine"
    full_text: tuple[str, ...] = ()
    auto_key: bool = False

    def __post_init__(self) -> None:
        names = self.schema.names
        if self.key not in names:
            raise SheafError(5202, self.key)
        if not isinstance(self.schema[self.key].dataType, KEY_TYPES):
            raise SheafError(5203, self.schema[self.key].dataType.simpleString())
        if RESERVED in names:
            raise SheafError(5205, RESERVED)
        if self.vector not in names:
            raise SheafError(5206, self.vector)
        many = [f.name for f in self.schema if isinstance(f.dataType, T.ArrayType)]
        if len(many) > 1:
            raise SheafError(5207, ", ".join(many))
        bad = [f.name for f in self.schema if f.name != self.vector and isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.DecimalType, T.ByteType))]
        if bad:
            raise SheafError(5204, ", ".join(bad))
        if not 1 <= self.dimensions <= vectors.MOST_DIMENSIONS:
            raise SheafError(5208, str(self.dimensions))
        if self.metric.lower() not in vectors.DISTANCES:
            raise SheafError(5209, self.metric)

    @staticmethod
    def of(record: type, key: str, vector: str, dimensions: int, **kw) -> Definition:  # noqa: ANN003
        """From a dataclass: its attributes' types give the columns."""
        fields = []
        hints = typing.get_type_hints(record)
        for f in dataclasses.fields(record):
            hint = hints[f.name]
            args = [a for a in typing.get_args(hint) if a is not type(None)]
            nullable = type(None) in typing.get_args(hint)
            base = args[0] if isinstance(hint, types.UnionType) or typing.get_origin(hint) is typing.Union else hint
            if f.name == vector:
                fields.append(T.StructField(f.name, T.ArrayType(T.FloatType()), False))
            elif base in TYPES:
                fields.append(T.StructField(f.name, TYPES[base], nullable))
            else:
                raise SheafError(5204, f.name)
        return Definition(key, vector, dimensions, T.StructType(fields), **kw)


class Collection:
    """One collection under ``root``; every write is one commit of its versioned table."""

    def __init__(self, spark: SparkSession, root: str, definition: Definition, embedder: Embedder | None = None, source: str | None = None, document_prefix: str = "", query_prefix: str = "", tokenizer: str = "unicode61", diacritics: int = 1):
        """``embedder`` makes the vectors: of rows that come without any from the text in ``source``, after ``document_prefix``, and of queries given as text, after ``query_prefix``."""
        self.spark, self.root, self.d = spark, root, definition
        self.embedder, self.source, self.document_prefix, self.query_prefix = embedder, source, document_prefix, query_prefix
        self.table = VersionedTable(spark, root)
        self.indexes = {c: TextIndex(spark, f"{root}/_text/{c}", definition.key, tokenizer, diacritics) for c in definition.full_text}

    def exists(self) -> bool:
        return self.table.version() > 0

    def create(self) -> None:
        """Make the table if it isn't there."""
        if not self.exists():
            self.table.commit(add=self.spark.createDataFrame([], self.d.schema), properties={"dimensions": str(self.d.dimensions), "metric": self.d.metric})

    def drop(self) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def _rows(self) -> DataFrame:
        if not self.exists():
            raise SheafError(5201, self.root)
        return self.table.read()

    def upsert(self, rows: DataFrame, order: list[str]) -> int:
        """Put in or replace rows by key; of rows with one key the last in ``order`` counts. Vectors are checked."""
        d = self.d
        self._rows()
        if d.auto_key:
            rows = next_keys(self._rows().select(d.key), rows, d.key, order)
        if d.vector not in rows.columns:
            if not (self.embedder and self.source):
                raise SheafError(5206, d.vector)
            rows = embed_distinct(rows, self.source, self.embedder, d.dimensions, prefix=self.document_prefix).withColumnRenamed("embedding", d.vector)
        new = last_wins(rows, [d.key], order).select(*d.schema.names)
        new = new.withColumn(d.vector, vectors.checked(F.col(d.vector), d.dimensions))
        new = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in d.schema])
        new = materialize(new, "upsert")
        # the text indexes come first: replacing what a run that died has left there gives the same again
        for c, index in self.indexes.items():
            index.update(new, c)
        return self.table.commit(add=new, delete_keys=new.select(d.key))

    def delete(self, keys: DataFrame) -> int:
        """Delete the rows that match ``keys``' columns."""
        gone = None
        if self.indexes:
            k = keys.distinct().alias("k")
            same = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in keys.columns]
            gone = materialize(self._rows().alias("r").join(k, same, "left_semi").select(self.d.key), "deleted")
        out = self.table.commit(delete_keys=keys)
        for index in self.indexes.values():
            index.delete(gone)
        return out

    def _cols(self, include_vectors: bool) -> list[str]:
        return [c for c in self.d.schema.names if include_vectors or c != self.d.vector]

    def get(self, keys: list | DataFrame, include_vectors: bool = False) -> DataFrame:
        """The records with these keys: a list, whose filter reaches the scan, or any number of them as a DataFrame's only column."""
        if isinstance(keys, DataFrame):
            found = self._rows().join(small_enough(keys.toDF(self.d.key).distinct()), self.d.key, "left_semi")
        else:
            found = self._rows().where(F.col(self.d.key).isin(keys))
        return found.select(*self._cols(include_vectors))

    def scan(self, predicate: Predicate | None, top: int, skip: int = 0, order: list[tuple[str, bool]] | None = None, include_vectors: bool = False) -> DataFrame:
        """Filtered rows in order (columns and whether ascending; the key breaks ties), a page of them."""
        by = [F.col(c).asc() if up else F.col(c).desc() for c, up in order or []] + [F.col(self.d.key).asc()]
        return where(self._rows(), predicate).select(*self._cols(include_vectors)).orderBy(*by).offset(skip).limit(top)

    def search(self, query, top: int = 10, skip: int = 0, **kw) -> DataFrame:  # noqa: ANN001, ANN003
        return search.knn(self._rows(), query, top, skip, self.d.metric, key=self.d.key, vector=self.d.vector, embedder=self.embedder, prefix=self.query_prefix, **kw)

    def hybrid(self, query, keywords: list[str], top: int = 10, skip: int = 0, text: str | None = None, **kw) -> DataFrame:  # noqa: ANN001, ANN003
        """Records by both lanes; the keyword lane reads the index of the full-text column ``text``, which must be named if there are several."""
        rows = self._rows()
        if text is None and len(self.d.full_text) != 1:
            raise SheafError(5213)
        text = text or self.d.full_text[0]
        index = self.indexes.get(text)
        hits = search.hybrid(rows, query, keywords, text, top, skip, self.d.metric, key=self.d.key, vector=self.d.vector, embedder=self.embedder, prefix=self.query_prefix, index=index if index and index.table.version() else None, **kw)
        return rows.select(*self._cols(False)).join(F.broadcast(hits), self.d.key).orderBy(F.desc("score"), self.d.key)  # a page of hits


def list_collections(spark: SparkSession, root: str) -> list[str]:
    """Names of the collections under a folder: those with a committed version, nothing else that lies there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return sorted(n for n in names if VersionedTable(spark, f"{root}/{n}").version())


def query(spark: SparkSession, sql: str, **args) -> DataFrame:  # noqa: ANN003
    """SQL with named parameters."""
    return spark.sql(sql, args=args)

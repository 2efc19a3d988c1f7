"""Nearest-neighbour, keyword and hybrid search over one table.

All of it is one plan: the filter reaches the scan, distances are computed where the
vectors lie, ``orderBy().limit()`` keeps the best of each partition before anything moves
(TakeOrderedAndProject), and ranks are given to what a limit has bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.errors import SheafError
from sheafwork.functions import vectors
from sheafwork.functions.filters import Predicate, where
from sheafwork.operators import fulltext
from sheafwork.operators.embedding import Embedder
from sheafwork.runtime import materialize

#: The most neighbours of a search, and the defaults of hybrid search.
MOST_NEIGHBOURS, CANDIDATE_FACTOR, RRF_K = 4096, 4, 60


def _page(top: int, skip: int) -> None:
    if top < 1 or skip < 0:
        raise ValueError("top must be positive and skip not negative")
    if top + skip > MOST_NEIGHBOURS:
        raise SheafError(5210, str(top + skip))


def with_query(df: DataFrame, query: list[float] | str | DataFrame | Column, embedder: Embedder | None = None, prefix: str = "") -> tuple[DataFrame, Column]:
    """``df`` and the query vector as a column; a DataFrame must be a single row with a single column, a text needs an embedder, which gets it after ``prefix``."""
    if isinstance(query, str):
        if embedder is None:
            raise SheafError(7201, "a query given as text needs an embedder")
        query = [float(x) for x in embedder([prefix + query])[0]]
    if isinstance(query, DataFrame):
        one = query.limit(1).toDF("_query")  # one row, so the broadcast is bounded
        return df.crossJoin(F.broadcast(one)), F.col("_query")
    if isinstance(query, Column):
        return df, query
    return df, F.array(*[F.lit(float(x)) for x in query])


def knn(
    df: DataFrame,
    query: list[float] | str | DataFrame | Column,
    top: int = 10,
    skip: int = 0,
    metric: str = "cosine",
    predicate: Predicate | None = None,
    within: float | None = None,
    key: str = "key",
    vector: str = "embedding",
    include_vectors: bool = False,
    digits: int | None = None,
    embedder: Embedder | None = None,
    prefix: str = "",
) -> DataFrame:
    """The ``top`` rows after ``skip`` by distance, nearest first, ties by key.

    The predicate decides which rows compete, not which of the nearest are shown; ``within`` leaves out
    those farther. Rows with a null vector, or one of another length, don't compete. ``digits``
    rounds distances before they rank. A query given as text is embedded once, after ``prefix``.
    """
    _page(top, skip)
    rows, q = with_query(where(df, predicate), query, embedder, prefix)
    d = vectors.distance(metric, F.col(vector), q)
    rows = rows.withColumn("distance", d if digits is None else F.round(d, digits) + F.lit(0.0)).where(F.col("distance").isNotNull())
    if within is not None:
        rows = rows.where(F.col("distance") <= within)
    cols = [c for c in df.columns if include_vectors or c != vector]
    out = rows.select(*cols, "distance").orderBy("distance", key).limit(top + skip)
    return out.offset(skip) if skip else out


#: Rows and queries that a packed block holds, and how many blocks of queries are broadcast.
PACKED, MOST_BLOCKS = 2048, 64


def _packed(df: DataFrame, key: str, vector: str, to: str) -> DataFrame:
    """Blocks of rows: their keys and their vectors of one length as bytes. Null vectors are left out."""
    kind = df.schema[key].dataType

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            size = np.diff(v.offsets.to_numpy())
            ok = v.is_valid().to_numpy(zero_copy_only=False)
            for dims in np.unique(size[ok]):
                own = np.flatnonzero(ok & (size == dims))
                for lo in range(0, len(own), PACKED):
                    part = own[lo : lo + PACKED]
                    x = v.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    keys = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), b.column(0).take(pa.array(part)))
                    yield pa.RecordBatch.from_arrays([keys, pa.array([x.tobytes()], pa.binary()), pa.array([int(dims)], pa.int32())], names=[f"{to}_keys", f"{to}_data", f"{to}_dims"])

    schema = T.StructType([T.StructField(f"{to}_keys", T.ArrayType(kind)), T.StructField(f"{to}_data", T.BinaryType()), T.StructField(f"{to}_dims", T.IntegerType())])
    return df.select(key, F.col(vector).cast("array<double>")).mapInArrow(of, schema)


def block_distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """(queries, rows) distances in double precision; NaN where there is none, as of a zero vector's angle."""
    if metric in ("cosine", "cosinedistance"):
        with np.errstate(invalid="ignore", divide="ignore"):
            d = 1 - (q @ x.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1))
        return np.where(np.isfinite(d), np.maximum(d, 0), np.nan)
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        d = q[:, j, None] - x[None, :, j]
        out += d * d if metric in ("l2", "euclideandistance") else np.abs(d)
    return np.sqrt(out) if metric in ("l2", "euclideandistance") else out


def knn_batch(df: DataFrame, queries: DataFrame, top: int, metric: str = "cosine", key: str = "key", vector: str = "embedding", digits: int | None = None) -> DataFrame:
    """Many queries at once: (``query``, ``key``, ``distance``, ``rank``); ties are ranked by key.

    ``queries``: ``query``, ``qvec``, any number of them. Both sides are packed into blocks, so what is joined are blocks,
    a few thousandths of the rows; distances of two blocks are a matrix product, of which each query's ``top``
    go on. The limit on the rank is applied in every task before rows move.
    """
    metric = metric.lower()
    if metric not in vectors.DISTANCES or metric == "hamming":
        raise SheafError(5209, metric)
    q = materialize(_packed(queries, "query", "qvec", "q"), "queries")
    j = _packed(df, key, vector, "x").join(F.broadcast(q) if q.count() <= MOST_BLOCKS else q, F.col("x_dims") == F.col("q_dims"))
    kinds = [queries.schema["query"].dataType, df.schema[key].dataType]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                dims = b.column(2)[r].as_py()
                xk, qk = b.column(0)[r].values, b.column(3)[r].values
                x, y = (np.frombuffer(b.column(c)[r].as_py(), np.float64).reshape(-1, dims) for c in (1, 4))
                order = pa.compute.sort_indices(xk).to_numpy()  # a stable sort by distance leaves ties by key
                xk, x = xk.take(pa.array(order)), x[order]
                d = block_distances(y, x, metric)
                if digits is not None:
                    d = np.round(d, digits) + 0.0
                at = np.argsort(d, axis=1, kind="stable")[:, :top]  # NaN comes last
                best = np.take_along_axis(d, at, axis=1)
                who, col = np.nonzero(np.isfinite(best))
                yield pa.RecordBatch.from_arrays([qk.take(pa.array(who)), xk.take(pa.array(at[who, col])), pa.array(best[who, col])], names=["query", "key", "distance"])

    schema = T.StructType([T.StructField("query", kinds[0]), T.StructField("key", kinds[1]), T.StructField("distance", T.DoubleType())])
    near = j.select("x_keys", "x_data", "x_dims", "q_keys", "q_data").mapInArrow(of, schema)
    w = Window.partitionBy("query").orderBy("distance", "key")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query", "key", "distance", "rank")


@dataclass(frozen=True)
class Hybrid:
    """Options of hybrid search: weights of the lanes, the fusion's constant, candidates a lane (none: four times what is asked for)."""

    vector_weight: float = 1.0
    keyword_weight: float = 1.0
    k: int = RRF_K
    candidates: int | None = None
    match_all: bool = False
    tokenizer: str = "unicode61"
    diacritics: int = 1

    def wanted(self, top: int, skip: int) -> int:
        if self.candidates is not None:
            if self.candidates < 1:
                raise ValueError("candidates must be positive")
            return min(self.candidates, MOST_NEIGHBOURS)
        return min((top + skip) * CANDIDATE_FACTOR, MOST_NEIGHBOURS)


def hybrid(
    df: DataFrame,
    query: list[float] | str | DataFrame | Column,
    keywords: list[str],
    text: str | list[str],
    top: int = 10,
    skip: int = 0,
    metric: str = "cosine",
    predicate: Predicate | None = None,
    least_score: float | None = None,
    key: str = "key",
    vector: str = "embedding",
    options: Hybrid = Hybrid(),  # noqa: B008
    digits: int | None = None,
    index: fulltext.TextIndex | None = None,
    embedder: Embedder | None = None,
    prefix: str = "",
) -> DataFrame:
    """Keyword and vector lanes, each ranked, fused by reciprocal rank: (``key``, ``score``), best first.

    Both lanes see the same predicate, but the keyword statistics are those of all rows. Blank
    keywords are dropped; without any left this is a vector search with the score of its
    ranks. ``text``: the full-text column; of several, one must be named. ``least_score`` is
    applied to the page, after limit and offset. With an ``index`` of the text the keyword lane reads the terms asked for
    and no text.
    """
    _page(top, skip)
    if not isinstance(text, str):
        if len(text) != 1:
            raise SheafError(5213)
        text = text[0]
    keywords = [k for k in keywords if k and k.strip()]
    if not keywords:
        hits = knn(df, query, top, skip, metric, predicate, None, key, vector, digits=digits, embedder=embedder, prefix=prefix)
        rank = F.row_number().over(Window.orderBy("distance", key))  # at most ``top`` rows
        scored = hits.select(key, (F.lit(options.vector_weight) / (F.lit(options.k + skip) + rank)).alias("score"))
        return scored if least_score is None else scored.where(F.col("score") >= least_score)
    cand = options.wanted(top, skip)
    near = knn(df.select(key, vector, *([] if predicate is None else [c for c in df.columns if c not in (key, vector)])), query, cand, 0, metric, predicate, None, key, vector, digits=digits, embedder=embedder, prefix=prefix)
    v = near.select(key, F.row_number().over(Window.orderBy("distance", key)).alias("_vr"))  # bounded by the limit
    hits = index.bm25(keywords, options.match_all) if index else fulltext.bm25(df, keywords, text, key, options.match_all, options.tokenizer, options.diacritics)
    if predicate is not None:
        hits = hits.join(where(df, predicate).select(key), key, "left_semi")
    if digits is not None:
        hits = hits.withColumn("rank", F.round("rank", digits))
    words = hits.orderBy("rank", key).limit(cand)
    w = words.select(key, F.row_number().over(Window.orderBy("rank", key)).alias("_wr"))
    part = lambda weight, r: F.coalesce(F.lit(float(weight)) / (F.lit(options.k) + F.col(r)), F.lit(0.0))
    fused = v.join(w, key, "full_outer").select(key, (part(options.keyword_weight, "_wr") + part(options.vector_weight, "_vr")).alias("score"))
    out = fused.orderBy(F.desc("score"), key).limit(top + skip)
    out = out.offset(skip) if skip else out
    return out if least_score is None else out.where(F.col("score") >= least_score)

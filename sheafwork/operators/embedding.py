"""Tokenising and embedding: WordPiece, pooling, normalisation and pluggable models."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.functions.vectors import normalize
from sheafwork.runtime import materialize

#: models' dimensions, sequence lengths and pooling; lengths that batches are padded to.
PRESETS = {"mini-lm": (384, 256, "mean"), "mini-lm-multi": (384, 256, "mean"), "bge-small": (384, 512, "cls"), "mpnet": (768, 512, "mean")}
BUCKETS = (64, 128, 256, 512)
LONGEST_WORD = 100


#: Signs and Han characters stand alone; other characters but white space run together.
_ALONE = r"\p{P}$+<=>^`|~\u3400-\u9fff\uf900-\ufaff\U00020000-\U0002fa1f"
_WORD = regex.compile(rf"[{_ALONE}]|[^\s{_ALONE}]+")
_DROPPED = regex.compile(r"[\ufffd\p{Cf}\p{Cs}]|(?!\s)\p{Cc}")
_MARKS = regex.compile(r"\p{Mn}+")


def words(text: str, lower: bool = True) -> list[str]:
    """What WordPiece works on: cleaned, lower case without accents, signs and Han characters apart."""
    if lower:
        text = text.lower()
        if not text.isascii():
            text = _MARKS.sub("", unicodedata.normalize("NFD", text))
    return _WORD.findall(_DROPPED.sub("", text))


class WordPiece:
    """Greedy longest-match pieces over a vocabulary; ``##`` marks a continuation."""

    def __init__(self, vocabulary: list[str], unknown: str = "[UNK]", first: str = "[CLS]", last: str = "[SEP]", pad: str = "[PAD]", lower: bool = True):
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.unknown, self.first, self.last, self.pad, self.lower = (*(self.ids[x] for x in (unknown, first, last, pad)), lower)
        self._kept: dict[str, list[int]] = {}

    def pieces(self, word: str) -> list[int]:
        got = self._kept.get(word)
        if got is not None:
            return got
        out: list[int] = []
        at = 0
        if len(word) > LONGEST_WORD:
            return [self.unknown]
        while at < len(word):
            end = len(word)
            while end > at and ("##" if at else "") + word[at:end] not in self.ids:
                end -= 1
            if end == at:
                out = [self.unknown]
                break
            out.append(self.ids[("##" if at else "") + word[at:end]])
            at = end
        if len(self._kept) > 200_000:
            self._kept.clear()
        self._kept[word] = out
        return out

    def encode(self, text: str, most: int | None = None) -> tuple[list[int], bool]:
        """Ids with the first and last signs, and whether they were cut to ``most``."""
        ids = [i for w in words(text, self.lower) for i in self.pieces(w)]
        cut = most is not None and len(ids) > most - 2
        return [self.first, *(ids[: most - 2] if cut else ids), self.last], cut

    def count(self, text: str) -> int:
        return sum(len(self.pieces(w)) for w in words(text, self.lower))

    def batch(self, texts: list[str], most: int) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """Padded ids, mask and cut flags; the width is the least bucket that holds the longest."""
        got = [self.encode(t, most) for t in texts]
        width = max((len(i) for i, _ in got), default=0)
        width = next((b for b in BUCKETS if b >= width), width)
        ids = np.full((len(got), width), self.pad, np.int64)
        mask = np.zeros((len(got), width), np.int64)
        for r, (i, _) in enumerate(got):
            ids[r, : len(i)], mask[r, : len(i)] = i, 1
        return ids, mask, [c for _, c in got]


def corpus_vocabulary(df: DataFrame, text: str, size: int = 8000) -> list[str]:
    """A vocabulary from a corpus's own words: signs, characters and the commonest words, with continuations. Bounded by ``size``."""
    w = df.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[a-z]+|[^\sa-z]"), F.lit(0))).alias("w"))
    common = [r[0] for r in w.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()]
    chars = sorted({c for x in common for c in x})
    return ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *dict.fromkeys([*chars, *("##" + c for c in chars), *common])]


def wordpiece_counts(df: DataFrame, key: str, text: str, vocabulary: list[str], most: int) -> DataFrame:
    """(``key``, ``tokens``, ``cut``): pieces of each text and whether the model's length cuts it; null counts as empty."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wp = WordPiece(vocabulary)
        for b in batches:
            n = [wp.count(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array([x > most - 2 for x in n])], names=[key, "tokens", "cut"])

    schema = T.StructType([df.schema[key], T.StructField("tokens", T.IntegerType()), T.StructField("cut", T.BooleanType())])
    return df.select(key, text).mapInArrow(of, schema)


def pool(states: np.ndarray, mask: np.ndarray, how: str = "mean") -> np.ndarray:
    """One vector per text of token vectors (texts, tokens, dimensions): the masked mean or the first."""
    if how == "cls":
        return states[:, 0, :].astype(np.float64)
    m = mask[:, :, None].astype(np.float64)
    return (states * m).sum(axis=1) / np.maximum(1.0, m.sum(axis=1))


def layer_norm(v: np.ndarray, epsilon: float = 1e-5) -> np.ndarray:
    d = v - v.mean(axis=1, keepdims=True)
    return d / np.sqrt((d * d).mean(axis=1, keepdims=True) + epsilon)


def l2(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v, dtype=np.float64), where=n > 0)


def mean_pooled(tokens: DataFrame, by: list[str], vector: str, dimensions: int, weight: Column | None = None) -> DataFrame:
    """(``by``, ``pooled``): the mean of the vectors of a group, of length one, as grouped sums per dimension."""
    w = F.lit(1.0) if weight is None else weight
    sums = [F.sum(F.get(vector, F.lit(i)).cast("double") * w).alias(f"_s{i}") for i in range(dimensions)]
    g = tokens.where(F.size(vector) == dimensions).groupBy(*by).agg(*sums, F.sum(w).alias("_w"))
    mean = F.array(*[F.col(f"_s{i}") / F.greatest(F.lit(1.0), F.col("_w")) for i in range(dimensions)])
    return g.select(*by, normalize(mean).alias("pooled"))


Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dimensions: int = 64) -> Embedder:
    """Unit vectors that depend on the text's hash alone: a stand-in for a model, the same everywhere."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.stack([np.random.Generator(np.random.PCG64(xxhash.xxh3_64_intdigest(t))).standard_normal(dimensions) for t in texts]) if texts else np.empty((0, dimensions))
        return l2(out)

    return embed


def embed(df: DataFrame, text: str, embedder: Embedder, dimensions: int, batch: int = 16, prefix: str = "", column: str = "embedding") -> DataFrame:
    """``df`` with ``column``: the vector of each text, null for null.

    A batch that fails is halved until the texts that fail are alone; these raise. Copies are embedded
    again; see ``embed_distinct``.
    """
    keep = [c for c in df.columns if c != column]

    def run(texts: list[str]) -> np.ndarray:
        try:
            return embedder([prefix + t for t in texts])
        except Exception as e:
            if len(texts) == 1:
                raise RuntimeError(f"6206: embedding window failed: {e}") from e
            half = len(texts) // 2
            return np.concatenate([run(texts[:half]), run(texts[half:])])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            there = [t for t in texts if t is not None]
            got = iter([v for lo in range(0, len(there), batch) for v in run(there[lo : lo + batch])])
            out = [None if t is None else np.asarray(next(got), np.float32).tolist() for t in texts]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(out, pa.list_(pa.float32()))], names=[*keep, column])

    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField(column, T.ArrayType(T.FloatType()))])
    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(of, schema)


def embed_distinct(df: DataFrame, text: str, embedder: Embedder, dimensions: int, known: DataFrame | None = None, by: str | None = None, **kw) -> DataFrame:  # noqa: ANN003
    """The same, embedding each text once and none that ``known`` (``hash``, ``embedding``) has.

    ``by``: a column that tells equal texts, by default the text's digest; ``hash`` is of the same kind.
    """
    d = df.withColumn("_h", F.md5(text) if by is None else F.col(by))  # null for null
    todo = d.where(F.col(text).isNotNull()).groupBy("_h").agg(F.min(text).alias("_t"))
    if known is not None:
        known = materialize(known.select(F.col("hash").alias("_h"), "embedding"), "known")
        todo = todo.join(known.select("_h"), "_h", "left_anti")
    made = embed(todo, "_t", embedder, dimensions, **kw).select("_h", "embedding")
    if known is not None:
        made = made.unionByName(known)
    return d.drop("embedding").join(materialize(made, "embedded"), "_h", "left").drop("_h", *([by] if by else []))

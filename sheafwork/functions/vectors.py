"""Vector expressions: distances, scalar functions, codecs and checks, all inside the JVM where Spark can say it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.errors import SheafError

#: Fixed value: the most dimensions of a vector.
MOST_DIMENSIONS = 8192


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in double precision and not below 0; null for a vector of zeros or another length."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), F.greatest(F.lit(0.0), 1 - dot(a, b) / n))


def l2_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(d)))


def l1_distance(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))))


def hamming_distance(a: Column, b: Column) -> Column:
    """Bits in which two packed vectors (arrays of whole numbers of 8 bits) differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


#: Names of distance functions.
DISTANCES = {"cosine": cosine_distance, "cosinedistance": cosine_distance, "l2": l2_distance, "euclideandistance": l2_distance, "l1": l1_distance, "manhattandistance": l1_distance, "hamming": hamming_distance}


def distance(name: str, a: Column, b: Column) -> Column:
    f = DISTANCES.get(name.lower())
    if f is None:
        raise SheafError(5209, name)
    return f(a, b)


def normalize(v: Column) -> Column:
    """``v`` scaled to length one; zeros stay."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def length(v: Column) -> Column:
    """The number of dimensions; null for null."""
    return F.when(v.isNotNull(), F.size(v))


def to_json(v: Column) -> Column:
    return F.to_json(v)


def sign_bits(v: Column) -> Column:
    """A vector as bits, one for each positive component, packed in bytes with the first one lowest."""
    bit = lambda i: F.coalesce((F.get(v, i) > 0).cast("int"), F.lit(0))
    byte = lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda s, j: s + F.shiftleft(F.lit(1), 0) * bit(k * 8 + j) * F.pow(F.lit(2), j).cast("int"))
    return F.transform(F.sequence(F.lit(0), ((F.size(v) + 7) / 8).cast("int") - 1), byte)


def checked(v: Column, dimensions: int) -> Column:
    """``v``, with an error at run time where it hasn't ``dimensions`` components; null stays null."""
    if not 1 <= dimensions <= MOST_DIMENSIONS:
        raise SheafError(5208, str(dimensions))
    bad = F.raise_error(F.concat(F.lit(f"5212: wrong number of dimensions, {dimensions} wanted, found "), F.size(v).cast("string")))
    return F.when(F.size(v) == dimensions, v).when(v.isNull(), F.lit(None)).otherwise(bad.cast(T.ArrayType(T.FloatType())))


@F.pandas_udf(T.BinaryType())
def encode_float32(v: pd.Series) -> pd.Series:
    """Vectors as little-endian 32-bit floats."""
    return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType(), False))
def decode_float32(b: pd.Series) -> pd.Series:
    def one(x: bytes | None):  # noqa: ANN202
        if x is None:
            return None
        if len(x) % 4:
            raise ValueError("5212: the length is no multiple of four bytes")
        return np.frombuffer(x, dtype="<f4")

    return b.map(one)


@F.pandas_udf(T.BinaryType())
def encode_int8(v: pd.Series) -> pd.Series:
    """Vectors as one signed byte a component, rounded and clipped."""
    return v.map(lambda x: None if x is None else np.clip(np.rint(np.asarray(x, dtype=np.float64)), -128, 127).astype(np.int8).tobytes())


@F.pandas_udf(T.ArrayType(T.IntegerType(), False))
def decode_int8(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else np.frombuffer(x, dtype=np.int8).astype(np.int32))


@F.pandas_udf(T.BinaryType())
def encode_bits(v: pd.Series) -> pd.Series:
    """Positive components as bits, the first one lowest in its byte; the number must be a multiple of eight."""

    def one(x):  # noqa: ANN001, ANN202
        if x is None:
            return None
        if len(x) % 8:
            raise ValueError("5212: the number of bits is no multiple of eight")
        return np.packbits(np.asarray(x) > 0, bitorder="little").tobytes()

    return v.map(one)


@F.pandas_udf(T.ArrayType(T.IntegerType(), False))
def decode_bits(b: pd.Series) -> pd.Series:
    return b.map(lambda x: None if x is None else np.unpackbits(np.frombuffer(x, dtype=np.uint8), bitorder="little").astype(np.int32))

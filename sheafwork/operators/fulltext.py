"""Full-text search: tokenizers, a persisted inverted index, phrase matching and BM25.

An index is a versioned table of postings, sorted by term, with the number of documents and tokens in its manifest. A search
reads the terms that it asks for: the filter on the term is pushed to the scan, which skips row groups by their
least and greatest term. ``match`` and ``bm25`` do the same to a table without an index, by reading its texts.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.runtime import materialize, small_enough
from sheafwork.sources.versioned import VersionedTable

#: BM25's constants, and the least inverse document frequency.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: The term under which an index keeps each document's length.
LENGTH = ""


@lru_cache(maxsize=3)
def folding(diacritics: int) -> tuple[str, str]:
    """Characters and what they are folded to (those beyond the second string's end go): letters with one diacritic (1), or with any (2), to their base, and marks."""
    letters = []
    for i in [*range(0xC0, 0x500), *range(0x1E00, 0x2000)]:
        d = unicodedata.normalize("NFD", chr(i))
        if len(d) > 1 and all(0x300 <= ord(m) <= 0x36F for m in d[1:]) and (len(d) == 2 or diacritics == 2):
            letters.append((chr(i), d[0]))
    return "".join(x for x, _ in letters) + "".join(map(chr, range(0x300, 0x370))), "".join(y for _, y in letters)


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(tokens: pd.Series) -> pd.Series:
    from sheafwork.functions.porter import stem

    return tokens.map(lambda ts: None if ts is None else [stem(t) for t in ts])


def tokens(text: Column, tokenizer: str = "unicode61", diacritics: int = 1) -> Column:
    """The tokens of a text, in order; null gives none.

    ``unicode61``: runs of letters and digits, lower case; ``diacritics`` 0 keeps them, 1 folds letters with one, 2 those
    with several, too. ``ascii``: case folds and parts words in ASCII only. ``porter``: ``unicode61``,
    stemmed. ``trigram``: every three characters in lower case. All but ``porter`` stay inside the JVM.
    """
    t = F.coalesce(text, F.lit(""))
    if tokenizer == "trigram":
        t = F.lower(t)
        return F.when(F.length(t) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    if tokenizer == "ascii":
        t = F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return F.regexp_extract_all(t, F.lit(r"[0-9a-z\x{80}-\x{10FFFF}]+"), F.lit(0))
    if tokenizer == "porter":
        return stemmed(tokens(text, diacritics=diacritics))
    if tokenizer != "unicode61":
        raise ValueError(f"unknown tokenizer {tokenizer!r}")
    t = F.lower(F.translate(t, *folding(diacritics)) if diacritics else t)
    return F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def keyword_tokens(spark: SparkSession, keywords: list[str], tokenizer: str = "unicode61", diacritics: int = 1) -> list[list[str]]:
    """Each keyword as a phrase of tokens, by the same tokenizer; one without tokens matches nothing."""
    one = spark.createDataFrame([(i, k) for i, k in enumerate(keywords)], "i int, k string")
    got = one.select("i", tokens(F.col("k"), tokenizer, diacritics).alias("t")).collect()  # as many rows as keywords
    return [list(r[1]) for r in sorted(got)]


def phrase_count(toks: Column, phrase: list[str]) -> Column:
    """How often a phrase stands in an array of tokens."""
    if not phrase:
        return F.lit(0)
    if len(phrase) == 1:
        return F.size(F.filter(toks, lambda t: t == phrase[0]))
    # tokens hold no space, so a phrase is a run between spaces; the look-ahead counts overlapping ones
    return F.regexp_count(F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" ")), F.lit("(?= " + " ".join(re.escape(p) for p in phrase) + " )"))


def match(df: DataFrame, keywords: list[str], text: str, key: str = "key", match_all: bool = False, tokenizer: str = "unicode61", diacritics: int = 1) -> DataFrame:
    """(``key``, ``length``, ``tf``): rows with any keyword, or with all; ``tf`` has a count per keyword."""
    ph = keyword_tokens(df.sparkSession, keywords, tokenizer, diacritics)
    t = df.select(key, tokens(F.col(text), tokenizer, diacritics).alias("_t")).select(key, F.size("_t").alias("length"), F.array(*[phrase_count(F.col("_t"), p) for p in ph]).alias("tf"))
    return t.where(_has(match_all))


def _has(match_all: bool) -> Column:
    return F.forall("tf", lambda x: x > 0) if match_all else F.exists("tf", lambda x: x > 0)


def _ranked(hits: DataFrame, frequencies: DataFrame, n: int, key: str) -> DataFrame:
    """``frequencies``: one row with the number of documents ``_n``, their average length ``_avg`` and ``_df``, in how many each keyword is."""
    j = hits.crossJoin(F.broadcast(frequencies))  # one row

    def part(i: int) -> Column:
        d, f = F.get("_df", F.lit(i)).cast("double"), F.get("tf", F.lit(i)).cast("double")
        idf = F.log((F.col("_n") - d + 0.5) / (d + 0.5))
        idf = F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF))
        return idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("length") / F.col("_avg")))

    return j.select(key, (-reduce(lambda a, b: a + b, [part(i) for i in range(n)])).alias("rank"))


def bm25(df: DataFrame, keywords: list[str], text: str, key: str = "key", match_all: bool = False, tokenizer: str = "unicode61", diacritics: int = 1) -> DataFrame:
    """(``key``, ``rank``): matching rows with the negative BM25 score, so that lower is better.

    Number, average length and document frequencies are those of all rows of ``df``; a keyword's inverse
    document frequency is at least ``LEAST_IDF``.
    """
    ph = keyword_tokens(df.sparkSession, keywords, tokenizer, diacritics)
    t = df.select(key, tokens(F.col(text), tokenizer, diacritics).alias("_t")).select(key, F.size("_t").alias("length"), F.array(*[phrase_count(F.col("_t"), p) for p in ph]).alias("tf"))
    stats = t.agg(F.count("*").alias("_n"), F.avg("length").alias("_avg"), F.array(*[F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(len(ph))]).alias("_df"))
    return _ranked(t.where(_has(match_all)), stats, len(ph), key)


def postings(df: DataFrame, text: str, key: str = "key", tokenizer: str = "unicode61", diacritics: int = 1) -> DataFrame:
    """(``term``, ``key``, ``tf``, ``length``, ``positions``): the inverted index, with a row under ``LENGTH`` for every document.
    """
    t = df.select(key, tokens(F.col(text), tokenizer, diacritics).alias("_t"))
    each = t.select(key, F.size("_t").alias("length"), F.posexplode("_t").alias("_at", "term"))
    rows = each.groupBy("term", key).agg(F.count("*").cast("int").alias("tf"), F.first("length").alias("length"), F.sort_array(F.collect_list("_at")).alias("positions"))
    return rows.unionByName(t.select(F.lit(LENGTH).alias("term"), key, F.lit(0).alias("tf"), F.size("_t").alias("length"), F.lit(None).cast("array<int>").alias("positions")))


class TextIndex:
    """The inverted index of one text column, under ``root``.

    Keys are unique; null texts count as empty. A keyword is a term or a phrase; one that ends with ``*`` matches every term that begins
    so, as the last one of its phrase. An update replaces the documents it brings, in one commit with the totals.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "key", tokenizer: str = "unicode61", diacritics: int = 1):
        self.spark, self.key, self.tokenizer, self.diacritics = spark, key, tokenizer, diacritics
        self.table = VersionedTable(spark, root)

    def _totals(self) -> tuple[int, int]:
        p = self.table.properties() if self.table.version() else {}
        return int(p.get("documents", "0")), int(p.get("tokens", "0"))

    def _leaving(self, keys: DataFrame) -> tuple[int, int]:
        if not self.table.version():
            return 0, 0
        r = self.table.read().where(F.col("term") == LENGTH).join(small_enough(keys), self.key, "left_semi").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        return r[0], r[1]

    def update(self, df: DataFrame, text: str) -> int:
        """Put in or replace the documents of ``df``."""
        p = materialize(postings(df, text, self.key, self.tokenizer, self.diacritics).repartitionByRange("term", self.key).sortWithinPartitions("term", self.key), "postings")
        keys = p.where(F.col("term") == LENGTH).select(self.key)
        n, tokens_ = self._totals()
        gone_n, gone_tokens = self._leaving(keys)
        new_n, new_tokens = p.where(F.col("term") == LENGTH).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        totals = {"documents": str(n - gone_n + new_n), "tokens": str(tokens_ - gone_tokens + new_tokens)}
        return self.table.commit(add=p, delete_keys=keys if gone_n else None, properties=totals)

    def delete(self, keys: DataFrame) -> int:
        keys = materialize(keys.select(self.key).distinct(), "gone")
        n, tokens_ = self._totals()
        gone_n, gone_tokens = self._leaving(keys)
        return self.table.commit(delete_keys=keys, properties={"documents": str(n - gone_n), "tokens": str(tokens_ - gone_tokens)})

    def match(self, keywords: list[str], match_all: bool = False) -> DataFrame:
        """(``key``, ``length``, ``tf``): documents with any keyword, or with all; ``tf`` has a count per keyword."""
        phrases = keyword_tokens(self.spark, [k.rstrip("* ") for k in keywords], self.tokenizer, self.diacritics)
        begins = [k.rstrip().endswith("*") for k in keywords]
        asked = [(i, o, len(p), t, begins[i] and o == len(p) - 1) for i, p in enumerate(phrases) for o, t in enumerate(p)]
        whole = sorted({t for *_, t, b in asked if not b})
        cond = F.col("term").isin(whole)
        for *_, t, b in asked:
            if b:
                cond = cond | F.col("term").startswith(t)
        rows = self.table.read().where(cond & (F.col("term") != LENGTH))
        q = F.broadcast(self.spark.createDataFrame(asked, "_i int, _o int, _k int, _t string, _b boolean"))  # a row per word asked for
        r = rows.join(q, F.when(F.col("_b"), F.col("term").startswith(F.col("_t"))).otherwise(F.col("term") == F.col("_t")))
        single = r.where("_k = 1").groupBy(self.key, "_i").agg(F.sum("tf").alias("n"), F.first("length").alias("length"))
        runs = r.where("_k > 1").select(self.key, "_i", "_k", "_o", "length", F.explode("positions").alias("_at")).groupBy(self.key, "_i", "_k", (F.col("_at") - F.col("_o")).alias("_from"))
        several = runs.agg(F.count_distinct("_o").alias("_found"), F.first("length").alias("length")).where("_found = _k").groupBy(self.key, "_i").agg(F.count("*").alias("n"), F.first("length").alias("length"))
        per = single.unionByName(several).groupBy(self.key).agg(F.first("length").alias("length"), *[F.coalesce(F.max(F.when(F.col("_i") == i, F.col("n"))), F.lit(0)).cast("int").alias(f"_f{i}") for i in range(len(keywords))])
        return per.select(self.key, "length", F.array(*[F.col(f"_f{i}") for i in range(len(keywords))]).alias("tf")).where(_has(match_all))

    def bm25(self, keywords: list[str], match_all: bool = False) -> DataFrame:
        """(``key``, ``rank``), as the function of that name, with the statistics of all documents of the index."""
        hits = materialize(self.match(keywords), "hits")
        n, tokens_ = self._totals()
        stats = hits.agg(F.lit(n).alias("_n"), F.lit(tokens_ / max(1, n)).alias("_avg"), F.array(*[F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(len(keywords))]).alias("_df"))
        return _ranked(hits.where(_has(match_all)), stats, len(keywords), self.key)

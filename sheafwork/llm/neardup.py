"""Near-duplicate texts: one-permutation hashing, banded buckets, star-shaped candidate edges.

Plan, for texts of any number:

1. Texts become their words joined by single spaces, inside the JVM, and are written once. Equal
   ones form a class; from here on a class is one row, so copies cost nothing further.
2. Each class gets one signature of ``bins`` values: every shingle is hashed once, its hash picks
   the bin and the bin keeps the least. An empty bin borrows from a bin chosen by a hash of its
   number and the attempt (optimal densification), so that short texts keep independent bands.
3. ``rows`` consecutive bins make a band; a band's hash names a bucket. Hubs (the least id) and
   sizes of buckets are a grouped minimum and count, merged before the shuffle, so no bucket is
   ever gathered in one task.
4. Edges are stars: the ``hubs`` least members of each bucket, whatever its size, are each joined with
   the members after them, so candidates grow with the rows. Two members that aren't hubs may be
   alike, too: those of all buckets go through an exact prefix-filter join, which loses no pair.
5. Candidates are made distinct and checked on the hashes of their shingles, in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.runtime import materialize, small_enough

EMPTY = np.uint64(2**64 - 1)
#: Odd 64-bit multipliers for mixing.
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: Words whose hashes a worker keeps.
KEPT_WORDS = 500_000
#: In lists of pairs each key of a class stands with so many that follow it, and a class with so many of its least keys in links.
SPAN = 64


def words(text):  # noqa: ANN001, ANN201
    """Column: the longest runs of letters and digits, in lower case, joined by a space; null for null."""
    return F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


def word_count(norm):  # noqa: ANN001, ANN201
    """Column: how many words ``words`` has found."""
    return F.when(norm == "", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[3]
    x = (x ^ (x >> np.uint64(27))) * MIX[4]
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str], kept: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and where each text ends."""
    flat: list[int] = []
    ends = np.empty(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        for w in t.split(" "):
            h = kept.get(w)
            if h is None:
                if len(kept) >= KEPT_WORDS:
                    kept.clear()
                h = kept[w] = xxhash.xxh3_64_intdigest(w)
            flat.append(h)
        ends[i] = len(flat)
    return np.array(flat, dtype=np.uint64), ends


def shingle_hashes(texts: list[str], size: int, kept: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and the number of the text each belongs to."""
    w, ends = word_hashes(texts, kept)
    n = len(w) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            h = mixed(h * MIX[0] + w[k : k + n])
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    whole = owner[:n] == owner[size - 1 :]
    return h[whole], owner[:n][whole]


def signatures(h: np.ndarray, owner: np.ndarray, texts: int, bins: int) -> np.ndarray:
    """One-permutation signatures with optimal densification; a text without shingles stays ``EMPTY``."""
    sig = np.full(texts * bins, EMPTY, dtype=np.uint64)
    at = owner * bins + (h % np.uint64(bins)).astype(np.int64)
    np.minimum.at(sig, at, h // np.uint64(bins))
    raw = sig.reshape(texts, bins)
    full = raw.copy()
    row, col = np.nonzero((raw == EMPTY) & (raw != EMPTY).any(axis=1)[:, None])
    attempt = 0
    with np.errstate(over="ignore"):
        while len(row):
            attempt += 1
            donor = (mixed(np.arange(bins, dtype=np.uint64) * MIX[0] + np.uint64(attempt) * MIX[1]) % np.uint64(bins)).astype(np.int64)
            got = raw[row, donor[col]]
            ok = got != EMPTY
            full[row[ok], col[ok]] = got[ok]
            row, col = row[~ok], col[~ok]
    return full


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """A bucket's name for each text and band; the band's number is mixed in."""
    n = sig.shape[1] // rows
    x = sig[:, : n * rows].reshape(len(sig), n, rows)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64) * MIX[2], (len(sig), n)).copy()
        for k in range(rows):
            h = mixed(h * MIX[0] + x[:, :, k])
    return h.view(np.int64)


def bucket_rows(classes: DataFrame, size: int, bins: int, rows: int) -> DataFrame:
    """(``bucket``, ``id``) for each class and band. ``classes``: ``id``, ``norm``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, int] = {}
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for lo in range(0, len(texts), 2000):
                part = texts[lo : lo + 2000]
                h, owner = shingle_hashes(part, size, kept)
                names = bands(signatures(h, owner, len(part), bins), rows)
                has = np.bincount(owner, minlength=len(part)) > 0
                names, own = names[has], ids[lo : lo + 2000][has]
                yield pa.RecordBatch.from_arrays([pa.array(names.ravel()), pa.array(np.repeat(own, names.shape[1]))], names=["bucket", "id"])

    return classes.select("id", "norm").mapInArrow(of, "bucket long, id long")


def shingle_sets(classes: DataFrame, size: int) -> DataFrame:
    """(``id``, ``s``): the distinct hashes of each class's shingles, in order. ``classes``: ``id``, ``norm``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, int] = {}
        for b in batches:
            texts = b.column(1).to_pylist()
            h, owner = shingle_hashes(texts, size, kept)
            h = h.view(np.int64)
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            h, owner = h[new], owner[new]
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(h))], names=["id", "s"])

    return classes.select("id", "norm").mapInArrow(of, "id long, s array<long>")


def prefix_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(``a``, ``b``): every pair of classes that may reach the similarity, by an exact prefix filter.

    ``sets``: ``id``, ``s``. Two sets with similarity ``least`` share one of their first n - ceil(least n) + 1
    shingles under any common order; the order here is rarest first.
    """
    from pyspark.sql import Window

    sh = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("s"))
    df = sh.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")  # what only one has makes no pair, but ranks first
    w = Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(1)), "s")
    ranked = sh.join(df, "s", "left").withColumn("at", F.row_number().over(w))
    p = ranked.where(F.col("df").isNotNull() & (F.col("at") <= F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)) + 1)).select("s", "id", "n")
    a, b = p.alias("a"), p.alias("b")
    near = (F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * F.lit(least) - F.lit(1e-9))
    return a.join(b, (F.col("a.s") == F.col("b.s")) & near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def star_edges(rows: DataFrame, hubs: int) -> tuple[DataFrame, DataFrame]:
    """((``a``, ``b``) with a < b, not yet distinct, and the ``id`` of those that share a bucket without being its hubs). ``rows``: ``bucket``, ``id``, materialised."""
    from pyspark.sql import Window

    met = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "met")
    shared = materialize(rows.join(small_enough(met), "bucket"), "shared")
    # the limit on the rank is applied in every task before rows move, so no bucket is sorted as a whole
    first = shared.withColumn("at", F.row_number().over(Window.partitionBy("bucket").orderBy("id"))).where(F.col("at") <= hubs)
    first = materialize(first.select("bucket", F.col("id").alias("hub"), "at"), "hubs")
    edges = shared.join(small_enough(first), "bucket").where("id > hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    last = small_enough(materialize(first.where(F.col("at") == hubs).select("bucket", "hub"), "last"))
    return edges, shared.where(F.col("n") > hubs + 1).join(last, "bucket").where("id > hub").select("id").distinct()


def checked(candidates: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(``a``, ``b``, ``similarity``) of the candidates that reach ``least``; ``sets``: ``id``, ``s``."""
    cand = materialize(candidates.distinct(), "candidates")
    x = sets.select(F.col("id").alias("a"), F.col("s").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("s").alias("y"))
    # sizes alone rule many out before the sets are compared
    small, large = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    j = cand.join(x, "a").join(y, "b").where((small >= large * F.lit(least) - F.lit(1e-9)) & (small > 0))
    both = F.size(F.array_intersect("x", "y"))
    return j.select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("similarity")).where(F.col("similarity") >= least - 1e-12)


class NearDuplicates:
    """Classes of equal texts and the links between classes, of a whole table.

    ``df``: any columns; ``key`` names a unique key (rows written twice with one key count
    once, those with a null key are left out), ``text`` the text. Texts of fewer than
    ``least_words`` words, null and empty ones take no part. An empty table gives empty
    results. The defaults of ``shingle`` and ``similarity`` are those for general use; with
    36 bands of 5 rows a pair at similarity 0.7 is met with probability 0.9987, at 0.8 with
    0.999999.
    """

    def __init__(self, df: DataFrame, key: str = "key", text: str = "text", shingle: int = 5, similarity: float = 0.8, least_words: int | None = None, bins: int = 180, rows: int = 5, hubs: int = 16):
        self.size, self.least, self.bins, self.rows, self.hubs = shingle, similarity, bins, rows, hubs
        base = df.select(F.col(key).alias("key"), words(F.col(text)).alias("norm")).where(F.col("key").isNotNull())
        base = base.where(word_count(F.col("norm")) >= max(shingle, least_words or 0))
        # the digest is the class; words are found once and written, since classes and members both need them
        self.base = materialize(base.select("key", F.md5("norm").alias("digest"), "norm"), "words")
        cls = self.base.groupBy("digest").agg(F.min("key").alias("rep"), F.max("key").alias("last"), F.min("norm").alias("norm"))  # the least key stands for the class
        self.classes = materialize(cls.withColumn("id", F.xxhash64("digest")), "classes")

    def links(self) -> DataFrame:
        """(``rep_a``, ``rep_b``, ``similarity``): links between classes, by their representatives."""
        rows = materialize(bucket_rows(self.classes, self.size, self.bins, self.rows), "buckets")
        stars, several = star_edges(rows, self.hubs)
        stars, several = materialize(stars, "stars"), materialize(several, "several")
        ids = materialize(stars.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
        sets = materialize(shingle_sets(self.classes.join(small_enough(ids), "id", "left_semi"), self.size), "sets")
        exact = prefix_pairs(sets.join(small_enough(several), "id", "left_semi"), self.least)
        ok = materialize(checked(stars.unionByName(exact), sets, self.least), "links")
        need = materialize(ok.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "linked")
        reps = self.classes.select("id", "rep").join(small_enough(need), "id", "left_semi")
        j = ok.join(reps.select(F.col("id").alias("a"), F.col("rep").alias("x")), "a").join(reps.select(F.col("id").alias("b"), F.col("rep").alias("y")), "b")
        return j.select(F.least("x", "y").alias("rep_a"), F.greatest("x", "y").alias("rep_b"), "similarity").distinct()

    def members(self) -> DataFrame:
        """(``rep``, ``key``) for every row that takes part, once a key."""
        keys = self.base.select("digest", "key").distinct()
        return keys.join(self.classes.select("digest", "rep"), "digest").select("rep", "key")

    def copies(self) -> DataFrame:
        """(``rep``, ``key``, ``at``): the members of classes with more than one key, numbered by key from 0 within their class."""
        many = materialize(self.classes.where(F.col("rep") != F.col("last")).select("digest", "rep"), "many")
        keys = self.base.select("digest", "key").join(small_enough(many), "digest").select("rep", "key").distinct()
        return materialize(numbered(keys, "rep", "key", "at"), "copies")

    def pairs(self) -> DataFrame:
        """(``key_a``, ``key_b``): pairs of keys with key_a < key_b.

        In a class, every key stands with the ``SPAN`` that follow it, so of up to ``SPAN`` + 1 copies all
        pairs are listed, and of more those that lie no farther apart. Two linked classes stand with
        the least ``SPAN`` keys of each. All other pairs follow from these; ``groups`` has every key once.
        """
        copies = self.copies()
        ahead = copies.select("rep", F.col("key").alias("key_a"), F.explode(F.sequence(F.col("at") + 1, F.col("at") + SPAN)).alias("at"))
        own = ahead.join(copies, ["rep", "at"]).select("key_a", F.col("key").alias("key_b"))
        first = materialize(copies.where(F.col("at") < SPAN).select("rep", "key"), "first")
        side = lambda n: small_enough(first).select(F.col("rep").alias(f"rep_{n}"), F.col("key").alias(f"k_{n}"))
        ln = self.links().join(side("a"), "rep_a", "left").join(side("b"), "rep_b", "left")
        x, y = F.coalesce("k_a", "rep_a"), F.coalesce("k_b", "rep_b")
        return own.unionByName(ln.select(F.least(x, y).alias("key_a"), F.greatest(x, y).alias("key_b")))

    def groups(self) -> DataFrame:
        """(``key``, ``class_id``, ``group_id``, ``links``): one row per key that takes part.

        ``class_id`` is the least key with the same words, ``group_id`` the least key of all
        texts that a chain of links connects, ``links`` the number of linked classes.
        """
        ln = materialize(self.links(), "ends")
        deg = ln.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
        comp = components(ln.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
        m = self.members().join(deg, "rep", "left").join(comp, "rep", "left")
        return m.select("key", F.col("rep").alias("class_id"), F.coalesce("group_id", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def numbered(df: DataFrame, by: str, order: str, to: str) -> DataFrame:
    """``df`` with ``to``: the number of each row from 0 within ``by``, in ``order``.

    Rows are ranged by (``by``, ``order``) into parts of bounded size, so that a group with a third of all
    rows isn't sorted in one task; a row's number is its place in its part and what parts before it have.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(max(least, 1), by, order).sortWithinPartitions(by, order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranged")  # parts are made once: a second evaluation might cut them elsewhere
    per = ranged.groupBy(by, "_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    w = Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    base = per.select(by, "_p", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return ranged.join(base, [by, "_p"]).withColumn(to, (F.col("_before") + F.col("_i") - F.col("_first")).cast("long")).drop("_p", "_i", "_first", "_before")


def components(edges: DataFrame) -> DataFrame:
    """(``rep``, ``group_id``): connected components by alternating large and small stars.

    Each round is two grouped minima; the number of rounds grows with the logarithm of the
    longest chain. Every round is written out, so that lineage stays short.
    """
    e = edges.where("a <> b").distinct()
    e = materialize(e, "edges")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = materialize(large, "large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        small = materialize(small, "small")
        if small.count() == e.count() and small.exceptAll(e).isEmpty():
            return small.select(F.col("b").alias("rep"), F.col("a").alias("group_id")).unionByName(small.select(F.col("a").alias("rep"), F.col("a").alias("group_id")).distinct())
        e = small


def near_duplicates(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    chunks = spark.read.parquet(f"{sf_dir}/ingested_chunk.parquet")
    return NearDuplicates(chunks, shingle=3, similarity=0.7, least_words=8)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks with at least 8 words each and a similarity of at least 0.7 on three-word shingles."""
    return near_duplicates(spark, sf_dir).pairs()


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk with its class of equal texts and its group of nearly equal ones."""
    return near_duplicates(spark, sf_dir).groups()


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk with its class of equal texts."""
    return near_duplicates(spark, sf_dir).members().select("key", F.col("rep").alias("class_id"))

"""The k most similar vectors of every vector: a forest of sorted arrays of long hash strings.

Each tree hashes a vector to a string of hyperplane signs; the tree is the sorted array of all
strings. Descending, a vector finds the longest prefix that it shares with others, in its own
neighbourhood of the array. Ascending, prefixes are cut shorter, in all trees by the same steps at once, until the
stretches of entries that share the prefix hold ``candidates`` entries together; these are ranked
by distance. How many candidates it takes is measured, not assumed.

Plan:

1. Keys with equal vectors are one class. A bounded sample (``sample`` classes) gives the planes, each
   through a point of the sample, so that dense regions are cut most, and the cut points of each
   tree's array into parts of about ``PART`` entries. Every class is then indexed, by one vector.
2. Descent: (tree, part, string) is shuffled and sorted. Every entry learns, for each power of two, the longest
   prefix that so many entries share. A class's ladder is these lengths over all trees.
3. Calibration: for ``queries`` classes of each collection the true neighbours are found among all
   classes. The least number of candidates whose ascent meets the share ``recall`` of them holds for
   the collection.
4. Ascent: the ladder gives each class the prefix length at which all trees together
   offer that many. One row per class and tree, with the vector in one byte a component, is
   shuffled to its part and sorted there; distances to the stretch with the same prefix are matrix products. Of
   each class and tree those go on that can be among the nearest k and within the distance asked for,
   whatever error the coding has made.
5. They are merged over trees and computed again from the stored vectors. The least keys of the
   classes met, and of a class itself, are ranked by distance and key: k + 1 are enough for any
   class, since a key leaves out only itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafwork.runtime import materialize, small_enough

#: Distance functions and their short names.
METRICS = {"cosinedistance": "cos", "euclideandistance": "l2", "manhattandistance": "l1"}
#: Bits of a hash string, and how many of them come from hyperplanes; the rest parts vectors with equal signs.
BITS, SIGN_BITS = 63, 40
#: Entries of a part of a tree, on average, and how many times the entries that an ascent collects in a tree a part holds at least.
PART, REACHES = 16_384, 8
#: Rows and columns of a block of distances.
BLOCK, COLUMNS = 256, 8192


@dataclass(frozen=True)
class Profile:
    """What a collection's vectors must be, how they are compared and how far a neighbour may be."""

    dimensions: int
    metric: str
    k: int
    within: float | None


@dataclass
class Index:
    """A collection's index parameters: number, profile, trees, seed and offsets of the planes, cut points per tree."""

    number: int
    profile: Profile
    trees: int
    seed: int
    offsets: np.ndarray
    sampled: np.ndarray  # the sample's strings, sorted by tree
    cuts: np.ndarray

    def cut(self, parts: int) -> None:
        """Cut every tree into parts that hold equal shares of the sample."""
        n = len(self.sampled)
        parts = max(1, min(n, parts))
        self.cuts = self.sampled[(np.arange(1, parts) * n) // parts].T.copy()


@lru_cache(maxsize=64)
def planes(seed: int, number: int, trees: int, dims: int) -> np.ndarray:
    """Directions of the hyperplanes of a collection, made where they are needed."""
    return np.random.default_rng((seed, number)).standard_normal((trees * SIGN_BITS, dims)).astype(np.float32)


def matrix(col: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors of a list column and their row numbers: ``dims`` finite numbers, not all zero."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    off = col.offsets.to_numpy()
    ok = (np.diff(off) == dims) & col.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(ok)
    if not n or not len(rows) or not dims:
        return np.empty((0, dims), np.float32), rows[:0]
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float32)  # a null component becomes NaN
    x = flat[off[rows][:, None] + np.arange(dims)]
    good = np.isfinite(x).all(axis=1) & x.any(axis=1)
    return x[good], rows[good]


def placed(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as the trees see them: of length one where only the angle counts."""
    if metric != "cos":
        return x
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def strings(x: np.ndarray, ids: np.ndarray, ix: Index) -> np.ndarray:
    """(vectors, trees) hash strings as integers: hyperplane signs, then bits of the id."""
    w = planes(ix.seed, ix.number, ix.trees, ix.profile.dimensions)
    signs = (x @ w.T > ix.offsets).reshape(len(x), ix.trees, SIGN_BITS)
    h = signs @ (np.int64(1) << np.arange(SIGN_BITS - 1, -1, -1, dtype=np.int64))
    odd = np.uint64(0x9E3779B97F4A7C15) * (2 * np.arange(ix.trees, dtype=np.uint64) + np.uint64(1))
    tail = ((ids.view(np.uint64)[:, None] * odd) >> np.uint64(64 - (BITS - SIGN_BITS))).astype(np.int64)
    return (h << np.int64(BITS - SIGN_BITS)) | tail


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of strings."""
    x = np.bitwise_xor(a, b)
    _, e = np.frexp(x.astype(np.float64))  # rounding up to a power of two takes one bit at most, from differing strings
    e = np.where((x > 0) & ((x >> np.maximum(e - 1, 0).astype(np.int64)) == 0), e - 1, e)
    return (BITS - np.where(x == 0, 0, e)).astype(np.uint8)


def ladders(h: np.ndarray, steps: int) -> np.ndarray:
    """(entries, steps): the longest prefix that 2**j entries of the sorted array share with each entry; 0 if there aren't so many."""
    n = len(h)
    gap = common(h[:-1], h[1:]) if n > 1 else np.empty(0, np.uint8)
    out = np.zeros((n, steps), np.uint8)
    out[:, 0] = BITS
    low = np.full(n, BITS, np.uint8)  # least common prefix of the window of 2**j entries that starts here
    for j in range(1, steps):
        half, width = 1 << (j - 1), 1 << j
        if width > n:
            break
        starts = n - width + 1
        low = np.minimum(np.minimum(low[:starts], low[half : half + starts]), gap[half - 1 : half - 1 + starts])
        # the best window that holds an entry: a running maximum over the width, by doubling
        best = np.zeros(n, np.uint8)
        best[:starts] = low
        done = 1
        while done < width:
            step = min(done, width - done)
            best[step:] = np.maximum(best[step:], best[:-step].copy())
            done += step
        out[:, j] = best
    return out


def ascent(ladder: np.ndarray, candidates: int) -> np.ndarray:
    """The longest prefix at which all trees together offer ``candidates`` entries. ``ladder``: (classes, trees, steps)."""
    low, high = np.zeros(len(ladder), np.int64), np.full(len(ladder), BITS, np.int64)
    while (low < high).any():
        mid = (low + high + 1) // 2
        offered = (np.int64(1) << np.maximum((ladder >= mid[:, None, None].astype(np.uint8)).sum(axis=2) - 1, 0)).sum(axis=1)
        ok = offered >= candidates
        low, high = np.where(ok, mid, low), np.where(ok, high, np.maximum(mid - 1, low))
    return low.astype(np.uint8)


def exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of paired rows, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    if metric == "cos":
        return 1 - (a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
    return np.sqrt(((a - b) ** 2).sum(1)) if metric == "l2" else np.abs(a - b).sum(1)


def block_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances of two blocks, in single precision."""
    if metric == "l1":
        out = np.zeros((len(a), len(b)), np.float32)
        for j in range(a.shape[1]):
            out += np.abs(a[:, j, None] - b[None, :, j])
        return out
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    np.maximum(d, 0, out=d)
    return np.sqrt(d)


def margins(x: np.ndarray, coded: np.ndarray, metric: str) -> np.ndarray:
    """How far each vector's coding and single precision may move its distances, at most.

    By the triangle inequality a pair's distance moves by no more than both vectors' coding errors.
    Rounding adds (dims + 8) / 2**24 of both lengths to a sum of differences, and of the square of
    both lengths to a squared distance. Of unit vectors (cosine) the distance meant is the chord.
    """
    x, coded, unit = x.astype(np.float64), coded.astype(np.float64), (x.shape[1] + 8) / 2**24
    if metric == "l1":
        m = np.abs(x - coded).sum(1) + unit * (np.abs(coded).sum(1) + np.abs(x).sum(1))
    else:
        m = np.linalg.norm(x - coded, axis=1) + np.sqrt(unit) * (np.linalg.norm(coded, axis=1) + np.linalg.norm(x, axis=1))
    return np.nextafter(m.astype(np.float32), np.float32(np.inf))


def near_in_block(x: np.ndarray, ids: np.ndarray, margin: np.ndarray, first: int, last: int, lo: int, hi: int, inside: np.ndarray, most: int, within: float, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """For rows first..last, all of rows lo..hi (where ``inside``) that can be among the ``most`` nearest of them.

    Left out are only rows that aren't within the bound, or that ``most`` others are nearer than, whatever the coding errors are.
    """
    m = margin[first:last, None] + margin[None, lo:hi]
    if metric == "l1" and np.isfinite(within):
        # a sum of differences is at least the Euclidean distance, which is a matrix product
        norm = np.sqrt((x.shape[1] + 8) / 2**24) * np.linalg.norm(x[lo:hi], axis=1)
        slack = m + np.sqrt((x.shape[1] + 8) / 2**24) * np.linalg.norm(x[first:last], axis=1)[:, None] + norm[None]
        r, c = np.nonzero(inside & (block_distances(x[first:last], x[lo:hi], "l2") - slack <= within))
        d = np.full(inside.shape, np.inf, np.float32)
        for k in range(0, len(r), 1 << 16):
            d[r[k : k + (1 << 16)], c[k : k + (1 << 16)]] = np.abs(x[first + r[k : k + (1 << 16)]] - x[lo + c[k : k + (1 << 16)]]).sum(axis=1)
    else:
        d = block_distances(x[first:last], x[lo:hi], metric)
    ok = inside & (ids[first:last, None] != ids[None, lo:hi]) & (d - m <= within)
    many = np.flatnonzero(ok.sum(axis=1) > most)
    if len(many):
        upper = np.where(ok[many], d[many] + m[many], np.inf)
        ok[many] &= d[many] - m[many] <= np.partition(upper, most - 1, axis=1)[:, most - 1, None]
    r, c = np.nonzero(ok)
    return ids[first + r], ids[lo + c]


def stretches(h: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries that share ``level`` bits with each entry of a sorted array begin and end."""
    shift = np.int64(BITS) - level.astype(np.int64)
    low = (h >> shift) << shift
    high = low + ((np.int64(1) << shift) - 1)
    return np.searchsorted(h, low, side="left"), np.searchsorted(h, high, side="right")


def nearest_of(q: np.ndarray, x: np.ndarray, metric: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, row numbers) of the k nearest rows of ``x`` for each query."""
    d = block_distances(q, x, metric)
    at = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
    return np.take_along_axis(d, at, axis=1), at


class Forest:
    """The index over one table and its searches.

    ``df``: ``collection``, ``key``, ``embedding``; ``profiles``: ``collection``,
    ``dimensions``, ``distance_function``, ``neighbour_count`` and, if distances are
    bounded, ``neighbour_max_distance``. Vectors that are null, of another length, not
    finite or all zero take no part, nor do rows whose key or collection is null or has no
    profile with a known distance function. Rows written twice under one key count once; of
    different vectors under one key one counts, always the same.
    Ties are ranked by key. Empty tables give empty results.

    ``candidates`` is the least that a vector's ascent collects over all trees; a collection takes as many
    more as it needs to meet ``recall`` of the true neighbours of ``queries`` of its vectors. ``measured``
    has, by collection, the number taken and the share met. Vectors without any structure may need a good part of
    their collection: no index helps there, and the result is still found.
    """

    def __init__(self, df: DataFrame, profiles: DataFrame, trees: int = 10, candidates: int = 2304, recall: float = 0.97, queries: int = 128, sample: int = 12_288, bounded: bool = True, seed: int = 7):
        self.spark, self.trees, self.least, self.recall, self.queries, self.bounded, self.seed = df.sparkSession, trees, candidates, recall, queries, bounded, seed
        rows = profiles.select("collection", "dimensions", "distance_function", "neighbour_count", *(["neighbour_max_distance"] if bounded else [])).collect()  # a row per collection
        self.profiles = {
            r[0]: Profile(r[1], METRICS[r[2].strip().lower()], r[3], float(r[4]) if bounded and r[4] is not None else None)
            for r in rows
            if r[0] is not None and r[1] and r[3] and r[2] and r[2].strip().lower() in METRICS
        }
        self.asked = self.spark.createDataFrame([(n, p.dimensions, p.k) for n, p in self.profiles.items()], "collection string, _dims int, _k int")
        e = df.select("collection", "key", F.col("embedding").cast("array<float>").alias("embedding")).where("key IS NOT NULL")
        finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        e = e.join(small_enough(self.asked), "collection").where((F.size("embedding") == F.col("_dims")) & finite & F.exists("embedding", lambda v: v != 0))
        self.base = e.select("collection", "key", F.xxhash64("collection", "embedding").alias("id"), "embedding")  # equal vectors have one id
        self.keys = materialize(self.base.groupBy("collection", "key").agg(F.min("id").alias("id"), F.max("id").alias("_other")), "near-keys")
        if not self.keys.where("id <> _other").isEmpty():
            self.base = self.base.join(self.keys.select("collection", "key", "id"), ["collection", "key", "id"], "left_semi").select(*self.base.columns)
        #: One row per class: ``collection``, ``id``, ``embedding``.
        self.classes = materialize(self.base.select("collection", "id", "embedding").dropDuplicates(["collection", "id"]), "near-classes")
        self.sizes = {r[0]: r[1] for r in self.classes.groupBy("collection").count().collect()}
        self.measured: dict[str, tuple[int, float]] = {}
        self.index = self._fit(sample)

    def _sampled(self, most: int) -> pa.Table:
        """About ``most`` classes, each collection by its size but with 256 at least, those with the least ids, which are hashes."""
        total = max(1, sum(self.sizes.values()))
        share = [(n, -(2**63) + int(2**64 * min(1.0, max(most / total, 256 / c))) - 1) for n, c in self.sizes.items()]
        upto = self.spark.createDataFrame(share, "collection string, _upto long")
        return self.classes.join(small_enough(upto), "collection").where("id <= _upto").select("collection", "id", "embedding").orderBy("collection", "id").toArrow()

    def _fit(self, sample: int) -> dict[str, Index]:
        got = self._sampled(sample) if self.profiles else None
        out = {}
        for n, (name, p) in enumerate(sorted(self.profiles.items())):
            own = got.filter(pa.compute.equal(got["collection"], name))
            x, rows = matrix(own["embedding"], p.dimensions)
            x, ids = placed(x, p.metric), own["id"].to_numpy()[rows]
            ix = Index(n, p, self.trees, self.seed, np.zeros(self.trees * SIGN_BITS, np.float32), np.empty((0, self.trees), np.int64), np.empty((self.trees, 0), np.int64))
            if len(x):
                w = planes(self.seed, n, self.trees, p.dimensions)
                through = x[np.random.default_rng((self.seed, n, 1)).integers(0, len(x), len(w))]
                ix.offsets = (w * through).sum(axis=1).astype(np.float32)
                ix.sampled = np.sort(strings(x, ids, ix), axis=0)
                ix.cut(round(self.sizes[name] / PART))
            out[name] = ix
        return out

    def _entries(self, classes: DataFrame, vectors: bool) -> DataFrame:
        """One row per class and tree: its part, hash string and id and, with ``vectors``, its level, components in a byte each, their scale and margin."""
        # the sample stays with the driver
        index = {n: replace(ix, sampled=ix.sampled[:0]) for n, ix in self.index.items()}

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names = b.column(0).to_pylist()
                ids = b.column(1).to_numpy(zero_copy_only=False)
                for name in sorted(set(names)):
                    ix = index[name]
                    own = np.flatnonzero(np.array([m == name for m in names]))
                    x, rows = matrix(b.column(2).take(pa.array(own)), ix.profile.dimensions)
                    if not len(x):
                        continue
                    x, i = placed(x, ix.profile.metric), ids[own[rows]]
                    h = strings(x, i, ix)
                    more: list[pa.Array] = []
                    if vectors:
                        scale = np.abs(x).max(axis=1) / 127
                        code = np.rint(x / np.maximum(scale, np.float32(1e-38))[:, None]).astype(np.int8)
                        margin = pa.array(margins(x, code.astype(np.float32) * scale[:, None], ix.profile.metric))
                        more = [b.column(3).take(pa.array(own[rows])), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale.astype(np.float32)), margin]
                    for t in range(ix.trees):
                        part = np.searchsorted(ix.cuts[t], h[:, t], side="right").astype(np.int32)
                        tree = np.full(len(x), ix.number * ix.trees + t, np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(part), pa.array(h[:, t]), pa.array(i), *more], names=["tree", "part", "h", "id", *(["level", "code", "scale", "margin"] if vectors else [])])

        cols = ["collection", "id", "embedding", *(["level"] if vectors else [])]
        out = classes.select(*cols).mapInArrow(of, "tree int, part int, h long, id long" + (", level int, code binary, scale float, margin float" if vectors else ""))
        # partitions follow the data: about two parts each
        n = max(1, -(-sum(self.sizes.values()) * self.trees // (2 * PART)))
        return out.repartition(max(n, min(self.trees * max(1, len(self.sizes)), self.spark.sparkContext.defaultParallelism)), "tree", "part").sortWithinPartitions("tree", "part", "h", "id")

    @staticmethod
    def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The rows of each (tree, part), which come in order."""
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            run = b.column(0).to_numpy().astype(np.int64) * (1 << 31) + b.column(1).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(run)) + 1), len(run)] if len(run) else [0]
            for lo, hi in zip(cut, cut[1:], strict=False):
                if run[lo] != last and held:
                    yield pa.Table.from_batches(held)
                    held = []
                last = run[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield pa.Table.from_batches(held)

    def descent(self) -> DataFrame:
        """(``id``, ``ladder``): of each class, tree by tree, the longest prefixes that 1, 2, 4, ... entries share with it, a byte each."""
        steps, trees, runs = self._steps(), self.trees, self._runs

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in runs(batches):
                rungs = ladders(t["h"].to_numpy(), steps)
                tree = pa.array(np.full(len(t), int(t["tree"][0].as_py()) % trees, np.int32))
                yield pa.RecordBatch.from_arrays([t["id"].combine_chunks() if t["id"].num_chunks > 1 else t["id"].chunk(0), tree, pa.array([r.tobytes() for r in rungs], pa.binary())], names=["id", "tree", "rungs"])

        e = self._entries(self.classes, False).mapInArrow(of, "id long, tree int, rungs binary")
        g = e.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("tree", "rungs"))).alias("_l"))  # one entry a tree
        return g.select("id", F.expr("unhex(array_join(transform(_l, x -> hex(x.rungs)), ''))").alias("ladder"))

    def _steps(self) -> int:
        return max(2, int(max(self.sizes.values(), default=1)).bit_length() + 1)

    def _true(self) -> dict[str, list[tuple[int, np.ndarray, list[np.ndarray]]]]:
        """By collection: sampled classes, their strings and those of their true neighbours, found among all classes."""
        most = max(4, min(self.queries, 4096 // max(1, len(self.sizes))))
        share = [(n, -(2**63) + int(2**64 * min(1.0, most / c)) - 1) for n, c in self.sizes.items()]
        upto = self.spark.createDataFrame(share, "collection string, _upto long")
        got = self.classes.join(small_enough(upto), "collection").where("id <= _upto").select("collection", "id", "embedding").toArrow()
        asked, out = {}, {}
        for name, ix in self.index.items():
            own = got.filter(pa.compute.equal(got["collection"], name))
            x, rows = matrix(own["embedding"], ix.profile.dimensions)
            if len(x):
                asked[name] = (own["id"].to_numpy()[rows], placed(x, ix.profile.metric))
                h = strings(asked[name][1], asked[name][0], ix)
                out[name] = {int(i): (h[r], []) for r, i in enumerate(asked[name][0])}
        index = self.index

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names = np.array(b.column(0).to_pylist(), dtype=object)
                for name in set(names.tolist()) & set(asked):
                    ix, (qi, q), own = index[name], asked[name], np.flatnonzero(names == name)
                    p = ix.profile
                    x, rows = matrix(b.column(2).take(pa.array(own)), p.dimensions)
                    if not len(x):
                        continue
                    x, ids = placed(x, p.metric), b.column(1).to_numpy(zero_copy_only=False)[own[rows]]
                    d, at = nearest_of(q, x, p.metric, p.k + 1)
                    within = np.inf if p.within is None else np.sqrt(2 * max(p.within, 0)) if p.metric == "cos" else p.within
                    r, c = np.nonzero((d <= within) & (ids[at] != qi[:, None]))
                    h = strings(x[at[r, c]], ids[at[r, c]], ix)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(r), pa.string()), pa.array(qi[r]), pa.array(d[r, c].astype(np.float64)), pa.array(ids[at[r, c]]), pa.array(h.tolist(), pa.list_(pa.int64()))], names=["collection", "q", "d", "c", "h"])

        near = self.classes.mapInArrow(of, "collection string, q long, d double, c long, h array<long>").join(small_enough(self.asked), "collection")
        w = Window.partitionBy("collection", "q").orderBy("d", "c")  # few rows a query and batch
        for r in near.withColumn("_n", F.row_number().over(w)).where("_n <= _k").select("collection", "q", "h").collect():
            out[r[0]][r[1]][1].append(np.array(r[2], np.int64))
        return {n: [(i, h, near) for i, (h, near) in q.items() if near] for n, q in out.items()}

    def _calibrated(self, ladder: DataFrame) -> dict[str, int]:
        """By collection the least number of candidates, a power of two times ``candidates``, that meets the share ``recall`` of the true neighbours."""
        true = self._true()
        ids = [(i,) for q in true.values() for i, _, _ in q]
        rungs = {}
        if ids:
            few = self.spark.createDataFrame(ids, "id long").distinct()
            rungs = {r[0]: r[1] for r in ladder.join(small_enough(few), "id", "left_semi").collect()}  # of the sampled classes
        out = {}
        for name in self.index:
            q, taken, met = true.get(name, []), self.least, 1.0
            if q:
                lad = np.stack([np.frombuffer(rungs[i], np.uint8).reshape(self.trees, -1) for i, _, _ in q])
                shared = [np.array([common(h, n).max() for n in near]) for _, h, near in q]
                while True:
                    level = ascent(lad, taken)
                    hit = [(s >= lv).sum() for s, lv in zip(shared, level, strict=True)]
                    met = float(sum(hit) / sum(len(s) for s in shared))
                    if met >= self.recall or not level.any():
                        break
                    taken *= 2
            out[name] = taken
            self.measured[name] = (taken, met)
        return out

    def candidates(self) -> DataFrame:
        """(``q``, ``c``): what the ascent meets for each class, all that can be nearest by the coded distances and their margins."""
        ladder = materialize(self.descent(), "near-ladders")
        taken = self._calibrated(ladder)
        for name, ix in self.index.items():
            ix.cut(round(self.sizes.get(name, 0) / max(PART, REACHES * taken[name] // self.trees)))
        number = self.spark.createDataFrame(list(taken.items()), "collection string, _taken long")
        trees, runs = self.trees, self._runs

        def of_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                lad = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(len(b), trees, -1)
                m = b.column(4).to_numpy(zero_copy_only=False)
                level = np.zeros(len(b), np.int32)
                for t in np.unique(m):
                    level[m == t] = ascent(lad[m == t], int(t))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(level)], names=["collection", "id", "embedding", "level"])

        leveled = self.classes.join(small_enough(ladder), "id").join(small_enough(number), "collection")
        leveled = leveled.select("collection", "id", "embedding", "ladder", "_taken").mapInArrow(of_level, "collection string, id long, embedding array<float>, level int")
        of_tree = {ix.number: ix.profile for ix in self.index.values()}

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in runs(batches):
                p = of_tree[int(t["tree"][0].as_py()) // trees]
                within = np.inf if p.within is None else np.sqrt(2 * max(p.within, 0)) if p.metric == "cos" else p.within
                h, ids, margin = t["h"].to_numpy(), t["id"].to_numpy(), t["margin"].to_numpy()
                code = np.frombuffer(b"".join(t["code"].to_pylist()), np.int8).reshape(-1, p.dimensions)
                x = code.astype(np.float32) * t["scale"].to_numpy()[:, None]
                begin, end = stretches(h, t["level"].to_numpy())
                for first in range(0, len(x), BLOCK):
                    last = min(len(x), first + BLOCK)
                    for lo in range(int(begin[first:last].min()), int(end[first:last].max()), COLUMNS):
                        hi = min(lo + COLUMNS, int(end[first:last].max()))
                        col = np.arange(lo, hi)[None]
                        inside = (col >= begin[first:last, None]) & (col < end[first:last, None])
                        q, c = near_in_block(x, ids, margin, first, last, lo, hi, inside, p.k, within, p.metric)
                        if len(q):
                            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c)], names=["q", "c"])

        return self._entries(leveled, True).mapInArrow(of, "q long, c long").distinct()

    def neighbours(self) -> DataFrame:
        """(``collection``, ``key``, ``neighbour``, ``distance``, ``rank``): each vector's k nearest, within the bound if there is one."""
        index = self.index
        cand = materialize(self.candidates(), "near")
        several = self.keys.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("q"), F.col("id").alias("c"))
        pairs = materialize(cand.unionByName(several), "near-pairs")
        ids = materialize(pairs.select(F.explode(F.array("q", "c")).alias("id")).distinct(), "near-ids")
        need = materialize(self.classes.join(small_enough(ids), "id", "left_semi"), "near-vectors")
        side = lambda n: need.select(F.col("id").alias(n), F.col("collection").alias(f"{n}_col"), F.col("embedding").alias(f"{n}_v"))
        j = pairs.join(side("q"), "q").join(side("c"), "c").where("q_col = c_col").select("q_col", "q", "c", "q_v", "c_v")

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names = np.array(b.column(0).to_pylist(), dtype=object)
                d = np.full(len(names), np.inf)
                for name in set(names.tolist()):
                    p, own = index[name].profile, np.flatnonzero(names == name)
                    x, r = matrix(b.column(3).take(pa.array(own)), p.dimensions)
                    y, r2 = matrix(b.column(4).take(pa.array(own)), p.dimensions)
                    if len(r) == len(r2) == len(own):
                        v = exact(x, y, p.metric)
                        d[own] = np.where(v <= (np.inf if p.within is None else p.within), v, np.inf)
                ok = pa.array(np.isfinite(d))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), b.column(2).filter(ok), pa.array(d).filter(ok)], names=["collection", "q", "c", "distance"])

        near = j.mapInArrow(of, "collection string, q long, c long, distance double")
        most = max((p.k for p in self.profiles.values()), default=0) + 1
        first = Window.partitionBy("collection", "id").orderBy("key")
        least = self.keys.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).select("collection", F.col("id").alias("c"), "key")
        met = near.join(least, ["collection", "c"])
        best = Window.partitionBy("collection", "q").orderBy("distance", "key")
        met = met.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= most)
        lists = met.groupBy("collection", F.col("q").alias("id")).agg(F.sort_array(F.collect_list(F.struct("distance", F.col("key").alias("neighbour")))).alias("near"))
        lists = materialize(lists.join(small_enough(self.asked), "collection"), "near-lists")
        own = self.keys.select("collection", "id", "key").join(small_enough(lists), ["collection", "id"])
        others = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("key")), F.lit(1), F.col("_k"))
        return own.select("collection", "key", F.posexplode(others).alias("_i", "x")).select("collection", "key", "x.neighbour", "x.distance", (F.col("_i") + 1).alias("rank"))


def forest(spark: SparkSession, sf_dir: str, **kw) -> Forest:  # noqa: ANN003
    return Forest(spark.read.parquet(f"{sf_dir}/ingested_chunk.parquet"), spark.read.parquet(f"{sf_dir}/collection_profile.parquet"), **kw)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one is among the other's nearest, within the collection's greatest distance."""
    n = forest(spark, sf_dir).neighbours()
    return n.select(F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk's nearest chunks, with distance and rank, within the collection's greatest distance."""
    return forest(spark, sf_dir).neighbours()

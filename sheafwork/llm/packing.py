"""Filling containers of fixed capacity with whole documents, by swap-based local search.

Pieces that fill a container by themselves are closed at once. All other items are dealt to blocks
of bounded size by a hash of their id, so that no source or size can crowd one. In a block,
items go best-fit into containers, largest first; then
underfull containers are emptied, the least filled first: an item moves where it fits
tightest, or is exchanged for a smaller one, or two are exchanged for one, each step
raising the sum of squared fills, until no step does. What is still underfull leaves the block and is
packed again with that of other blocks, level by level, so that in the end the whole table
has a handful of containers with space left.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.runtime import materialize, small_enough

#: Items dealt to one block, on average.
BLOCK = 4096
#: A container filled to this share is closed; the others are searched, and go on to the next level.
FULL = 0.995


def cut_points(text: bytes, capacity: int) -> list[int]:
    """Ends of the pieces of an oversized text: as full as code points allow."""
    out, at = [], 0
    while len(text) - at > capacity:
        end = at + capacity
        while end > at and text[end] & 0xC0 == 0x80:
            end -= 1
        if end == at:  # a code point larger than the container
            end = at + 1
            while end < len(text) and text[end] & 0xC0 == 0x80:
                end += 1
        out.append(end)
        at = end
    return [*out, len(text)]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Item numbers by container: largest first, each where the least space remains."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (space left, container), in order
    for i in order:
        s = sizes[i]
        k = bisect_left(room, (s, -1))
        if k == len(room):
            bins.append([i])
            insort(room, (capacity - s, len(bins) - 1))
        else:
            left, b = room.pop(k)
            bins[b].append(i)
            insort(room, (left - s, b))
    return bins


def local_search(bins: list[list[int]], sizes: list[int], capacity: int, full: float = FULL) -> list[list[int]]:
    """Containers after moves and exchanges, each of which raises the sum of squared fills; none is left that would.

    Containers filled to ``full`` are left as they are.
    """
    fill = [sum(sizes[i] for i in b) for b in bins]
    done = [b for b, f in zip(bins, fill, strict=True) if f >= full * capacity]
    work = [list(b) for b, f in zip(bins, fill, strict=True) if f < full * capacity]
    fills = [f for f in fill if f < full * capacity]
    least = -(-sum(fills) // capacity) if fills else 0  # no packing has fewer
    items = np.array(sorted(i for b in work for i in b), dtype=np.int64)
    size = np.array([sizes[i] for i in items], dtype=np.int64)
    place = {int(i): n for n, i in enumerate(items)}
    home = np.empty(len(items), dtype=np.int64)  # the container of each item
    for k, b in enumerate(work):
        home[[place[i] for i in b]] = k
    room = np.array([capacity - f for f in fills], dtype=np.int64)  # space left in each container
    changed = True
    while changed and sum(1 for b in work if b) > least:
        changed = False
        for a in sorted((k for k in range(len(work)) if work[k]), key=lambda k: (fills[k], k)):
            while work[a] and (step := _move(work, fills, sizes, room, a) or _exchange(work, fills, sizes, items, size, home, room, a)):
                b, mine, theirs = step
                for i in mine:
                    work[a].remove(i)
                    work[b].append(i)
                    home[place[i]] = b
                for j in theirs:
                    work[b].remove(j)
                    work[a].append(j)
                    home[place[j]] = a
                gain = sum(sizes[i] for i in mine) - sum(sizes[j] for j in theirs)
                fills[a] -= gain
                fills[b] += gain
                room[a] += gain
                room[b] -= gain
                changed = True
    return done + [b for b in work if b]


Step = tuple[int, list[int], list[int]]


def _fuller(work: list[list[int]], fills: list[int], room: np.ndarray, a: int) -> np.ndarray:
    """Which containers are at least as full as ``a``: what they gain raises the sum of squares."""
    ok = room <= room[a]
    ok[a] = False
    return ok & np.array([bool(b) for b in work])


def _move(work: list[list[int]], fills: list[int], sizes: list[int], room: np.ndarray, a: int) -> Step | None:
    """The largest item of ``a`` that a fuller container has room for, and the one where it fits tightest."""
    ok = np.flatnonzero(_fuller(work, fills, room, a))
    if not len(ok):
        return None
    by = ok[np.argsort(room[ok], kind="stable")]
    for i in sorted(work[a], key=lambda i: (-sizes[i], i)):
        k = int(np.searchsorted(room[by], sizes[i]))
        if k < len(by):
            return int(by[k]), [i], []
    return None


def _exchange(work: list[list[int]], fills: list[int], sizes: list[int], items: np.ndarray, size: np.ndarray, home: np.ndarray, room: np.ndarray, a: int) -> Step | None:
    """The exchange of one item or two of ``a`` for a smaller one of any fuller container that moves most."""
    own = sorted(work[a], key=lambda i: (sizes[i], i))
    w = np.array([sizes[i] for i in own], dtype=np.int64)
    x, y = np.triu_indices(len(own), 1)
    sums, first, second = np.concatenate([w, w[x] + w[y]]), np.concatenate([np.arange(len(own)), x]), np.concatenate([np.full(len(own), -1), y])
    order = np.argsort(sums, kind="stable")
    there = np.flatnonzero(_fuller(work, fills, room, a)[home])
    if not len(there):
        return None
    # for each item there, the most of one's own that fits in its place
    k = np.searchsorted(sums[order], size[there] + room[home[there]], side="right") - 1
    gain = np.where(k >= 0, sums[order][np.maximum(k, 0)] - size[there], 0)
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return None
    n = order[k[best]]
    mine = [own[first[n]]] + ([own[second[n]]] if second[n] >= 0 else [])
    return int(home[there[best]]), mine, [int(items[there[best]])]


ITEM = "capacity_tokens long, doc_id long, piece int, pieces int, byte_start long, byte_end long, size long"
PACKED = f"{ITEM}, container string, fill long, level int"


def _pack_level(items: DataFrame, level: int, full: float) -> DataFrame:
    """``items`` has ``block``; the result their containers."""

    def of(key: tuple, t: pa.Table) -> pa.Table:
        capacity, block = key[0].as_py(), key[1].as_py()
        t = t.select(["capacity_tokens", "doc_id", "piece", "pieces", "byte_start", "byte_end", "size"]).sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        sizes = t["size"].to_pylist()
        bins = local_search(best_fit(sizes, capacity), sizes, capacity, full)
        name, fill = [""] * len(sizes), [0] * len(sizes)
        for k, b in enumerate(bins):
            f = sum(sizes[i] for i in b)
            for i in b:
                name[i], fill[i] = f"{capacity}-{level}-{block}-{k}", f
        return t.append_column("container", pa.array(name, pa.string())).append_column("fill", pa.array(fill, pa.int64())).append_column("level", pa.array([level] * len(sizes), pa.int32()))

    return items.groupBy("capacity_tokens", "block").applyInArrow(of, PACKED)


def items_of(docs: DataFrame, capacities: DataFrame) -> DataFrame:
    """One row per document and capacity that fits, and one per piece of a document that doesn't.

    ``docs``: ``doc_id``, ``text``. Null texts are no items; empty ones have size 0.
    """
    caps = capacities.select(F.col("capacity_tokens").cast("long").alias("capacity_tokens")).where("capacity_tokens > 0").distinct()
    d = docs.select("doc_id", "text", F.octet_length("text").cast("long").alias("size")).where("text IS NOT NULL AND doc_id IS NOT NULL")
    # the capacities are one row, so that every document is read once and met by each
    one = caps.agg(F.sort_array(F.collect_set("capacity_tokens")).alias("_caps"))
    d = d.crossJoin(F.broadcast(one)).select("doc_id", "text", "size", F.explode("_caps").alias("capacity_tokens"))
    fits = d.where("size <= capacity_tokens").selectExpr("capacity_tokens", "doc_id", "0 AS piece", "1 AS pieces", "0L AS byte_start", "size AS byte_end", "size")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for c, i, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                ends = cut_points(t.encode(), c)
                rows += [(c, i, k, len(ends), a, z, z - a) for k, (a, z) in enumerate(zip([0, *ends], ends, strict=False))]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["capacity_tokens", "doc_id", "piece", "pieces", "byte_start", "byte_end", "size"])

    return fits.unionByName(d.where("size > capacity_tokens").select("capacity_tokens", "doc_id", "text").mapInArrow(of, ITEM))


def pack(docs: DataFrame, capacities: DataFrame, block: int = BLOCK, full: float = FULL) -> DataFrame:
    """The containers of every capacity: one row per whole document or piece.

    ``docs``: ``doc_id``, ``text``, and any other columns, which are left out. ``capacities``: ``capacity_tokens``; repeated
    ones count once, null and non-positive ones not at all. Sizes are UTF-8 bytes. Only a
    document larger than the capacity is divided, between code points; its full pieces fill
    containers of their own and its rest is an item like others. Rows with one ``doc_id`` are
    separate items. Each row has its ``container``, the container's ``fill`` and the ``level`` it was closed
    at (-1: an item that fills it alone). A container filled to ``full`` of its capacity is
    closed. An empty table gives an empty result.
    """
    items = materialize(items_of(docs, capacities), "items")
    alone = F.col("size") >= F.lit(full) * F.col("capacity_tokens")
    name = F.concat_ws("-", F.col("capacity_tokens"), F.lit("alone"), F.col("doc_id"), F.col("piece"))
    # rows with one id and piece are told apart by their place in the written table
    alike = F.concat_ws("-", name, F.monotonically_increasing_id())
    out = items.where(alone).withColumn("container", alike).withColumn("fill", F.col("size")).withColumn("level", F.lit(-1))
    left, level = items.where(~alone), 0
    while True:
        # every capacity has as many blocks as its items need
        need = left.groupBy("capacity_tokens").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        if level:
            need = need.join(before, "capacity_tokens").select("capacity_tokens", F.least("blocks", F.ceil(F.col("was") / 2)).cast("int").alias("blocks"))  # noqa: F821
        need = materialize(need, f"blocks{level}")
        salt = F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.col("blocks")).cast("int")
        dealt = left.join(small_enough(need), "capacity_tokens").withColumn("block", salt)  # a row per capacity
        packed = materialize(_pack_level(dealt.drop("blocks"), level, full), f"packed{level}")
        last = small_enough(need.select("capacity_tokens", (F.col("blocks") <= 1).alias("last")))
        packed = packed.join(last, "capacity_tokens")
        closed = F.col("last") | (F.col("fill") >= F.lit(full) * F.col("capacity_tokens"))
        out = out.unionByName(packed.where(closed).drop("last"))
        if need.where("blocks > 1").isEmpty():
            return out
        left = packed.where(~closed).select(*items.columns)
        before = need.select("capacity_tokens", F.col("blocks").alias("was"))
        level += 1


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/pack_spec.parquet"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each capacity the documents larger than it: those the packing has divided."""
    return packed_documents(spark, sf_dir).where("pieces > 1").select("capacity_tokens", "doc_id").distinct()


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each capacity its containers, their items and content, the fewest containers possible, and the share of space used."""
    p = packed_documents(spark, sf_dir)
    bins = p.groupBy("capacity_tokens", "container").agg(F.sum("size").alias("fill"), F.count("*").alias("items"))
    total = F.sum("fill")
    return bins.groupBy("capacity_tokens").agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), total.alias("tokens"), F.ceil(total / F.first("capacity_tokens")).alias("fewest"),
        F.round(total / (F.count("*") * F.first("capacity_tokens")), 4).alias("share_used"), F.max(F.col("fill") > F.col("capacity_tokens")).alias("overfull"),
    )


def cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each capacity and document: the bytes that its pieces have together, whether it is whole, and how many of them lie in an overfull container."""
    p = packed_documents(spark, sf_dir)
    fill = p.groupBy("capacity_tokens", "container").agg(F.sum("size").alias("_fill"))
    p = p.join(fill, ["capacity_tokens", "container"])
    over = F.count_if((F.col("_fill") > F.col("capacity_tokens")) | (F.col("_fill") != F.col("fill")))
    return p.groupBy("capacity_tokens", "doc_id").agg(F.sum("size").alias("size"), (F.max("pieces") == 1).alias("whole"), over.alias("over"))

"""Ingestion state: gates, diffs, upserts, deletes, pruning, budgets and reports.

Order-dependent rules (the last of several rows wins, the first delivery counts) take an explicit
order column, since rows have none. Everything is a join or a grouped aggregate on the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.functions.text import chunk_key, instant, strip, usable_digest
from sheafwork.runtime import materialize, small_enough

DOC = ["collection", "source_id", "document_id"]


def _same(keys: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last in ``order`` (nulls first)."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return rows.groupBy(*keys).agg(best).select(*keys, "_r.*").select(*rows.columns)


def upsert(stored: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``stored`` with the last row of each key of ``rows`` put in or replaced; columns are matched by name."""
    new = last_wins(rows, keys, order)
    kept = stored.alias("s").join(new.select(*keys).alias("n"), _same(keys, "s", "n"), "left_anti")
    return kept.unionByName(new.select(*stored.columns))


def delete(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` without the rows whose keys ``gone`` has: single rows, a document's or a whole source's, by ``keys``."""
    return stored.alias("s").join(gone.select(*keys).distinct().alias("g"), _same(keys, "s", "g"), "left_anti")


def next_keys(stored: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with a null ``key`` numbered on from the greatest one stored or given, in ``order``.

    The numbering is a running count in two steps, so it takes no single task for all rows. The ranges are
    written before they are counted: made twice, they might be cut elsewhere.
    """
    top = stored.agg(F.coalesce(F.max(key), F.lit(0)).alias("_m")).crossJoin(rows.agg(F.coalesce(F.max(key), F.lit(0)).alias("_g"))).select(F.greatest("_m", "_g").alias("_top"))
    given, wanted = rows.where(F.col(key).isNotNull()), rows.where(F.col(key).isNull())
    ranged = wanted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    ranged = materialize(ranged, "ranged")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    made = ranged.join(F.broadcast(before.select("_p", "_b")), "_p").crossJoin(F.broadcast(top)).withColumn(key, F.col("_top") + F.col("_b") + F.col("_i") + 1)
    return given.unionByName(made.select(*rows.columns))


def first_delivery(items: DataFrame, order: list[str]) -> DataFrame:
    """Items with ``duplicate``: true for every delivery of a document in a run but the first, which fail."""
    w = Window.partitionBy(*DOC).orderBy(*order)
    return items.withColumn("duplicate", F.row_number().over(w) > 1)


def skip_gates(items: DataFrame, state: DataFrame, recipe: Column, most_bytes: int, trust_times: bool = False) -> DataFrame:
    """Items with ``gate``: why one is skipped, or null if it is to be processed.

    In this order: still too large, still unsupported, (if times are trusted) unchanged since, same
    content under the same recipe with a final status.
    """
    s = state.alias("s")
    j = items.alias("i").join(s, _same(DOC, "i", "s"), "left")
    status = F.lower(strip(F.col("s.status")))
    same_size = F.col("i.size_bytes").eqNullSafe(F.col("s.size_bytes"))
    same = (usable_digest(F.col("i.content_hash")) == usable_digest(F.col("s.content_hash"))) & (usable_digest(F.col("s.recipe_hash")) == usable_digest(recipe))
    final = status.isin("indexed", "notextlayer", "unsupported", "failed")
    gate = F.when((F.col("i.size_bytes") > most_bytes) & same_size & (status == "failed"), "size").when((status == "unsupported") & same_size & same, "unsupported")
    if trust_times:
        gate = gate.when((status == "indexed") & same_size & (instant(F.col("i.modified_utc")) == instant(F.col("s.modified_utc"))) & F.col("i.modified_utc").isNotNull(), "time")
    return j.select("i.*", gate.when(same & final, "content").alias("gate"))


def chunk_keys(chunks: DataFrame, embed_text: str = "embed_text") -> DataFrame:
    """Chunks with ``duplicate`` (number among equal texts of the document, by ordinal) and ``chunk_key``."""
    w = Window.partitionBy(*DOC, F.md5(F.col(embed_text))).orderBy("ordinal")
    c = chunks.withColumn("duplicate", F.row_number().over(w) - 1)
    return c.withColumn("chunk_key", chunk_key(F.col("source_id"), F.col("document_id"), F.col(embed_text), F.col("duplicate")))


def diff(fresh: DataFrame, stored: DataFrame, keys: list[str], moved: list[str]) -> DataFrame:
    """(``keys``, ``change``): added, removed, unchanged or, where columns of ``moved`` differ, repaired."""
    j = fresh.alias("f").join(stored.alias("s"), _same(keys, "f", "s"), "full_outer")
    f, s = F.col(f"f.{moved[0]}").isNotNull() | F.col(f"f.{keys[0]}").isNotNull(), F.col(f"s.{moved[0]}").isNotNull() | F.col(f"s.{keys[0]}").isNotNull()
    still = F.lit(True)
    for m in moved:
        still = still & F.col(f"f.{m}").eqNullSafe(F.col(f"s.{m}"))
    change = F.when(~s, "added").when(~f, "removed").when(still, "unchanged").otherwise("repaired")
    return j.select(*[F.coalesce(F.col(f"f.{k}"), F.col(f"s.{k}")).alias(k) for k in keys], change.alias("change"))


def prune_missing(state: DataFrame, live: DataFrame, completed: bool, unreadable: list[str] | None = None) -> DataFrame:
    """State rows of documents that are gone: only after a completed run, sparing ids under unreadable folders."""
    gone = state.alias("s").join(live.select(*DOC).distinct().alias("l"), _same(DOC, "s", "l"), "left_anti")
    if not completed:
        return gone.limit(0)
    for p in unreadable or []:
        gone = gone.where(~F.col("document_id").startswith(p))
    return gone


def running_total(rows: DataFrame, by: list[str], order: list[str], value: Column, to: str) -> DataFrame:
    """``to``: the sum of ``value`` over the rows before in ``order`` within ``by``.

    Rows are ranged by (``by``, ``order``), so that a group with a third of all of them is spread over parts:
    a sum within each part, and the sums of the parts before it. The parts are written before they are counted.
    """
    ranged = rows.withColumn("_v", value).repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    inside = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    per = ranged.groupBy(*by, "_p").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    base = small_enough(per.withColumn("_b", F.coalesce(F.sum("_s").over(before), F.lit(0))).select(*by, "_p", "_b"))
    r = ranged.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0))).alias("r")
    j = r.join(base.alias("b"), _same(by, "r", "b") & (F.col("r._p") == F.col("b._p")))
    return j.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("r._in") + F.col("b._b")).alias(to))


def within_budget(items: DataFrame, by: list[str], order: list[str], cost: Column, budget: int | float) -> DataFrame:
    """Items with ``taken``: whether the costs of those before it in its group stay under the budget; the first beyond suspends the run."""
    return running_total(items, by, order, F.coalesce(cost, F.lit(0)), "_before").withColumn("taken", F.col("_before") < budget).drop("_before")


def abort_point(outcomes: DataFrame, by: list[str], order: list[str], most: int = 20) -> DataFrame:
    """(``by``, ``order``): of each group the item at which ``most`` failures in a row are reached.

    A streak is told by the number of successes before it, so two running totals and a grouped maximum do: no group is
    sorted in one task.
    """
    o = running_total(outcomes.select(*by, *order, "failed"), by, order, F.when(F.col("failed"), 0).otherwise(1), "_good")
    o = running_total(o, by, order, F.lit(1), "_n")
    # of each streak, the place of its first failure
    first = o.where("failed").groupBy(*by, "_good").agg(F.min("_n").alias("_first"))
    o, first = o.where("failed").alias("o"), first.alias("f")
    hit = o.join(first, _same([*by, "_good"], "o", "f")).where(F.col("o._n") - F.col("f._first") == most - 1).select("o.*")
    return hit.groupBy(*by).agg(F.min(F.struct(*order)).alias("_o")).select(*by, "_o.*")


def newest_runs(runs: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` runs of each collection and source; equal starts by id. The limit on the rank is applied in every task before rows move."""
    w = Window.partitionBy("collection", "source_id").orderBy(instant(F.col("started_utc")).desc(), F.desc("run_id"))
    return runs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def latest_runs(runs: DataFrame) -> DataFrame:
    """(``collection``, ``source_id``, ``run_id``, ``outcome``) of the latest run of each source."""
    best = F.max_by(F.struct("run_id", "outcome"), F.struct(instant(F.col("started_utc")).alias("t"), "run_id")).alias("_r")
    return runs.groupBy("collection", "source_id").agg(best).select("collection", "source_id", "_r.*")


def status_report(state: DataFrame, recipes: DataFrame) -> DataFrame:
    """Counts of documents by status, and of those under another than the current recipe, for each source."""
    st = F.lower(strip(F.col("status")))
    one = lambda s: F.count_if(st == s).alias(s)
    j = state.join(small_enough(recipes.select("recipe_hash").distinct()).withColumn("_now", F.lit(True)), "recipe_hash", "left")
    return j.groupBy("collection", "source_id").agg(
        F.count("*").alias("documents"), one("indexed"), one("failed"), one("unsupported"), one("notextlayer"), F.sum("chunk_count").alias("chunks"), F.count_if(F.col("_now").isNull()).alias("stale")
    )


def donors(state: DataFrame, most: int = 4) -> DataFrame:
    """(``document``, ``donor``, ``place``): indexed documents with the same content and recipe, whose vectors can be copied.

    An equi-join on the digests. A content that very many documents share offers only its first ``most`` + 1
    as donors, which is enough for each to find ``most`` others.
    """
    doc = F.struct(*DOC)
    s = state.where((F.lower(strip(F.col("status"))) == "indexed") & usable_digest(F.col("content_hash")).isNotNull()).select("collection", "content_hash", "recipe_hash", doc.alias("document")).distinct()
    g = ["collection", "content_hash", "recipe_hash"]
    first = s.withColumn("_n", F.row_number().over(Window.partitionBy(*g).orderBy("document"))).where(F.col("_n") <= most + 1).select(*g, F.col("document").alias("donor"))
    j = s.join(first, g).where(F.col("document") != F.col("donor"))
    w = Window.partitionBy("document").orderBy("donor")
    return j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("document", "donor", "place")


def nearest_rank(df: DataFrame, by: list[str], value: str, ps: list[float]) -> DataFrame:
    """Percentiles by nearest rank: the least value with at least the share ``p`` at or below it."""
    aggs = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)").alias(f"p{round(p * 100)}") for p in ps]
    return df.groupBy(*by).agg(*aggs)

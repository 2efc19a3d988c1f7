"""Processing only new, changed or unfinished records.

A run reads the record deltas between the source version that the state has taken in and the newest one,
by their manifests: added files, removed files and changed deletion vectors. It keeps, beside the
state, the current delivery of every document and whether it is open, so that a document
delivered anew is compared with that and not with the source; only documents of which
a row was withdrawn are looked up there, since an older delivery may be in force again. Open documents,
and those under a recipe that has changed, come again though nothing was delivered. What is
pending is processed; the new state is committed together with the source
version it has taken in and the version of the deliveries that belongs to it. A run that dies before the commit
leaves the state as it was and is simply repeated; one that has committed isn't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafwork.functions.text import instant, media_type, strip, usable_digest
from sheafwork.runtime import materialize, place, small_enough
from sheafwork.sources.versioned import CHANGE, Manifest, VersionedTable, _read, changed_rows

KEY = ["collection", "source_id", "document_id"]
#: States that need no further run, in lower case.
FINAL = ["indexed", "notextlayer", "unsupported", "failed"]
#: Manifest properties: the source version a state has taken in, and the version of the deliveries beside it.
PROCESSED, DELIVERIES = "source_version", "deliveries_version"
OPEN, UNDER = "_open", "_under"


def current_delivery(items: DataFrame) -> DataFrame:
    """Of each document the delivery with the greatest (``seen_utc``, ``item_seq``); null orders first.

    A grouped maximum: partial results are merged before the shuffle, so a document delivered
    very often costs one row a task. Documents with a null in the key are kept, by null.
    """
    rest = [c for c in items.columns if c not in KEY]
    best = F.max_by(F.struct(*rest), F.struct("seen_utc", "item_seq")).alias("_r")
    return items.groupBy(*KEY).agg(best).select(*KEY, "_r.*")


def state_in_force(state: DataFrame) -> DataFrame:
    """Of each document the state row with the latest ``updated_utc``; equal instants: the greatest status and digests."""
    rest = [c for c in state.columns if c not in KEY]
    order = F.struct(instant(F.col("updated_utc")).alias("t"), F.lower(strip(F.col("status"))).alias("s"), F.hex("content_hash").alias("c"), F.hex("recipe_hash").alias("r"))
    return state.groupBy(*KEY).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*KEY, "_r.*")


def current_recipes(recipe: DataFrame) -> DataFrame:
    """(``collection``, ``_type``, ``_recipe``): recipes that aren't retired; of several, the one active latest."""
    now = recipe.where("retired_utc IS NULL").withColumn("_type", media_type(F.col("media_type")))
    order = F.struct("active_from_utc", F.hex("recipe_hash"))
    return now.groupBy("collection", "_type").agg(F.max_by(F.col("recipe_hash"), order).alias("_recipe"))


def to_process(items: DataFrame, state: DataFrame, recipe: DataFrame) -> DataFrame:
    """Current deliveries, with all their columns, that are new, changed or unfinished.

    A document is left out only if its state in force has the delivery's ``content_hash``,
    the current ``recipe_hash`` of its collection and media type, and a final status. Null
    and all-zero digests equal nothing; a media type without a recipe always counts as
    changed. Equal rows count once. Any of the inputs may be empty. Columns beyond the known
    ones are carried along, except ``_type``, ``_recipe`` and ``_r``.
    """
    items = items.drop("_type", "_recipe", "_r")
    cur = current_delivery(items).withColumn("_type", media_type(F.col("media_type"))).alias("i")
    st = state_in_force(state.select(*KEY, "content_hash", "recipe_hash", "status", "updated_utc")).alias("s")
    rc = current_recipes(recipe).alias("r")
    same = [F.col(f"i.{c}").eqNullSafe(F.col(f"s.{c}")) for c in KEY]
    j = cur.join(rc, (F.col("i.collection") == F.col("r.collection")) & (F.col("i._type") == F.col("r._type")), "left")
    j = j.join(st, same, "left")
    done = (
        (usable_digest(F.col("i.content_hash")) == usable_digest(F.col("s.content_hash")))
        & (usable_digest(F.col("r._recipe")) == usable_digest(F.col("s.recipe_hash")))
        & F.lower(strip(F.col("s.status"))).isin(FINAL)
    )
    return j.where(~F.coalesce(done, F.lit(False))).select(*[F.col(f"i.{c}") for c in items.columns], F.col("r._recipe").alias("_recipe"))


def _near(df: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose document is (or, by ``left_anti``, isn't) among ``keys``, which are broadcast while they are few."""
    k = small_enough(keys.select(*KEY).distinct()).alias("k")
    same = F.lit(True)
    for c in KEY:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"k.{c}"))
    return df.alias("d").join(k, same, how)


def take_in(spark: SparkSession, old: Manifest, new: Manifest, schema, known: DataFrame) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(current deliveries of the documents that two source versions differ in, the documents withdrawn altogether).

    ``known``: the current delivery of each document at the older version. Rows that were only moved to another file are
    no change. Of documents with inserted rows alone, the current delivery is the best of these and the known one; the
    source is searched only for documents of which a row has gone.
    """
    cols = [f.name for f in schema]
    delta = changed_rows(spark, old, new, schema).withColumn("_n", F.when(F.col(CHANGE) == "insert", 1).otherwise(-1))
    delta = materialize(delta.groupBy(*cols).agg(F.sum("_n").alias("_n")).where("_n <> 0"), "delta")
    came = delta.where("_n > 0").select(*cols)
    if delta.where("_n < 0").isEmpty():
        current = current_delivery(came.unionByName(_near(known.select(*cols), came)))
        return materialize(current.select(*cols), "current"), delta.select(*KEY).limit(0)
    less = materialize(delta.where("_n < 0").select(*KEY).distinct(), "withdrawn")
    again = _near(_read(spark, new, list(new.files), schema).select(*cols), less)
    more = _near(came, less, "left_anti")
    current = current_delivery(again.unionByName(more).unionByName(_near(_near(known.select(*cols), more), less, "left_anti")))
    current = materialize(current.select(*cols), "current")
    return current, materialize(_near(less, current, "left_anti"), "retired")


def reconsidered(known: DataFrame, recipe: DataFrame, touched: DataFrame) -> DataFrame:
    """Of the documents that nothing has touched, those that are open or whose recipe isn't the current one any more."""
    rc = small_enough(current_recipes(recipe)).alias("r")
    k = known.withColumn("_type", media_type(F.col("media_type"))).alias("i")
    j = k.join(rc, (F.col("i.collection") == F.col("r.collection")) & (F.col("i._type") == F.col("r._type")), "left")
    same = usable_digest(F.col(f"i.{UNDER}")) == usable_digest(F.col("r._recipe"))
    due = j.where(F.col(f"i.{OPEN}") | ~F.coalesce(same, F.lit(False))).select("i.*").drop("_type", OPEN, UNDER)
    return _near(due, touched, "left_anti")


def run(
    spark: SparkSession,
    source: VersionedTable,
    state: VersionedTable,
    recipe: DataFrame,
    process: Callable[[DataFrame], DataFrame],
) -> int:
    """One run: find what is pending, ``process`` it, commit the new state and the source version.

    ``process`` takes the pending deliveries and returns one state row for each of those it
    has dealt with, in the state's columns. Rows it leaves out stay pending. The state rows of
    the processed documents are hidden by a deletion vector in the commit that adds the new
    ones and saves the source version; those of documents withdrawn from the source are hidden, too. All of it
    becomes visible at once or not at all: the deliveries are written first, and only the state's commit
    says which version of them counts.
    Returns the number of documents processed. If the state's table has moved on meanwhile,
    the commit fails and nothing is changed.
    """
    at, to = state.version(), source.version()
    if not at:
        raise ValueError("the state table needs a first version, which may be empty")
    said = state.properties(at)
    since, kept = int(said.get(PROCESSED, "0")), int(said.get(DELIVERIES, "0"))
    schema, deliveries = source.schema(to), VersionedTable(spark, f"{state.root}/deliveries")
    if kept:
        known = deliveries.read(kept)
    else:  # a state from elsewhere, or none: all that was there is open
        known = current_delivery(source.read(since) if since else spark.createDataFrame([], schema)).withColumn(OPEN, F.lit(True)).withColumn(UNDER, F.lit(None).cast("binary"))
    current, retired = take_in(spark, source.manifest(since), source.manifest(to), schema, known)
    touched = materialize(current.select(*KEY).unionByName(retired), "touched")
    due = materialize(reconsidered(known, recipe, touched).select(*current.columns), "due")
    some = current.unionByName(due)
    todo = materialize(to_process(some, _near(state.read(at), some), recipe), "pending")
    done = materialize(process(todo), "state")
    n = done.count()
    if n == 0 and since == to:
        return 0
    # what was pending and isn't done stays open, and so does what has no usable digest
    left = _near(todo, done, "left_anti").select(*KEY, F.lit(True).alias("_left"))
    rc = current_recipes(recipe)
    now = some.withColumn("_type", media_type(F.col("media_type"))).join(small_enough(rc), ["collection", "_type"], "left").alias("d")
    k = left.alias("k")
    same = F.lit(True)
    for c in KEY:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"k.{c}"))
    is_open = F.coalesce(F.col("_left"), F.lit(False)) | usable_digest(F.col("d.content_hash")).isNull()
    now = now.join(k, same, "left").select(*[F.col(f"d.{c}") for c in current.columns], is_open.alias(OPEN), F.col("_recipe").alias(UNDER))
    gone = touched.unionByName(due.select(*KEY))
    made = deliveries.commit(add=now, delete_keys=gone if kept else None, base=kept, overwrite=not kept)
    out = done.select(*KEY).unionByName(retired)
    state.commit(add=done if n else None, delete_keys=out, properties={PROCESSED: str(to), DELIVERIES: str(made)}, expected=at)
    return n


def state_rows(todo: DataFrame, state_schema, run_id: str, at: str) -> DataFrame:  # noqa: ANN001
    """State rows that record ``todo`` as Indexed under its current recipe."""
    made = {
        "content_hash": F.col("content_hash"), "recipe_hash": F.col("_recipe"), "size_bytes": F.col("size_bytes"), "modified_utc": F.col("modified_utc"),
        "status": F.lit("Indexed"), "last_run_id": F.lit(run_id), "updated_utc": F.lit(at),
    }
    return todo.select(*[F.col(c).alias(c) if c in KEY else made.get(c, F.lit(None)).cast(t.dataType).alias(c) for t in state_schema for c in [t.name]])


def delivery_order(items: DataFrame) -> DataFrame:
    """Each delivery with ``delivery_no`` (1 = the current one) within its document."""
    w = Window.partitionBy(*KEY).orderBy(F.col("seen_utc").desc_nulls_last(), F.col("item_seq").desc_nulls_last())
    return items.withColumn("delivery_no", F.row_number().over(w))


def versions(spark: SparkSession, items: DataFrame) -> VersionedTable:
    """``items`` as a source with a history: its first half by ``item_seq``; the rest, with superseded rows of the first half deleted; the same, compacted."""
    src = VersionedTable(spark, place(spark, "source"))
    half = F.coalesce(F.col("item_seq") <= (items.agg(F.max("item_seq")).first()[0] or 0) // 2, F.lit(True))
    src.commit(add=items.where(half))
    stale = items.where(half).join(current_delivery(items).select("item_seq"), "item_seq", "left_anti").select("item_seq")
    src.commit(add=items.where(~half), delete_keys=stale)
    src.compact()
    return src


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to be processed next, for a consumer that has taken in the first of three versions of ``source_item``.

    The versions hold the table's rows: deliveries added, superseded ones deleted by deletion vectors, and files
    replaced. The state is that of ``ingest_document``.
    """
    cols = [*KEY, "item_seq", "seen_utc", "media_type", "content_hash"]
    src = versions(spark, spark.read.parquet(f"{sf_dir}/source_item.parquet").select(*cols))
    state, recipe = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("ingest_document", "recipe"))
    known = materialize(current_delivery(src.read(1)), "known")
    current, retired = take_in(spark, src.manifest(1), src.manifest(3), src.schema(3), known)
    touched = current.select(*KEY).unionByName(retired)
    # the state given says nothing of what is open, so all known documents are held against it
    some = current.unionByName(_near(known.select(*current.columns), touched, "left_anti"))
    return to_process(some, state, recipe).select(*KEY)

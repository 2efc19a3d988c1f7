"""The ingestion pipeline: gate, extract, chunk, key, diff, embed, write, as one run over a source's documents."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.errors import SheafError
from sheafwork.functions.text import instant
from sheafwork.operators import chunking, embedding, state
from sheafwork.runtime import materialize, small_enough
from sheafwork.sources import files
from sheafwork.sources.extract import Registry
from sheafwork.sources.versioned import ConcurrentCommit, VersionedTable


def _schema(said: str) -> T.StructType:
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "vector": T.ArrayType(T.FloatType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in said.split())])


CHUNKS = _schema("collection:string source_id:string document_id:string chunk_key:string ordinal:int char_start:int char_end:int token_count:int heading_path:string text:string text_hash:string recipe_hash:string kind:string page:int embedding:vector")
STATE = _schema("collection:string source_id:string document_id:string content_hash:string recipe_hash:string size_bytes:long modified_utc:string extractor_id:string chunk_count:int status:string error:string last_run_id:string")
FAILURES = _schema("collection:string source_id:string document_id:string content_hash:string error:string run_id:string")
RUNS = _schema("run_id:string collection:string source_id:string recipe_hash:string started_utc:string finished_utc:string outcome:string suspend_reason:string documents_indexed:int chunks_added:int chunks_removed:int error:string")
DOC = state.DOC
#: Failures in a row that end a run, and status values that need no further run.
ABORT_AFTER, FINAL = 20, ("Indexed", "NoTextLayer", "Unsupported", "Failed")
#: Documents between two looks at the clock, where a run's time is limited.
WAVE = 10_000


def recipe_hash(o: chunking.Options, chunker: str, model: str, dimensions: int) -> str:
    """A digest of all that decides what chunks and vectors come out of an extracted text."""
    parts = [chunker, model, str(dimensions), *(f"{k}={v}" for k, v in sorted(vars(o).items()))]
    return hashlib.md5("\x1f".join(parts).encode(), usedforsecurity=False).hexdigest()


@dataclass(frozen=True)
class Budget:
    """What suspends a run, none by default: documents seen (skipped ones, too), chunks added, tokens embedded, seconds.

    A document is begun while what was spent before it is under the budget, and then finished.
    """

    documents: int | None = None
    chunks: int | None = None
    tokens: int | None = None
    seconds: float | None = None


@dataclass
class Result:
    """Counters of a run."""

    run_id: str
    outcome: str
    counts: dict[str, int] = field(default_factory=dict)
    suspend_reason: str | None = None


class Pipeline:
    """Chunks, state and runs of one collection under ``root``.

    A run writes chunks first and then, in its own commit, the state: one that dies in between is
    repeated with the same result, because chunk keys depend on content alone. A document that cannot be extracted or
    chunked is Failed with its error; only ``abort_after`` of them in a row end the run (6010), after what came before is written.
    A document whose stored recipe differs (chunking, model, dimensions, extractor) is embedded anew as a whole, or with
    ``strict_recipe`` the run is refused (6009) before anything is written.
    """

    def __init__(
        self, spark: SparkSession, root: str, collection: str, options: chunking.Options, embedder: embedding.Embedder, dimensions: int, model: str = "hashing", chunker: str = "auto",
        registry: Registry | None = None, strict_recipe: bool = False, trust_times: bool = False, abort_after: int = ABORT_AFTER, most_bytes: int = files.MOST_BYTES, keep_runs: int = 100,
        clock: Callable[[], datetime] = lambda: datetime.now(UTC),
    ):
        self.spark, self.collection, self.o, self.chunker, self.embedder, self.dimensions = spark, collection, options, chunker, embedder, dimensions
        self.registry, self.strict, self.trust_times, self.abort_after, self.most_bytes, self.keep_runs, self.clock = registry or Registry(), strict_recipe, trust_times, abort_after, most_bytes, keep_runs, clock
        self.chunks, self.state = VersionedTable(spark, f"{root}/chunks"), VersionedTable(spark, f"{root}/state")
        self.failures, self.runs = VersionedTable(spark, f"{root}/failures"), VersionedTable(spark, f"{root}/runs")
        self.recipe = recipe_hash(options, chunker, model, dimensions)
        for t, s in ((self.chunks, CHUNKS), (self.state, STATE), (self.failures, FAILURES), (self.runs, RUNS)):
            if not t.version():
                t.commit(add=spark.createDataFrame([], s))

    # -- runs

    def _begin(self, run_id: str, source_id: str) -> str:
        """Write the run's row; it starts strictly later than any run of the collection before it."""
        now = self.clock()
        last = self.runs.read().where(F.col("collection") == self.collection).agg(F.max("started_utc")).first()[0]
        if last is not None and datetime.fromisoformat(last) >= now:
            now = datetime.fromisoformat(last) + timedelta(microseconds=1)
        started = now.astimezone(UTC).isoformat(timespec="microseconds")
        row = (run_id, self.collection, source_id, self.recipe, started, *[None] * 7)
        self.runs.commit(add=self.spark.createDataFrame([row], RUNS))
        return started

    def _finish(self, run_id: str, source_id: str, started: str, outcome: str, reason: str | None, counts: dict[str, int], error: str | None) -> None:
        """Replace the run's row by the finished one, and forget all but the newest ``keep_runs`` of each source."""
        end = self.clock().astimezone(UTC).isoformat(timespec="microseconds")
        row = (run_id, self.collection, source_id, self.recipe, started, end, outcome, reason, counts.get("indexed", 0), counts.get("added", 0), counts.get("removed", 0), error)
        rows = self.runs.read().where(F.col("run_id") != run_id).unionByName(self.spark.createDataFrame([row], RUNS))
        self.runs.commit(add=state.newest_runs(rows, self.keep_runs), overwrite=True)  # at most ``keep_runs`` rows a source

    # -- what is to be done

    def _items(self, items: DataFrame, source_id: str, order: list[str] | None) -> DataFrame:
        """All deliveries with digest, recipe, ``_at`` (their order) and ``duplicate``."""
        has = set(items.columns)
        content = F.col("content") if "content" in has else F.encode(F.col("text"), "UTF-8")
        opt = lambda c, kind: F.col(c).cast(kind) if c in has else F.lit(None).cast(kind)
        d = items.select(
            F.lit(self.collection).alias("collection"), F.lit(source_id).alias("source_id"), F.col("document_id").cast("string").alias("document_id"),
            F.coalesce(opt("media_type", "string"), F.lit("text/plain")).alias("media_type"), opt("path", "string").alias("path"), F.coalesce(opt("size_bytes", "long"), F.octet_length(content).cast("long"), F.lit(0).cast("long")).alias("size_bytes"),
            opt("modified_utc", "string").alias("modified_utc"), content.alias("content"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order or [])],
        )
        # a document over the limit is never read, so it has no digest
        d = d.withColumn("content", F.when(F.col("size_bytes") <= self.most_bytes, F.col("content")))
        d = d.withColumn("content_hash", F.when(F.col("size_bytes") <= self.most_bytes, F.md5(F.coalesce("content", F.lit(b"")))))
        registry = self.registry

        @F.pandas_udf(T.StringType())
        def fingerprint(kind: pd.Series, path: pd.Series) -> pd.Series:
            return pd.Series([registry.fingerprint(k, p if isinstance(p, str) else None) for k, p in zip(kind, path, strict=True)], dtype=object)

        d = d.withColumn("extractor", fingerprint("media_type", "path")).withColumn("recipe_hash", F.md5(F.concat_ws("\x1f", F.lit(self.recipe), "extractor")))
        by = [f"_o{i}" for i in range(len(order or []))]
        d = state.first_delivery(d, [*by, "content_hash", "media_type"])
        at = [*by, "document_id", "content_hash", "media_type"] if by else ["document_id", "content_hash", "media_type"]
        return d.withColumn("_at", F.struct(*at)).drop(*by)

    def _gate(self, seen: DataFrame, now: DataFrame, force: bool) -> DataFrame:
        """``seen`` with ``gate`` (why it is skipped, or null), ``drift`` and what the state says of it."""
        old = now.select("document_id", F.col("content_hash").alias("_c"), F.col("recipe_hash").alias("_r"), F.col("status").alias("_s"), F.col("size_bytes").alias("_z"), F.col("modified_utc").alias("_m"), F.col("error").alias("_e"), F.col("chunk_count").alias("_n"))
        j = seen.join(old, "document_id", "left")
        large = F.col("size_bytes") > self.most_bytes
        dated = (F.col("size_bytes") == F.col("_z")) & (instant(F.col("modified_utc")) == instant(F.col("_m"))) & F.col("modified_utc").isNotNull()
        recipe = F.col("recipe_hash") == F.col("_r")
        gate = F.when(large & (F.col("_s") == "Failed") & (F.col("size_bytes") == F.col("_z")) & F.col("_e").startswith("6052"), "size")
        gate = gate.when((F.col("extractor") == "none") & (F.col("_s") == "Unsupported") & (F.col("_n") == 0) & recipe & dated, "unsupported")
        if self.trust_times:
            gate = gate.when(dated & recipe & F.col("_s").isin(*FINAL), "time")
        gate = gate.when((F.col("content_hash") == F.col("_c")) & recipe & F.col("_s").isin(*FINAL), "content")
        drift = F.coalesce(F.col("_r") != F.col("recipe_hash"), F.lit(False))
        j = j.withColumn("gate", F.lit(None).cast("string") if force else gate)
        return j.withColumn("drift", F.col("gate").isNull() & drift & ~large).withColumn("again", (F.col("content_hash") == F.col("_c")) & F.coalesce(F.col("_n") > 0, F.lit(False))).drop("_c", "_r", "_s", "_z", "_m", "_e", "_n")

    # -- one run

    def run(
        self, items: DataFrame, source_id: str, most_documents: int | None = None, prune: bool = True, order: list[str] | None = None, budget: Budget | None = None,
        only: Column | None = None, force: bool = False, unreadable: list[str] | None = None,
    ) -> Result:
        """One run over a source's items: ``document_id`` and ``text``, or ``content`` (bytes); ``media_type``, ``path``, ``size_bytes`` and ``modified_utc`` if there are.

        Of several deliveries of one document the first in ``order``, columns of ``items``, counts;
        equal ones, or all if there is no order, go by content hash and media type. The others
        are counted as failed (6054) and written to ``failures``; the document's chunks and state are the first's.
        ``only``: a condition on items; what it leaves out isn't looked at, but still lives, so that it isn't pruned.
        ``unreadable``: prefixes of ids that the source couldn't list; what is stored below them is kept. Pruning takes place only after a
        completed run. ``most_documents`` is short for a budget of documents.
        """
        budget = budget or Budget(documents=most_documents)
        run_id, began = uuid.uuid4().hex, time.monotonic()
        started = self._begin(run_id, source_id)
        counts: dict[str, int] = {}
        try:
            outcome, reason, error = self._run(run_id, began, items, source_id, prune, order, budget, only, force, unreadable or [], counts)
        except Exception as e:
            self._finish(run_id, source_id, started, "Failed", None, counts, str(e)[:500])
            raise
        self._finish(run_id, source_id, started, outcome, reason, counts, error)
        if outcome == "Failed":
            raise SheafError(6010, error or "")
        return Result(run_id, outcome, counts, reason)

    def _run(self, run_id: str, began: float, items: DataFrame, source_id: str, prune: bool, order: list[str] | None, budget: Budget, only: Column | None, force: bool, unreadable: list[str], counts: dict[str, int]) -> tuple[str, str | None, str | None]:
        live = items.select(F.lit(self.collection).alias("collection"), F.lit(source_id).alias("source_id"), F.col("document_id").cast("string").alias("document_id"))
        now = self.state.read().where((F.col("collection") == self.collection) & (F.col("source_id") == source_id))
        d = materialize(self._items(items if only is None else items.where(only), source_id, order), "seen")
        outcome, reason, error = "Completed", None, None
        if budget.documents is not None and d.count() > budget.documents:
            d = materialize(state.within_budget(d, ["source_id"], ["_at"], F.lit(1), budget.documents).where("taken").drop("taken"), "in-budget")
            outcome, reason = "Suspended", "budget:documents"
        seen = materialize(self._gate(d.where("NOT duplicate"), now, force), "gated")
        later = d.where("duplicate")
        n_seen, n_later = d.count(), later.count()
        if self.strict and not seen.where("drift").isEmpty():
            raise SheafError(6009, seen.where("drift").agg(F.min("document_id")).first()[0])
        counts |= {"seen": n_seen, "failed": n_later, "indexed": 0, "skipped": seen.where("gate IS NOT NULL").count(), "removed_documents": 0, "added": 0, "removed": 0, "unchanged": 0, "repaired": 0, "tokens": 0, "reembedded": 0}
        if n_later:
            said = F.concat(F.lit("6054: document id '"), F.coalesce("document_id", F.lit("")), F.lit("' was delivered more than once in a run"))
            self.failures.commit(add=later.select(*DOC, "content_hash", said.alias("error"), F.lit(run_id).alias("run_id")))
        todo = seen.where("gate IS NULL")
        waves = [] if todo.isEmpty() else [todo]
        if waves and budget.seconds is not None:
            numbered = materialize(state.running_total(todo, ["source_id"], ["_at"], F.lit(1), "_no"), "waves")
            waves = [numbered.where((F.col("_no") >= k) & (F.col("_no") < k + WAVE)).drop("_no") for k in range(0, max(1, numbered.count()), WAVE)]
        for wave in waves:
            if budget.seconds is not None and time.monotonic() - began >= budget.seconds:
                return "Suspended", "budget:duration", None
            try:
                got = self._process(run_id, wave, seen, source_id, budget, counts)
            except PySparkException as e:
                if "6206" not in str(e):
                    raise
                return "Suspended", "embed:failed", str(e)[:500]
            if got:
                outcome, reason, error = got
                break
        if outcome == "Completed" and prune:
            self._prune(source_id, live, unreadable, counts)
        return outcome, reason, error

    def _process(self, run_id: str, todo: DataFrame, seen: DataFrame, source_id: str, budget: Budget, counts: dict[str, int]) -> tuple[str, str | None, str | None] | None:
        """Extract, chunk, diff, embed and write some documents; the outcome if the run ends with them."""
        at_chunks, at_state = self.chunks.version(), self.state.version()
        readable = todo.where(F.col("content_hash").isNotNull())
        x = materialize(files.extract(readable, self.registry, self.most_bytes), "extracted")
        c = materialize(chunking.chunk_extracted(x.join(readable.select("document_id", "media_type"), "document_id"), self.o, self.chunker), "chunked")
        bad = c.where("error IS NOT NULL").select("document_id", F.col("error").alias("_bad"))
        fail = F.coalesce(F.col("_bad"), F.when(F.col("content_hash").isNull(), F.concat(F.lit("6052: document too large ("), F.col("size_bytes"), F.lit(f" bytes of {self.most_bytes})"))), F.col("x.error"))
        docs = todo.drop("content").join(x.select("document_id", "status", "error", "extractor_id").alias("x"), "document_id", "left").join(bad, "document_id", "left")
        status = F.when(F.col("_bad").isNotNull() | F.col("content_hash").isNull(), "Failed").otherwise(F.col("x.status"))
        docs = docs.select(*DOC, "content_hash", "recipe_hash", "size_bytes", "modified_utc", "x.extractor_id", "_at", "drift", "again", status.alias("status"), F.when(status.isin("Failed", "Unsupported"), fail).alias("error"))
        docs = materialize(docs, "outcomes")
        fresh = c.where("error IS NULL").drop("error").join(docs.where("status = 'Indexed'").select(*DOC, "recipe_hash", "drift"), "document_id")
        fresh = materialize(state.chunk_keys(fresh).withColumn("text_hash", F.md5("embed_text")), "fresh")
        stored = self.chunks.read(at_chunks)
        # a failed document keeps the chunks it has, and so does one that no extractor takes any more while its bytes are the same
        settled = docs.where("status <> 'Failed' AND NOT (status = 'Unsupported' AND coalesce(again, false))")
        mine = stored.join(small_enough(settled.select(*DOC)), DOC, "left_semi")
        where = ["ordinal", "char_start", "char_end"]
        change = state.diff(fresh.select(*DOC, "chunk_key", *where), mine.select(*DOC, "chunk_key", *where), [*DOC, "chunk_key"], where)
        # under another recipe every chunk is new, for its vector depends on that, too
        change = change.join(docs.where("drift").select(*DOC, F.lit(True).alias("_drift")), DOC, "left")
        again = F.col("_drift").isNotNull() & F.col("change").isin("unchanged", "repaired")
        change = materialize(change.select(*DOC, "chunk_key", F.when(again, "added").otherwise(F.col("change")).alias("change"), (again | (F.col("change") == "repaired")).alias("replaces")), "diff")
        ended = None
        # failures in a row, in the order of delivery; a document too large neither extends nor ends a row of them
        if docs.where("status = 'Failed'").count() >= self.abort_after:
            o = seen.select("source_id", "document_id", "_at", "gate").join(docs.select("document_id", "status", "error"), "document_id", "left")
            o = o.where(F.col("gate").isNotNull() | F.col("status").isNotNull()).where(~F.coalesce(F.col("error").startswith("6052"), F.lit(False)))
            stop = state.abort_point(o.withColumn("failed", F.coalesce(F.col("status") == "Failed", F.lit(False))), ["source_id"], ["_at"], self.abort_after).first()
            if stop:
                docs = docs.join(F.broadcast(self.spark.createDataFrame([(stop["_at"],)], T.StructType([T.StructField("_stop", docs.schema["_at"].dataType)]))), F.col("_at") <= F.col("_stop")).drop("_stop")
                ended = ("Failed", None, f"{self.abort_after} failures in a row")
        if budget.chunks is not None or budget.tokens is not None:
            per = fresh.select(*DOC, "chunk_key", "token_count").join(change.where("change = 'added'"), [*DOC, "chunk_key"]).groupBy("document_id").agg(F.count("*").alias("_chunks"), F.sum("token_count").alias("_tokens"))
            docs = docs.join(per, "document_id", "left").fillna(0, ["_chunks", "_tokens"])
            for what, col, most in (("chunks", "_chunks", budget.chunks), ("tokens", "_tokens", budget.tokens)):
                if most is not None and ended is None:
                    spent = counts["added" if what == "chunks" else "tokens"]
                    inside = materialize(state.within_budget(docs, ["source_id"], ["_at"], F.col(col), most - spent), f"within-{what}")
                    if not inside.where("NOT taken").isEmpty():
                        ended = ("Suspended", f"budget:{what}", None)
                    docs = inside.where("taken").drop("taken")
        if ended or budget.chunks is not None or budget.tokens is not None:
            docs = materialize(docs.drop("_chunks", "_tokens"), "docs")
        if ended:
            keep = small_enough(docs.select(*DOC))
            fresh, change = fresh.join(keep, DOC, "left_semi"), change.join(keep, DOC, "left_semi")
        write = fresh.join(change.where(F.col("change").isin("added", "repaired")).select(*DOC, "chunk_key", "change"), [*DOC, "chunk_key"])
        write = materialize(write, "write")
        # vectors are taken over from stored chunks with the same text under the same recipe, in this collection alone
        wanted = write.select("text_hash", "recipe_hash").distinct()
        known = stored.where((F.col("collection") == self.collection) & F.col("embedding").isNotNull()).select("text_hash", "recipe_hash", "chunk_key", "embedding")
        known = known.join(small_enough(wanted), ["text_hash", "recipe_hash"], "left_semi").groupBy("text_hash", "recipe_hash").agg(F.min_by("embedding", "chunk_key").alias("embedding"))
        # a text is one vector whatever the extractor, so the digest that is known by holds the recipe
        known = known.select(F.md5(F.concat_ws("\x1f", "recipe_hash", "text_hash")).alias("hash"), "embedding")
        new = embedding.embed_distinct(write.withColumn("_reuse", F.md5(F.concat_ws("\x1f", "recipe_hash", "text_hash"))), "embed_text", self.embedder, self.dimensions, known=known, by="_reuse")
        new = materialize(new.select(*[(F.array_join("heading_path", " › ") if f.name == "heading_path" else F.col(f.name)).cast(f.dataType).alias(f.name) for f in CHUNKS]), "chunks")
        gone = materialize(change.where((F.col("change") == "removed") | F.col("replaces")).select(*DOC, "chunk_key"), "gone")
        if not new.isEmpty() or not gone.isEmpty():
            self.chunks.commit(add=new, delete_keys=gone, expected=at_chunks)
        for r in change.groupBy("change").count().collect():  # four kinds at most
            counts[r["change"]] += r["count"]
        counts["tokens"] += write.where("change = 'added'").agg(F.coalesce(F.sum("token_count"), F.lit(0))).first()[0]
        counts["reembedded"] += change.where("change = 'added' AND replaces").count()
        per = fresh.groupBy(*DOC).agg(F.count("*").cast("int").alias("_n"))
        kept = stored.join(small_enough(docs.where("status IN ('Failed', 'Unsupported')").select(*DOC)), DOC, "left_semi").join(gone, [*DOC, "chunk_key"], "left_anti").groupBy(*DOC).agg(F.count("*").cast("int").alias("_k"))
        rows = docs.join(per, DOC, "left").join(kept, DOC, "left").withColumn("chunk_count", F.coalesce("_n", "_k", F.lit(0))).withColumn("last_run_id", F.lit(run_id))
        rows = materialize(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STATE]), "state")
        if not rows.isEmpty():
            if self.state.version() != at_state:
                raise ConcurrentCommit("another run is active")
            self.state.commit(add=rows, delete_keys=rows.select(*DOC), expected=at_state)
        by = {r[0]: r[1] for r in rows.groupBy("status").count().collect()}  # four kinds at most
        counts["failed"] += by.get("Failed", 0)
        counts["indexed"] += sum(n for s, n in by.items() if s != "Failed")
        failed = rows.where("status = 'Failed'").select(*DOC, "content_hash", "error", F.lit(run_id).alias("run_id"))
        if by.get("Failed"):
            self.failures.commit(add=failed)
        return ended

    def _prune(self, source_id: str, live: DataFrame, unreadable: list[str], counts: dict[str, int]) -> None:
        """Remove the chunks and state of documents that the source has no more."""
        now = self.state.read().where((F.col("collection") == self.collection) & (F.col("source_id") == source_id)).select(*DOC)
        dead = materialize(state.prune_missing(now, live, True, unreadable).select(*DOC), "dead")
        n = dead.count()
        if n:
            gone = materialize(self.chunks.read().select(*DOC, "chunk_key").join(small_enough(dead), DOC, "left_semi"), "gone")
            counts["removed"] += gone.count()
            self.chunks.commit(delete_keys=dead)
            self.state.commit(delete_keys=dead)
        counts["removed_documents"] = n

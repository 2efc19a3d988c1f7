"""Structured Streaming: incremental ingestion and windowed statistics with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from sheafwork.operators.ingest import Pipeline, Result
from sheafwork.sources.versioned import VersionedTable


def ingest_stream(items: DataFrame, pipeline: Pipeline, source_id: str, checkpoint: str, done: Callable[[Result], None] | None = None, order: list[str] | None = None) -> StreamingQuery:
    """Run the pipeline on every micro-batch of a stream of items.

    A batch that is repeated after a failure finds its documents unchanged in the state and does
    nothing, so each is taken in once. A batch holds only what is new, so nothing is pruned.
    ``order`` says which of several deliveries in a batch is the first.
    """

    def one(batch: DataFrame, _id: int) -> None:
        result = pipeline.run(batch, source_id, prune=False, order=order)
        if done:
            done(result)

    return items.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_stream(rows: DataFrame, table: VersionedTable, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Append every micro-batch to a versioned table exactly once: the batch's number is saved in its commit."""

    def one(batch: DataFrame, number: int) -> None:
        last = int(table.properties().get(f"{name}_batch", "-1")) if table.version() else -1
        if number > last:
            table.commit(add=batch, properties={f"{name}_batch": str(number)})

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts by time window and ``by``; rows later than ``late`` behind the newest are left out."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:  # noqa: ANN001
    return spark.readStream.schema(schema).parquet(path)

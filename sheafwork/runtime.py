"""Session helpers: shared work folder, table writing between stages, size checks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows, and the bytes its plan reads, stay under these bounds; one that reads no more than FEW_BYTES isn't counted.
BROADCAST_ROWS, BROADCAST_BYTES, FEW_BYTES = 200_000, 64 << 20, 2 << 20

_written: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and everything runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sheafwork-")
        spark.conf.set("spark.checkpoint.dir", at)
        _written.append((spark, at))
    return at.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, which is removed when the driver's interpreter ends."""
    path = f"{work_dir(spark)}/sheafwork-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts the lineage, so that an executor lost later costs a re-read and not a
    re-run, and lets several consumers share one computation. The files are
    removed when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = place(spark, name)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its size is known to stay within bounds, else as it is.

    The bytes are the planner's estimate, where it has one: for what is scanned, filtered and grouped it is no less than what comes
    out. The rows are counted, which for a materialised input reads only file footers.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if BROADCAST_BYTES < size < 1 << 60:  # beyond: unknown
        return df
    return F.broadcast(df) if size <= FEW_BYTES or df.count() <= rows else df


def remove_written() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM may be gone already
            return


atexit.register(remove_written)

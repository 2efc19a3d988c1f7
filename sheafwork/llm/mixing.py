"""Mixing sources to target weights by a low-discrepancy schedule.

A mix is a row of slots, each one block of ``block`` tokens. Slot i takes the i-th point of the
golden-ratio sequence to a source through the cumulative weights, so that every stretch of the mix,
not just its whole, has the shares asked for. Slots are ranked within their source, and slot number
r of a source takes block r of its documents: shuffled by a hash, laid end to end, in
another order for each repeat, and cut every ``block`` tokens.

Running totals (ranks of slots, positions of documents) go in two steps, a grouped sum over
buckets and a window within a bucket, so that a source with a third of all rows isn't
sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafwork.functions.text import strip
from sheafwork.runtime import materialize, small_enough

#: Tokens of a block.
BLOCK = 16_384
#: Fixed value: the golden ratio's fractional part, as a multiple of 2**-32.
GOLDEN = 2654435769
#: Documents, and slots, that a bucket of a running total holds on average.
BUCKET = 4096


def name(c: Column) -> Column:
    """A source's name as it compares: trimmed, in lower case."""
    return F.lower(strip(c))


def running_total(df: DataFrame, by: list[str], bucket: str, order: list[str], value: Column, to: str) -> DataFrame:
    """``to``: the sum of ``value`` over the rows before, by (``bucket``, ``order``) within ``by``."""
    v = df.withColumn("_v", value)
    sums = v.groupBy(*by, bucket).agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return v.join(base, [*by, bucket]).withColumn(to, F.col("_base") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_v", "_base")


class Mix:
    """The mixes that ``targets`` asks for, from the documents of ``docs``.

    ``docs``: ``doc_id``, ``text``, ``source``, and any other columns, which are left out. ``targets``:
    ``mix_id``, ``source``, ``weight`` (any scale; null and negative count as 0), ``max_repeats`` (uses
    of a document, the first included; null counts as 1). Names compare trimmed and without
    case; a source stated twice in a mix has the sum of its weights and the larger number
    of repeats. Sizes are UTF-8 bytes; a null text has 0. A mix's total is the size of all
    documents of its sources, each once; a source's target is its share of that. A source that
    cannot reach its target even with all repeats is used up and reported ``short``.
    Documents without a source, or of a source in no mix, take no part. Rows with
    one ``doc_id`` are separate documents. Empty tables give empty results.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, block: int = BLOCK, seed: int = 11):
        self.seed = seed
        self.docs = docs.select("doc_id", name(F.col("source")).alias("src"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")).where("src IS NOT NULL")
        t = targets.where("mix_id IS NOT NULL AND source IS NOT NULL").withColumn("src", name(F.col("source")))
        weight = F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0))
        t = t.groupBy("mix_id", "src").agg(F.min("source").alias("source"), F.sum(weight).alias("weight"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
        sizes = self.docs.groupBy("src").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        every = Window.partitionBy("mix_id")
        p = t.join(sizes, "src", "left").fillna(0, ["size", "n"]).withColumn("total", F.sum("size").over(every))
        p = p.withColumn("share", F.coalesce(F.try_divide("weight", F.sum("weight").over(every)), F.lit(0.0)))
        p = p.withColumn("target", F.col("share") * F.col("total")).withColumn("available", F.col("size") * F.col("max_repeats"))
        p = p.withColumn("short", (F.col("n") == 0) | (F.col("available") < F.col("target")))
        upto = Window.partitionBy("mix_id").orderBy("src")
        p = p.withColumn("high", F.sum("share").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
        p = p.withColumn("block", F.lit(block).cast("long"))
        #: One row per mix and source; as many as ``targets`` has.
        self.plan = materialize(p, "mix-plan")

    def slots(self) -> DataFrame:
        """(``mix_id``, ``slot``, ``src``, ``rank``): the schedule."""
        # a mix's cumulative shares are one array, as long as the list of its sources in ``targets``
        per = self.plan.groupBy("mix_id").agg(F.first("total").alias("total"), F.first("block").alias("block"), F.sort_array(F.collect_list(F.struct("high", "src"))).alias("cum"))
        n = F.ceil(F.col("total") / F.col("block"))
        # explode in two steps, a bucket of slots at a time
        s = per.where(n > 0).select("mix_id", "cum", n.alias("n")).withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BUCKET))))
        s = s.repartition("mix_id", "bucket").withColumn("slot", F.explode(F.sequence(F.col("bucket") * BUCKET, F.least(F.col("n") - 1, F.col("bucket") * BUCKET + BUCKET - 1))))
        u = F.pmod((F.pmod("slot", F.lit(1 << 32)) + 1) * F.lit(GOLDEN), F.lit(1 << 32)) / F.lit(float(1 << 32))
        s = s.withColumn("u", u).withColumn("src", F.expr("try_element_at(filter(cum, c -> c.high > u), 1).src"))
        # rounding may leave the last cumulative share under 1
        s = s.withColumn("src", F.coalesce("src", F.expr("try_element_at(filter(cum, c -> c.high = try_element_at(cum, -1).high), 1).src")))
        return running_total(s.select("mix_id", "bucket", "slot", "src"), ["mix_id", "src"], "bucket", ["slot"], F.lit(1).cast("long"), "rank").select("mix_id", "slot", "src", "rank")

    def blocks(self) -> DataFrame:
        """(``src``, ``repeat``, ``doc_id``, ``size``, ``at``): every source's documents laid end to end, for as many repeats as some mix may need."""
        need = self.plan.where("size > 0").groupBy("src").agg(F.max(F.least("max_repeats", F.ceil(F.col("target") / F.col("size")) + 1)).alias("most"), F.first("size").alias("whole"), F.ceil(F.first("n") / BUCKET).alias("buckets"))
        need = small_enough(materialize(need.where("most > 0"), "mix-need"))
        d = self.docs.join(need, "src").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("most").cast("int") - 1)))
        h = F.xxhash64(F.lit(self.seed), "repeat", "doc_id")
        d = d.withColumn("h", h).withColumn("bucket", F.pmod("h", "buckets").cast("int"))
        d = running_total(d, ["src", "repeat"], "bucket", ["h", "doc_id", "size"], F.col("size"), "at")
        return d.select("src", "repeat", "doc_id", "size", (F.col("at") + F.col("repeat") * F.col("whole")).alias("at"))

    def rows(self) -> DataFrame:
        """The mixes: (``mix_id``, ``slot``, ``source``, ``doc_id``, ``repeat``, ``at``, ``size``), in order of ``slot`` and ``at``.

        A document belongs to the block it begins in. A source stops when its target is reached, to within one document.
        """
        per = small_enough(self.plan.select("mix_id", "src", "source", "target", "max_repeats", "block", F.ceil(F.col("total") / F.col("block")).alias("_end")))
        b = self.blocks().join(per, "src").where((F.col("at") < F.col("target")) & (F.col("repeat") < F.col("max_repeats")))
        b = b.withColumn("rank", F.floor(F.col("at") / F.col("block")))
        # a source's last blocks, for which the schedule has no slot, come at the end
        b = b.join(self.slots(), ["mix_id", "src", "rank"], "left").withColumn("slot", F.coalesce("slot", "_end"))
        return b.select("mix_id", "slot", "source", "doc_id", "repeat", "at", "size")

    def report(self) -> DataFrame:
        """One row per mix and source: what was asked for, what there is and what the mix has."""
        used = self.rows().groupBy("mix_id", "source").agg(F.sum("size").alias("used"), F.count("*").alias("uses"))
        r = self.plan.join(small_enough(materialize(used, "mix-used")), ["mix_id", "source"], "left").fillna(0, ["used", "uses"])
        all_used = F.sum("used").over(Window.partitionBy("mix_id"))
        return r.select("mix_id", "source", "share", "target", "available", "n", "short", "used", "uses", F.coalesce(F.try_divide("used", all_used), F.lit(0.0)).alias("share_reached"))


def mix(spark: SparkSession, sf_dir: str) -> Mix:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return Mix(docs, spark.read.parquet(f"{sf_dir}/mix_target.parquet"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a mix that cannot reach their share: those that the mix has used up, with all repeats, below it, or that have no document."""
    return mix(spark, sf_dir).report().where("used < target OR n = 0").select("mix_id", "source")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked and reached shares of every source of every mix."""
    r = mix(spark, sf_dir).report()
    return r.select("mix_id", "source", F.round("share", 6).alias("share"), F.round("share_reached", 6).alias("share_reached"), "used", "uses", "available", "short")


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every source of every mix: whether the mix has as much of it as asked for or all there is, to within a document, and no document more often than allowed."""
    m = mix(spark, sf_dir)
    uses = m.rows().groupBy("mix_id", "source", "doc_id").agg(F.count("*").alias("uses"), F.sum("size").alias("size"), F.max("size").alias("longest"))
    per = uses.groupBy("mix_id", "source").agg(F.max("uses").alias("uses"), F.sum("size").alias("used"), F.max("longest").alias("longest"))
    p = m.plan.join(small_enough(materialize(per, "mix-limits")), ["mix_id", "source"], "left").fillna(0, ["uses", "used", "longest"])
    wanted = F.least(F.col("target"), F.col("available").cast("double"))
    near = (F.col("used") >= wanted - 1e-6) & ((F.col("used") - F.col("longest") < wanted) | (F.col("used") == 0))
    return p.select("mix_id", "source", near.alias("near"), (F.col("uses") <= F.col("max_repeats")).alias("within_repeats"))

"""Conversation operators over tables of messages: history reduction, prompts, stop sequences, memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.functions.text import token_estimate

#: Limits of a history.
MOST_TURNS, MOST_TOKENS, PROTECTED = 8, 1024, 2
#: Context lengths to try, bytes of workspace and reserve, and the share of memory that may be used.
LADDER, WORKSPACE, RESERVE, SHARE = (4096, 3072, 2048, 1536, 1024), 192 << 20, 192 << 20, 0.60


def reduce_history(messages: DataFrame, by: str, order: str, most_turns: int = MOST_TURNS, most_tokens: int = MOST_TOKENS, protected: int = PROTECTED, pinned: Column | None = None) -> DataFrame:
    """Messages with ``kept``: whether a message stays.

    A group begins at a user's turn; whole groups go, the oldest first, until at most ``most_turns`` of them and
    ``most_tokens`` of all messages are left. System and pinned messages never go though their tokens count, and a
    group with one of the last ``protected`` messages ends it. In closed form, by running sums.
    """
    m = messages.withColumn("_exempt", (F.col("role") == "system") | (F.lit(False) if pinned is None else F.coalesce(pinned, F.lit(False))))
    w = Window.partitionBy(by).orderBy(order)
    whole = Window.partitionBy(by)
    m = m.withColumn("_tok", token_estimate(F.col("text"))).withColumn("_total", F.sum("_tok").over(whole)).withColumn("_back", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order))))
    # a group starts at a user's message or at the first that may go
    m = m.withColumn("_free", F.sum((~F.col("_exempt")).cast("int")).over(w))
    start = ~F.col("_exempt") & ((F.col("role") == "user") | (F.col("_free") == 1))
    m = m.withColumn("_g", F.when(~F.col("_exempt"), F.sum(start.cast("int")).over(w)))
    g = m.where(F.col("_g").isNotNull()).groupBy(by, "_g").agg(F.sum("_tok").alias("_c"), F.max("_total").alias("_total"), F.min("_back").alias("_back"))
    gw = Window.partitionBy(by).orderBy("_g")
    g = g.withColumn("_gone", F.sum("_c").over(gw)).withColumn("_n", F.count("*").over(whole)).withColumn("_stop", F.min(F.when(F.col("_back") <= protected, F.col("_g"))).over(whole))
    enough = (F.col("_n") - F.col("_g") <= most_turns) & (F.col("_total") - F.col("_gone") <= most_tokens)
    before = F.coalesce(F.col("_stop"), F.col("_n") + 1)
    # nothing goes if the history fits as it is
    fits = (F.col("_n") <= most_turns) & (F.col("_total") <= most_tokens)
    cut = g.groupBy(by).agg(F.max(fits).alias("_fits"), F.min(F.when(enough & (F.col("_g") < before), F.col("_g"))).alias("_cut"), (F.max(before) - 1).alias("_last"))
    cut = cut.select(by, F.when(F.col("_fits"), 0).otherwise(F.coalesce("_cut", "_last")).alias("_upto"))
    out = m.join(cut, by, "left")
    kept = F.col("_exempt") | (F.col("_g") > F.coalesce("_upto", F.lit(0)))
    return out.select(*messages.columns, kept.alias("kept"))


def prompt(messages: DataFrame, by: str, order: str, system: str | None = None, instructions: str | None = None) -> DataFrame:
    """(``by``, ``prompt``): leading system messages, the configured ones, the rest, as ``role: text`` lines and the assistant's turn."""
    w = Window.partitionBy(by).orderBy(order)
    lead = F.sum((F.col("role") != "system").cast("int")).over(w) == 0
    line = F.concat("role", F.lit(": "), "text", F.lit("\n"))
    m = messages.withColumn("_lead", lead).withColumn("_line", line)
    parts = m.groupBy(by).agg(F.array_sort(F.collect_list(F.when(F.col("_lead"), F.struct(F.col(order).alias("o"), F.col("_line").alias("t"))))).alias("a"), F.array_sort(F.collect_list(F.when(~F.col("_lead"), F.struct(F.col(order).alias("o"), F.col("_line").alias("t"))))).alias("b"))
    extra = "".join(f"system: {s}\n" for s in (system, instructions) if s)
    text = lambda c: F.array_join(F.transform(c, lambda p: p["t"]), "")
    return parts.select(by, F.concat(text("a"), F.lit(extra), text("b"), F.lit("assistant: ")).alias("prompt"))


def stopped(text: Column, stops: list[str]) -> Column:
    """Text up to the first of the stop sequences; all of it if none is there."""
    if not stops:
        return text
    at = F.array_min(F.filter(F.array(*[F.instr(text, s) for s in stops if s]), lambda p: p > 0))
    return F.when(at.isNull(), text).otherwise(F.substring(text, F.lit(1), at - 1))


def memory_ladder(shapes: DataFrame, ladder: list[int] | tuple[int, ...] = LADDER, workspace: int = WORKSPACE, reserve: int = RESERVE, share: float = SHARE) -> DataFrame:
    """(``name``, ``context``, ``required``): the first context length that fits the memory there is; 0 if none does.

    ``shapes``: ``name``, ``weights``, ``layers``, ``heads``, ``head_size``, ``element_bytes``, ``available``. A token's cache takes
    layers x 2 x heads x head size x bytes.
    """
    per = F.col("layers").cast("long") * 2 * F.col("heads") * F.col("head_size") * F.col("element_bytes")
    need = lambda n: F.col("weights") + per * n + F.lit(workspace) + F.lit(reserve)
    usable = F.floor(F.col("available") * F.lit(share))
    rungs = F.array(*[F.lit(x).cast("long") for x in sorted(ladder, reverse=True)])
    fit = F.filter(rungs, lambda n: need(n) <= usable)
    context = F.coalesce(F.get(fit, F.lit(0)), F.lit(0).cast("long"))
    return shapes.select("name", context.alias("context"), need(F.when(context > 0, context).otherwise(F.lit(min(ladder)).cast("long"))).alias("required"))

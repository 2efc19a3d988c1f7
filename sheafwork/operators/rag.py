"""Retrieval-augmented answering over tables: keywords, ranking, context, citations, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.errors import SheafError
from sheafwork.functions.filters import Predicate
from sheafwork.operators.collection import Collection
from sheafwork.operators.search import MOST_NEIGHBOURS

#: Words too common to search for.
STOP_WORDS = "the and for are but not you your was were with that this these those from into how what when where which who why can does did has have had its it's our out about".split()
#: Limits and texts of the context block.
MOST_KEYWORDS, MOST_CHARS, MOST_TOKENS, MOST_TITLE = 8, 1200, 1024, 200
SUFFIX, HEADING, INDENT, DIVIDER = "…(truncated)", "## Additional context", "    ", "---"
CONTEXT_PROMPT = "Answer using ONLY the numbered sources below. If they do not contain the answer, say you could not find it. Be concise."
CITATION_PROMPT = "Cite every claim with the bracketed number of its source, like [1]. Do not invent source numbers."
NO_RESULTS = "I could not find anything in the available sources that answers that."


def keywords(text: Column, most: int = MOST_KEYWORDS) -> Column:
    """Runs of letters of at least three, without stop words; of words equal but for case the first; at most ``most``."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{L}+"), F.lit(0))
    good = F.filter(runs, lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(STOP_WORDS))
    low = F.transform(good, lambda w: F.lower(w))
    return F.slice(F.filter(good, lambda w, i: F.array_position(low, F.lower(w)) == i + 1), 1, most)


def query_text(messages: DataFrame, by: str, order: str, every: bool = False) -> DataFrame:
    """(``by``, ``query``): the last user message of a conversation, or all of them, a line each."""
    user = messages.where(F.col("role") == "user")
    if not every:
        return user.groupBy(by).agg(F.max_by("text", order).alias("query"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    return user.groupBy(by).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("query"))


def clamp(text: Column, most: int) -> Column:
    """At most ``most`` characters and a suffix that says so; a text clamped already stays."""
    if most <= 0:
        return F.lit(SUFFIX)
    done = (F.length(text) <= most + len(SUFFIX)) & text.endswith(SUFFIX)
    return F.when((F.length(text) <= most) | done, text).otherwise(F.concat(F.substring(text, 1, most), F.lit(SUFFIX)))


def ranked(sources: DataFrame, by: str, most_chars: int = MOST_CHARS) -> DataFrame:
    """Sources with ``ordinal`` 1..n within ``by``, distances ascending and relevances descending, equal ones as retrieved (``position``); texts clamped."""
    score = F.when(F.col("score_kind") == "Distance", F.col("score")).otherwise(-F.col("score"))
    w = Window.partitionBy(by).orderBy(score, "position")
    return sources.withColumn("ordinal", F.row_number().over(w)).withColumn("text", clamp(F.col("text"), most_chars))


def one_line(text: Column, most: int | None = None) -> Column:
    """Text on one line; with ``most``, cut there with an ellipsis."""
    t = F.regexp_replace(F.regexp_replace(text, "^[\\p{Cntrl}  ]+|[\\p{Cntrl}  ]+$", ""), "[\\p{Cntrl}  ]+", " ")
    return t if most is None else F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def context_blocks(sources: DataFrame, by: str, most_tokens: int = MOST_TOKENS, context_prompt: str = CONTEXT_PROMPT, citation_prompt: str = CITATION_PROMPT) -> DataFrame:
    """(``by``, ``context``, ``included``): as many of the best sources as the budget holds, rendered.

    ``sources``: as from ``ranked``, with ``title`` and ``uri`` or null. Sources are dropped from the
    tail until the block fits; ``included`` is 0 and ``context`` null where not even the first fits. A query has
    as many sources as its retriever's page, so they are one array.
    """
    lf = F.lit("\n")
    title = F.when(F.coalesce(F.length("title"), F.lit(0)) > 0, F.concat(F.lit(" Title: "), one_line(F.col("title"), MOST_TITLE))).otherwise(F.lit(""))
    uri = F.when(F.col("uri").isNotNull(), F.concat(F.lit(INDENT + "Source: "), one_line(F.col("uri")), lf)).otherwise(F.lit(""))
    body = F.concat(F.lit(INDENT), F.regexp_replace(F.regexp_replace(F.col("text"), "\r(?=\n|$)", ""), "\n", "\n" + INDENT), lf)
    entry = F.concat(lf, F.lit("["), F.col("ordinal").cast("string"), F.lit("]"), title, lf, uri, F.lit(INDENT + DIVIDER), lf, body)
    head = HEADING + "\n" + (context_prompt + "\n" if context_prompt else "")
    tail = "\n" + citation_prompt if citation_prompt else ""
    # the block is the head, the best entries and the tail, so its length is a running sum
    upto = F.sum(F.length("_e")).over(Window.partitionBy(by).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.lit(len(head) + len(tail)) + F.col("_upto")
    e = sources.select(by, "ordinal", entry.alias("_e")).withColumn("_upto", upto).withColumn("_fits", F.floor((whole + 3) / 4) <= most_tokens)
    best = F.array_sort(F.collect_list(F.when(F.col("_fits"), F.struct("ordinal", "_e"))))
    g = e.groupBy(by).agg(best.alias("_es")).withColumn("included", F.size("_es"))
    block = F.concat(F.lit(head), F.array_join(F.transform("_es", lambda x: x["_e"]), ""), F.lit(tail))
    return g.select(by, F.when(F.col("included") > 0, block).alias("context"), "included")


def require_context(blocks: DataFrame) -> DataFrame:
    """``blocks``, with an error at run time for one that holds no source."""
    return blocks.withColumn("context", F.when(F.col("included") > 0, F.col("context")).otherwise(F.raise_error(F.lit(str(SheafError(7204)))).cast("string")))


class Retriever:
    """Sources for a question from a collection: by both lanes where it has full text, the question has keywords and hybrid search is preferred, else by vectors.

    Each source has its ``score`` and ``score_kind`` (Relevance of the hybrid lane, where more is better; Distance of the vector lane), ``position`` and
    the record's columns. The threshold is applied with the lane's polarity. Asking for more than ``most`` candidates is an error (7202), and so is
    ``require_hybrid`` on a collection without full text (7203).
    """

    def __init__(self, collection: Collection, prefer_hybrid: bool = True, require_hybrid: bool = False, predicate: Predicate | None = None, threshold: float | None = None, most: int = MOST_NEIGHBOURS, text: str | None = None):
        self.c, self.prefer, self.require, self.predicate, self.threshold, self.most, self.text = collection, prefer_hybrid, require_hybrid, predicate, threshold, most, text

    def retrieve(self, question: list[float] | str, words: list[str] | None = None, top: int = 5, skip: int = 0, threshold: float | None = None, **kw) -> DataFrame:  # noqa: ANN003
        if top < 1 or skip < 0:
            raise ValueError("top must be positive and skip not negative")
        if top + skip > self.most:
            raise SheafError(7202, f"{top + skip} candidates, {self.most} at most")
        can = bool(self.c.d.full_text)
        if self.require and not can:
            raise SheafError(7203, "no full-text column")
        words = [w for w in words or [] if w and w.strip()]
        limit = self.threshold if threshold is None else threshold
        key = self.c.d.key
        if can and self.prefer and words:
            got = self.c.hybrid(question, words, top, skip, self.text, predicate=self.predicate, least_score=limit, **kw).withColumn("score_kind", F.lit("Relevance"))
            order = Window.orderBy(F.desc("score"), key)  # a page
        else:
            got = self.c.search(question, top, skip, predicate=self.predicate, **kw).withColumnRenamed("distance", "score").withColumn("score_kind", F.lit("Distance"))
            got = got if limit is None else got.where(F.col("score") <= limit)
            order = Window.orderBy("score", key)  # a page
        return got.withColumn("position", F.row_number().over(order))


def citations(answers: DataFrame, sources: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(``by``, ``ordinal``, ``place``, ``starts``) of each cited source, and (``by``, ``unresolved``) of markers that name none.

    ``place`` numbers sources by their first marker. Offsets are code points; they follow from the lengths of what
    lies between markers, so nothing leaves the JVM.
    """
    a = answers.select(by, F.split("answer", r"\[\d+\]", -1).alias("_gaps"), F.regexp_extract_all("answer", F.lit(r"\[\d+\]"), F.lit(0)).alias("_marks"))
    m = a.select(by, "_gaps", "_marks", F.posexplode("_marks").alias("_i", "_m"))
    upto = F.aggregate(F.slice("_gaps", F.lit(1), F.col("_i") + 1), F.lit(0), lambda s, g: s + F.length(g)) + F.aggregate(F.slice("_marks", F.lit(1), F.col("_i")), F.lit(0), lambda s, g: s + F.length(g))
    m = m.select(by, upto.alias("start"), F.regexp_extract("_m", r"\d+", 0).try_cast("int").alias("ordinal"))
    j = m.alias("m").join(sources.select(F.col(by).alias("_by"), F.col("ordinal").alias("_o")).distinct().alias("s"), (F.col(f"m.{by}") == F.col("_by")) & (F.col("m.ordinal") == F.col("_o")), "left")
    lost = j.where(F.col("_o").isNull()).groupBy(by).agg(F.count("*").alias("unresolved"))
    c = j.where(F.col("_o").isNotNull()).groupBy(by, "ordinal").agg(F.sort_array(F.collect_list("start")).alias("starts"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.element_at("starts", 1)))
    return c.withColumn("place", place).select(by, "ordinal", "place", "starts"), lost


def extractive_answer(sources: DataFrame, by: str, most: int = 3, most_chars: int = 600) -> DataFrame:
    """(``by``, ``answer``): the first sources' texts with their markers, a blank line between."""
    s = sources.where(F.col("ordinal") <= most).withColumn("_t", F.concat(clamp(F.col("text"), most_chars), F.lit(" ["), F.col("ordinal").cast("string"), F.lit("]")))
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "_t")))
    return s.groupBy(by).agg(F.array_join(F.transform(parts, lambda p: p["_t"]), "\n\n").alias("answer"))


def answered(queries: DataFrame, answers: DataFrame, by: str) -> DataFrame:
    """Every query with its answer, or the one for no results, and whether it is ``grounded`` in sources."""
    return queries.select(by).join(answers, by, "left").select(by, F.coalesce("answer", F.lit(NO_RESULTS)).alias("answer"), F.col("answer").isNotNull().alias("grounded"))


def injected(messages: DataFrame, blocks: DataFrame, by: str, order: str) -> DataFrame:
    """Messages with the context as a system message right before the newest user message."""
    at = messages.where(F.col("role") == "user").groupBy(by).agg(F.max(order).alias("_at"))
    new = blocks.where(F.col("context").isNotNull()).join(at, by).select(by, (F.col("_at") - 0.5).alias(order), F.lit("system").alias("role"), F.col("context").alias("text"))
    return messages.select(by, F.col(order).cast("double").alias(order), "role", "text").unionByName(new)

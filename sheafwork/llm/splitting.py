"""Splitting oversized texts at natural boundaries, by valleys of lexical cohesion, with overlap.

Tokens are counted inside the JVM, so that only texts over their limit reach Python. There
a block of units before and one after slides over the text; how alike the two are, at each
natural boundary, makes a curve whose valleys mark changes of topic. From the start of a
piece, every boundary in the second half of what still fits, and beyond the overlap, is a candidate, of the best
kind there is: blank lines and sentence ends, else line breaks, else white space, else any
token; the one in the deepest valley is cut. The next piece begins so many tokens earlier
that it shares the overlap, moved to a word's start.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.functions.text import WHITE_SPACE
from sheafwork.runtime import small_enough

#: Letters and digits of a run that make one token.
RUN = 8
TOKEN = re.compile(rf"[^\W_]{{1,{RUN}}}|[^{WHITE_SPACE}]")
#: What cohesion compares: words, and single characters of scripts that don't part words.
UNIT = re.compile(r"[฀-๿]{3}|[぀-ヿ㐀-鿿豈-﫿]|[^\W_]+")
BLANK_LINE = re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*")
SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？।؟۔]+[」』”’）]*\s*")
LINE = re.compile(r"[\r\n]+\s*")
SPACE = re.compile(rf"[{WHITE_SPACE}]+")
#: Kinds of boundary, best first, and what each adds to a valley's depth.
BONUS = (0.30, 0.15, 0.0, 0.0)


def token_count(text: Column) -> Column:
    """Tokens of a text: one for every started eight of a run of letters and digits, one for any other character but white space."""
    return F.regexp_count(text, F.lit(rf"[\p{{L}}\p{{N}}]{{1,{RUN}}}|[^\p{{L}}\p{{N}}{WHITE_SPACE}]"))


def tokens(text: str) -> list[int]:
    """Where each token starts; they tile everything but white space."""
    return [m.start() for m in TOKEN.finditer(text)]


def boundaries(text: str) -> list[list[int]]:
    """Positions after blank lines, sentence ends, line breaks and white space, each list in order."""
    out = [[m.end() for m in p.finditer(text)] for p in (BLANK_LINE, SENTENCE, LINE, SPACE)]
    return [[p for p in ps if 0 < p < len(text)] for ps in out]


def cohesion(text: str, at: list[int], block: int) -> np.ndarray:
    """Cosine of the ``block`` units before and after each position of ``at`` (in order)."""
    units = [(m.start(), m.group().lower()) for m in UNIT.finditer(text)]
    starts, names = [u[0] for u in units], [u[1] for u in units]
    left: dict[str, int] = {}
    right: dict[str, int] = {}
    dot = nl = nr = 0
    for u in names[:block]:
        c = right.get(u, 0)
        nr += 2 * c + 1
        right[u] = c + 1
    out = np.zeros(len(at))
    i, n = 0, len(names)
    for k, p in enumerate(at):
        to = bisect_left(starts, p)
        while i < to:
            u = names[i]  # it leaves the right block
            c = right[u]
            nr -= 2 * c - 1
            dot -= left.get(u, 0)
            right[u] = c - 1
            if i + block < n:  # another one enters it
                v = names[i + block]
                c = right.get(v, 0)
                nr += 2 * c + 1
                dot += left.get(v, 0)
                right[v] = c + 1
            c = left.get(u, 0)  # and joins the left block
            nl += 2 * c + 1
            dot += right.get(u, 0)
            left[u] = c + 1
            if i - block >= 0:
                v = names[i - block]
                c = left[v]
                nl -= 2 * c - 1
                dot -= right.get(v, 0)
                left[v] = c - 1
            i += 1
        out[k] = dot / math.sqrt(nl * nr) if nl and nr else 0.0
    return out


def depths(score: np.ndarray) -> np.ndarray:
    """How far each point lies below the peaks that the curve climbs to on its two sides."""
    n = len(score)
    peak_l, peak_r = score.copy(), score.copy()
    for k in range(1, n):
        if score[k - 1] >= score[k]:
            peak_l[k] = peak_l[k - 1]
    for k in range(n - 2, -1, -1):
        if score[k + 1] >= score[k]:
            peak_r[k] = peak_r[k + 1]
    return (peak_l - score) + (peak_r - score)


def joined(text: str, p: int) -> bool:
    """Whether a cut at ``p`` would part a character from its marks."""
    if not 0 < p < len(text):
        return False
    c, before = text[p], text[p - 1]
    return unicodedata.category(c)[0] == "M" or c in "‍︎️" or before == "‍" or (before == "\r" and c == "\n")


def pieces(text: str, limit: int, overlap: int, block: int = 40) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens, overlapping tokens) of pieces of at most ``limit`` tokens each.

    Consecutive pieces share ``overlap`` tokens, less at most the word that the shared stretch would
    begin in; together they cover every token. The overlap must be smaller than the limit, since a
    piece has to go on beyond it. A text within the limit is one piece, one without tokens none.
    """
    limit, overlap = max(1, limit), max(0, overlap)
    if overlap >= limit:
        raise ValueError(f"an overlap of {overlap} tokens leaves nothing new in pieces of {limit}")
    at = tokens(text)
    n = len(at)
    if not n:
        return []
    if n <= limit:
        return [(at[0], len(text.rstrip()), n, 0)]
    kinds = boundaries(text)
    best: dict[int, int] = {}
    for kind in (2, 1, 0):
        for p in kinds[kind]:
            best[p] = kind
    # by number of tokens before them; white space counts only where nothing better is there
    natural = sorted(best)
    good = [p for p in natural if best[p] < 2]
    depth = dict(zip(good, depths(cohesion(text, good, block)), strict=True)) if good else {}
    places = [[bisect_left(at, p) for p in ps] for ps in (good, [p for p in natural if best[p] == 2], kinds[3])]
    chars = [good, [p for p in natural if best[p] == 2], kinds[3]]

    def cut(lo: int, hi: int) -> int:
        """The token number in lo..hi before which to cut."""
        for rank, (ps, cs) in enumerate(zip(places, chars, strict=True)):
            a, b = bisect_left(ps, lo), bisect_right(ps, hi)
            if a < b:
                if rank == 0:
                    return ps[max(range(a, b), key=lambda k: (depth[cs[k]] + BONUS[best[cs[k]]], ps[k]))]
                return ps[b - 1]
        k = hi
        while k > lo and joined(text, at[k]):
            k -= 1
        return k if k > lo or not joined(text, at[lo]) else hi

    out: list[tuple[int, int, int, int]] = []
    start = done = 0  # token numbers: where the piece starts, and up to where earlier ones reach
    while True:
        if n - start <= limit:
            out.append((at[start], len(text.rstrip()), n - start, done - start))
            return out
        hi = start + limit
        end = cut(min(hi, max(done + 1, start + limit // 2, start + overlap + 1)), hi)
        out.append((at[start], _end(text, at[end]), end - start, done - start))
        back = max(start + 1, end - overlap)
        words = [p for p in kinds[3][bisect_left(kinds[3], at[back]) : bisect_right(kinds[3], at[end])]]
        nxt = bisect_left(at, words[0]) if words else back
        while nxt < end and joined(text, at[nxt]):
            nxt += 1
        start, done = min(nxt, end), end


def _end(text: str, p: int) -> int:
    while p > 0 and text[p - 1].isspace():
        p -= 1
    return p


def split_oversized(df: DataFrame, limits: DataFrame, text: str = "text", by: str = "collection") -> DataFrame:
    """``df``'s rows with their text cut into pieces within the limit of their ``by``.

    ``limits``: ``by``, ``max_tokens``, ``overlap_tokens``. Every row comes once per piece, all its
    other columns kept, with ``text`` and ``token_count`` those of the piece (a ``token_count`` that was
    there is replaced), ``piece`` (from 0), ``pieces``, ``piece_start`` and ``piece_end`` (code points
    in the text as stored) and ``piece_overlap`` (tokens shared with the piece before). A row within its limit,
    or with no limit, keeps its text as it is, in one piece; a null text, too, with 0
    tokens. Of a limit stated twice the smaller one holds. An overlap that isn't smaller than its
    limit is an error as soon as a text is to be cut under it. Equal rows stay as many.
    """
    own = ["piece", "pieces", "piece_start", "piece_end", "piece_overlap", "token_count", text]
    keep = [c for c in df.columns if c not in own]
    lim = limits.groupBy(F.col(by).alias("_by")).agg(F.min("max_tokens").alias("_max"), F.min("overlap_tokens").alias("_over"))
    d = df.select(*keep, F.col(text).alias("_text"), F.coalesce(token_count(F.col(text)), F.lit(0)).alias("_n"))
    d = d.join(small_enough(lim), F.col(by) == F.col("_by"), "left").drop("_by")
    over = F.col("_max").isNotNull() & (F.col("_n") > F.greatest(F.col("_max"), F.lit(1)))
    whole = d.where(~over).select(*keep, F.col("_text").alias(text), F.col("_n").alias("token_count"), F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.lit(0).alias("piece_start"), F.coalesce(F.length("_text"), F.lit(0)).alias("piece_end"), F.lit(0).alias("piece_overlap"))
    long = d.where(over)
    n_keep = len(keep)
    schema = T.StructType([*long.select(*keep).schema.fields, *T._parse_datatype_string(f"`{text}` string, token_count int, piece int, pieces int, piece_start int, piece_end int, piece_overlap int").fields])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, got = [], []
            for i, (t, m, o) in enumerate(zip(b.column(n_keep).to_pylist(), b.column(n_keep + 2).to_pylist(), b.column(n_keep + 3).to_pylist(), strict=True)):
                ps = pieces(t, m, o or 0)
                rows += [i] * len(ps)
                got += [(t[a:z], n, k, len(ps), a, z, w) for k, (a, z, n, w) in enumerate(ps)]
            cols = [b.column(c).take(pa.array(rows, pa.int64())) for c in range(n_keep)]
            made = list(zip(*got, strict=True)) if got else [()] * 7
            cols += [pa.array(made[0], pa.string()), *[pa.array(x, pa.int32()) for x in made[1:]]]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    split = long.select(*keep, "_text", "_n", "_max", "_over").mapInArrow(of, schema)
    return whole.unionByName(split)


def split_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = spark.read.parquet(f"{sf_dir}/chunk_draft.parquet")
    return split_oversized(drafts.select("draft_id", "collection", "heading_path", "text"), spark.read.parquet(f"{sf_dir}/collection_profile.parquet"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of more tokens than their collection allows: those that came out in several pieces."""
    return split_drafts(spark, sf_dir).where("pieces > 1 AND piece = 0").select("draft_id").distinct()


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all drafts."""
    return split_drafts(spark, sf_dir).select("draft_id", "piece", "pieces", "heading_path", "text", "token_count", "piece_start", "piece_end", "piece_overlap")


def cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every draft: the tokens that its pieces cover, each counted once, whether it is whole, and how many pieces are over their limit."""
    limits = spark.read.parquet(f"{sf_dir}/collection_profile.parquet").select("collection", "max_tokens")
    p = split_drafts(spark, sf_dir).join(small_enough(limits), "collection", "left")
    return p.groupBy("draft_id").agg(F.sum(F.col("token_count") - F.col("piece_overlap")).alias("tokens"), (F.max("pieces") == 1).alias("whole"), F.count_if(F.col("token_count") > F.col("max_tokens")).alias("over"))

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheafwork.llm import splitting as S


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc dé.\n!?́中。ก็ _-", max_size=400), st.integers(1, 40), st.integers(0, 30))
def test_pieces(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    got = S.pieces(text, limit, overlap)
    at = 0
    for k, (a, z, n, o) in enumerate(got):
        assert n == len(S.tokens(text[a:z])) <= limit and not text[at:a].strip()
        assert 0 <= o <= overlap and (k or not o)
        assert not text[a].isspace() and not text[z - 1].isspace()
        at = max(at, z)
    assert not text[at:].strip()
    assert len(got) == (0 if not S.tokens(text) else 1 if len(S.tokens(text)) <= limit else len(got)) and all(a[0] < b[0] for a, b in zip(got, got[1:], strict=False))


def test_cuts_at_changes_of_topic():
    pump = "The pump lifts water. The pump needs oil. Water leaves the pump. "
    moon = "The moon rose late. A moon has phases. Stars dim by the moon. "
    text = pump * 3 + moon * 3
    a, z, _, _ = S.pieces(text, 60, 0, block=15)[0]
    assert text[a:z].endswith(".") and abs(z - len(pump * 3)) <= 22


def test_no_boundaries_and_long_texts():
    got = S.pieces("A" * 5000, 100, 10)
    assert all(n <= 100 for _, _, n, _ in got) and {o for *_, o in got[1:]} == {10}
    assert len(S.pieces("word. " * 50_000, 200, 20)) > 200
    assert S.pieces("", 5, 1) == [] and S.pieces("  \n", 5, 1) == []


def test_marks_stay_with_their_letters():
    text = "é" * 40
    assert all(text[a] != "́" for a, *_ in S.pieces(text, 7, 2))


def test_count_is_the_same_in_sql(spark):
    texts = ["", "a", "abcdefghi", "x_y-z", "é中文字字字字字字字", "ก็ ข้", "a\u2003b\u00a0c\x1c", "1234567890 ab", "\U0001f600\U0001d54f"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", S.token_count(F.col("t")).alias("n")).collect()}
    assert got == {i: len(S.tokens(t)) for i, t in enumerate(texts)}


def test_rows(spark):
    df = spark.createDataFrame([(1, "c", "a b c d e f", ["h"], 9), (2, "c", None, None, None), (3, "x", "a b c d e f", [], 1), (4, "c", "a", None, 0), (4, "c", "a", None, 0), (5, None, "a b c d e f g", None, 0)], "id long, collection string, text string, heading_path array<string>, token_count int").withColumn("piece", F.lit("z")).withColumn("_extra", F.lit(1))
    lim = spark.createDataFrame([("c", 4, 1), ("c", 5, 1)], "collection string, max_tokens int, overlap_tokens int")
    got = S.split_oversized(df, lim)
    rows = sorted((r["id"], r["piece"], r["pieces"], r["text"], r["token_count"], r["piece_overlap"]) for r in got.where("id <> 2").collect())
    assert rows == [(1, 0, 2, "a b c d", 4, 0), (1, 1, 2, "d e f", 3, 1), (3, 0, 1, "a b c d e f", 6, 0), (4, 0, 1, "a", 1, 0), (4, 0, 1, "a", 1, 0), (5, 0, 1, "a b c d e f g", 7, 0)]
    null = got.where("id = 2").first()
    assert null["text"] is None and null["token_count"] == 0 and null["_extra"] == 1
    assert [r["heading_path"] for r in got.where("id = 1").collect()] == [["h"], ["h"]]
    assert S.split_oversized(df.limit(0), lim).count() == 0 and S.split_oversized(df, lim.limit(0)).count() == 6


@pytest.mark.parametrize("n", [1, 2, 10])
def test_cohesion_matches_brute_force(n):
    import math
    from collections import Counter

    text = "a b c a b d e f a b x y z x y q r x y z"
    units = text.split()
    at = [i * 2 for i in range(1, len(units))]
    got = S.cohesion(text, at, n)
    for k, g in enumerate(got, 1):
        left, right = Counter(units[max(0, k - n) : k]), Counter(units[k : k + n])
        dot = sum(left[w] * right[w] for w in left)
        assert g == pytest.approx(dot / math.sqrt(sum(v * v for v in left.values()) * sum(v * v for v in right.values())))


def test_overlap_is_kept_beyond_half_the_limit():
    text = " ".join(f"w{i}" for i in range(300))
    for limit, overlap in ((50, 40), (50, 25), (50, 26), (50, 49), (2, 1)):
        got = S.pieces(text, limit, overlap)
        assert {o for *_, o in got[1:-1]} == {overlap} and all(n <= limit for _, _, n, _ in got), (limit, overlap)
    with pytest.raises(ValueError, match="overlap"):
        S.pieces(text, 50, 50)
    assert len(S.pieces("a b", 50, 50 - 1)) == 1

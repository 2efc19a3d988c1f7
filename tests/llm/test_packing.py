import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheafwork.llm import packing as P


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=120))
def test_no_item_is_lost_or_bin_overfull(sizes):
    bins = P.local_search(P.best_fit(sizes, 100), sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= len(P.best_fit(sizes, 100))


def test_exchanges_empty_a_bin():
    # best fit alone leaves four bins; one exchange makes three
    sizes = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]
    start = [[0, 1], [2, 3, 4], [5, 6, 7, 8, 9]]
    got = P.local_search(start, sizes, 60 + 8)
    assert sorted(i for b in got for i in b) == list(range(10)) and all(sum(sizes[i] for i in b) <= 68 for b in got)


def test_cut_points_keep_code_points():
    t = ("é" * 7 + "中" * 5 + "x").encode()
    for cap in (1, 3, 4, 10, 100):
        ends = P.cut_points(t, cap)
        parts = [t[a:z] for a, z in zip([0, *ends], ends, strict=False)]
        assert b"".join(parts) == t and all(p.decode() for p in parts)
        assert all(len(p) <= max(cap, 3) for p in parts)


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(1, 400)) for i in range(600)] + [(1000, "é" * 700), (1001, None), (1002, ""), (1003, "y" * 500), (5, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash")).withColumn("block", F.lit(1))
    spec = spark.createDataFrame([("a", 500), ("b", 500), ("c", 1000), ("d", None), ("e", 0)], "pack_id string, capacity_tokens long")
    got = P.pack(df, spec, block=100)
    rows_got = got.collect()
    for cap in (500, 1000):
        own = [r for r in rows_got if r["capacity_tokens"] == cap]
        fill = {}
        for r in own:
            fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
        assert max(fill.values()) <= cap and all(fill[r["container"]] == r["fill"] for r in own)
        total = sum(len(t.encode()) for _, t in rows if t is not None)
        assert sum(fill.values()) == total and len(fill) <= -(-total // cap) * 1.03 + 1
        whole = sorted(r["doc_id"] for r in own if r["pieces"] == 1)
        assert whole == sorted(i for i, t in rows if t is not None and len(t.encode()) <= cap)
        parts = sorted((r["piece"], r["byte_start"], r["byte_end"]) for r in own if r["doc_id"] == 1000)
        assert parts[0][1] == 0 and parts[-1][2] == 1400 and all(a[2] == b[1] for a, b in zip(parts, parts[1:], strict=False))
    assert {r["capacity_tokens"] for r in rows_got} == {500, 1000}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    spec = spark.createDataFrame([(500,)], "capacity_tokens long")
    assert P.pack(df, spec).count() == 0
    assert P.pack(spark.createDataFrame([(1, "a")], "doc_id long, text string"), spec.limit(0)).count() == 0


def test_search_goes_on_beyond_64_partners():
    # 100 containers of 60 and 30; only the one with most space far down the list can take the last item
    sizes = [60, 30] * 100 + [15, 7, 8]
    bins = [[2 * k, 2 * k + 1] for k in range(100)] + [[200], [201, 202]]
    got = P.local_search(bins, sizes, 100)
    assert len(got) == 101 and all(sum(sizes[i] for i in b) <= 100 for b in got)
    rng = random.Random(8)
    sizes = [rng.randint(34, 66) for _ in range(400)]
    got = P.local_search(P.best_fit(sizes, 100), sizes, 100)
    fills = [sum(sizes[i] for i in b) for b in got]
    # nothing is left to do: no item fits elsewhere, and no exchange for a smaller one does
    for a, b in enumerate(got):
        for c, d in enumerate(got):
            if a != c and 99.5 > fills[c] >= fills[a] and fills[a] < 99.5 and len(got) > -(-sum(sizes) // 100):
                assert all(sizes[i] > 100 - fills[c] for i in b)
                assert not any(0 < sizes[i] - sizes[j] <= 100 - fills[c] for i in b for j in d)


def test_pieces_of_a_huge_text_need_no_block(spark):
    df = spark.createDataFrame([(1, "x" * 200_000), (2, "y" * 30)], "doc_id long, text string")
    got = P.pack(df, spark.createDataFrame([(100,)], "capacity_tokens long"))
    assert got.where("level = -1").count() == 2000 and got.where("level = -1").select("container").distinct().count() == 2000
    assert got.where("level = 0").count() == 1


def test_one_capacity_more_or_less(spark):
    df = spark.createDataFrame([(i, "x" * (i % 90 + 1)) for i in range(300)], "doc_id long, text string")
    caps = spark.range(100, 1200).toDF("capacity_tokens")
    got = P.items_of(df, caps)
    assert got.count() == 300 * 1100

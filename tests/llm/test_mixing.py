import pytest
from pyspark.sql import functions as F

from sheafwork.llm import mixing as M

DOC, TARGET = "doc_id long, text string, source string", "mix_id string, source string, weight double, max_repeats int"


def test_shares_and_repeats(spark):
    docs = [(i, "x" * (50 + i % 7), " A ") for i in range(600)] + [(1000 + i, "y" * 40, "b") for i in range(300)] + [(2000 + i, "z" * 30, "C") for i in range(10)] + [(3000, None, "n"), (3001, "q", None), (3002, "q" * 500, "unused")]
    targets = [("m", "a", 50.0, 1), ("m", "B", 40.0, 3), ("m", "c", 10.0, 2), ("m", "n", 1.0, 5), ("m", "none", 0.0, 1), ("o", "b", 1.0, 1), ("z", "b", 0.0, None)]
    m = M.Mix(spark.createDataFrame(docs, DOC).withColumn("size", F.lit("x")), spark.createDataFrame(targets, TARGET), block=512)
    r = {(x["mix_id"], x["source"]): x for x in m.report().collect()}
    total = sum(len(t) for _, t, s in docs if t and s and s.strip().lower() in ("a", "b", "c", "n"))
    assert {k for k, x in r.items() if x["short"]} == {("m", "c"), ("m", "n"), ("m", "none")}
    for s, w in (("a", 50), ("B", 40)):
        assert r["m", s]["target"] == pytest.approx(total * w / 101) and abs(r["m", s]["used"] - r["m", s]["target"]) <= 60
    # what cannot reach its share is used up
    assert r["m", "c"]["used"] == 2 * 300 and r["o", "b"]["used"] == 300 * 40 and r["z", "b"]["used"] == 0
    rows = m.rows()
    uses = rows.where("mix_id = 'm'").groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("n")).collect()
    assert {x["source"]: x["n"] for x in uses}["c"] == 2 and all(x["n"] <= 3 for x in uses)
    # every stretch of the mix has the shares, not only its whole
    ends = rows.where("mix_id = 'm' AND source IN ('a', 'B')").withColumn("q", F.ntile(4).over(M.Window.partitionBy("mix_id").orderBy("slot", "at")))
    part = {(x["q"], x["source"]): x["n"] for x in ends.groupBy("q", "source").agg(F.sum("size").alias("n")).collect()}
    for q in (1, 2, 3):
        assert part[q, "a"] / (part[q, "a"] + part[q, "B"]) == pytest.approx(50 / 90, abs=0.06)


def test_running_total_equals_a_window(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") % 11).alias("b"), "id", (F.col("id") * 7 % 13).alias("v"))
    got = M.running_total(df, ["g"], "b", ["id"], F.col("v"), "t")
    w = M.Window.partitionBy("g").orderBy("b", "id").rowsBetween(M.Window.unboundedPreceding, -1)
    assert got.withColumn("u", F.coalesce(F.sum("v").over(w), F.lit(0))).where("t <> u").count() == 0


def test_slots_are_even(spark):
    docs = spark.createDataFrame([(i, "x" * 100, "a" if i % 2 else "b") for i in range(400)], DOC)
    s = M.Mix(docs, spark.createDataFrame([("m", "a", 3.0, 9), ("m", "b", 1.0, 9)], TARGET), block=64).slots()
    rows = s.orderBy("slot").collect()
    n = 0
    for i, r in enumerate(rows, 1):
        n += r["src"] == "a"
        assert abs(n - 0.75 * i) <= 4
    assert sorted(r["rank"] for r in rows if r["src"] == "a") == list(range(n))


def test_empty(spark):
    docs, targets = spark.createDataFrame([], DOC), spark.createDataFrame([], TARGET)
    assert M.Mix(docs, targets).report().count() == 0
    r = M.Mix(docs, spark.createDataFrame([("m", "a", 1.0, 1), ("m", None, 1.0, 1), (None, "a", 1.0, 1)], TARGET)).report().collect()
    assert [(x["source"], x["short"], x["used"]) for x in r] == [("a", True, 0)]
    assert M.Mix(spark.createDataFrame([(1, "x", "a")], DOC), targets).rows().count() == 0

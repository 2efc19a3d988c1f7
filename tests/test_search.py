import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.errors import SheafError
from sheafwork.functions import filters, vectors
from sheafwork.functions.filters import Field
from sheafwork.functions.porter import stem
from sheafwork.operators import fulltext, search
from sheafwork.operators.collection import Collection, Definition
from sheafwork.operators.rag import Retriever


@pytest.fixture
def docs(spark):
    rows = [("a", "roof roof roof roof shingles", 0.50), ("b", "roof tiles and flashing over the porch", 0.90), ("c", "gutter and downspout cleaning", 0.95), ("d", "a slow leak in the upstairs ceiling", 0.60), ("e", "roof", 0.20), ("f", "basement flooding after the storm", 0.99)]
    return spark.createDataFrame([(k, t, [c, math.sqrt(1 - c * c), 0.0, 0.0], c > 0.55) for k, t, c in rows], "key string, body string, embedding array<float>, flag boolean")


def test_vector_lane(docs):
    assert [r["key"] for r in search.knn(docs, [1, 0, 0, 0], 6).collect()] == ["f", "c", "b", "d", "a", "e"]
    assert [r["key"] for r in search.knn(docs, [1, 0, 0, 0], 2, skip=1).collect()] == ["c", "b"]
    assert [r["key"] for r in search.knn(docs, [1, 0, 0, 0], 2, predicate=~Field("flag").true()).collect()] == ["a", "e"]
    assert "embedding" not in search.knn(docs, [1, 0, 0, 0], 1).columns


def test_keyword_lane(docs):
    got = fulltext.bm25(docs, ["roof"], "body").collect()
    assert len(got) == 3 and all(r["rank"] < 0 for r in got)


def test_fusion(docs):
    got = [(r["key"], r["score"]) for r in search.hybrid(docs, [1, 0, 0, 0], ["roof"], "body", 3).collect()]
    rank = {"f": 1, "c": 2, "b": 3, "d": 4, "a": 5, "e": 6}
    words = {r["key"]: i + 1 for i, r in enumerate(fulltext.bm25(docs, ["roof"], "body").orderBy("rank", "key").collect())}
    want = sorted(((-(1 / (60 + rank[k]) + (1 / (60 + words[k]) if k in words else 0)), k) for k in rank))[:3]
    assert [(k, round(-s, 12)) for s, k in want] == [(k, round(s, 12)) for k, s in got]


def test_no_keywords_is_vector_search(docs):
    got = search.hybrid(docs, [1, 0, 0, 0], [" "], "body", 2, skip=1).collect()
    assert [(r["key"], round(r["score"], 12)) for r in got] == [("c", round(1 / 62, 12)), ("b", round(1 / 63, 12))]


def test_limits(docs):
    with pytest.raises(SheafError, match="5210"):
        search.knn(docs, [1, 0, 0, 0], 4097)
    with pytest.raises(ValueError):
        search.knn(docs, [1, 0, 0, 0], 0)
    with pytest.raises(SheafError, match="5213"):
        search.hybrid(docs, [1, 0, 0, 0], ["x"], ["body", "other"])
    with pytest.raises(SheafError, match="5209"):
        search.knn(docs, [1, 0, 0, 0], 1, metric="dot")


def test_odd_vectors(spark):
    df = spark.createDataFrame([("a", None), ("b", [1.0]), ("c", [0.0, 0.0]), ("d", [3.0, 4.0])], "key string, embedding array<float>")
    assert [r["key"] for r in search.knn(df, [1, 0], 9).collect()] == ["d"]
    assert [r["key"] for r in search.knn(df, [1, 0], 9, metric="l2").collect()] == ["c", "d"]
    assert search.knn(df.limit(0), [1, 0], 9).count() == 0


def test_plan_keeps_the_best_of_each_partition(spark, docs, capsys):
    search.knn(docs, [1, 0, 0, 0], 3).explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out


def test_three_valued_logic(spark):
    df = spark.createDataFrame([(1, "x", True), (2, None, False), (3, "y", None)], "id int, tag string, flag boolean")
    ids = lambda p: sorted(r["id"] for r in filters.where(df, p).collect())
    assert ids(~(Field("tag") == "x")) == [2, 3]
    assert ids(Field("tag") != "x") == [2, 3]
    assert ids(Field("tag") == None) == [2]  # noqa: E711
    assert ids(Field("tag") != None) == [1, 3]  # noqa: E711
    assert ids(Field("flag").true()) == [1] and ids(~Field("flag").true()) == [2, 3]
    assert ids(Field("tag").isin()) == [] and ids(~Field("tag").isin()) == [1, 2, 3]
    assert ids((Field("id") > 1) & ((Field("tag") == "y") | (Field("id") <= 1))) == [3]
    assert ids(None) == [1, 2, 3]


def test_text_predicates_fold_ascii_only(spark):
    df = spark.createDataFrame([("ABC",), ("É",), ("100%",), ("a_b",)], "t string")
    get = lambda p: sorted(r["t"] for r in filters.where(df, p).collect())
    assert get(Field("t").starts("ab")) == ["ABC"] and get(Field("t").contains("é")) == [] and get(Field("t").ends("%")) == ["100%"] and get(Field("t").contains("_")) == ["a_b"]


def test_floats_compare_as_stored(spark):
    df = spark.createDataFrame([(0.1,)], "f float")
    assert filters.where(df, Field("f") == 0.1).count() == 1


def test_unknown_constructs_are_refused(spark):
    df = spark.createDataFrame([(1,)], "n int")
    for p in (Field("m") == 1, Field("n").starts("x"), Field("n").true()):
        with pytest.raises(SheafError, match="5211"):
            filters.where(df, p)
    with pytest.raises(SheafError, match="5211"):
        filters.where(df, "n = 1")


def test_filters_reach_the_scan(spark, tmp_path, capsys):
    spark.range(10).withColumn("b", F.lit(1)).write.parquet(f"file://{tmp_path}/x")
    filters.where(spark.read.parquet(f"file://{tmp_path}/x"), Field("id") > 3).select("id").explain("formatted")
    out = capsys.readouterr().out
    assert "GreaterThan(id,3)" in out and "ReadSchema: struct<id:bigint>" in out


def test_codecs(spark):
    df = spark.createDataFrame([([1.5, -2.0, 0.0, 3.0, -1.0, 1.0, 1.0, 1.0],), (None,)], "v array<float>")
    f = df.select(vectors.decode_float32(vectors.encode_float32("v")).alias("f"), vectors.decode_bits(vectors.encode_bits("v")).alias("b"), vectors.decode_int8(vectors.encode_int8("v")).alias("i"), F.hex(vectors.encode_bits("v")).alias("h")).collect()
    assert f[0]["f"] == [1.5, -2.0, 0.0, 3.0, -1.0, 1.0, 1.0, 1.0] and f[0]["b"] == [1, 0, 0, 1, 0, 1, 1, 1] and f[0]["i"] == [2, -2, 0, 3, -1, 1, 1, 1] and f[0]["h"] == "E9"
    assert f[1]["f"] is None and f[1]["b"] is None
    with pytest.raises(Exception, match="multiple of eight"):
        spark.createDataFrame([([1.0],)], "v array<float>").select(vectors.encode_bits("v")).collect()


def test_dimension_check(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<float>")
    assert df.select(vectors.checked(F.col("v"), 2)).count() == 2
    with pytest.raises(Exception, match="5212"):
        df.select(vectors.checked(F.col("v"), 3)).collect()
    with pytest.raises(SheafError, match="5208"):
        vectors.checked(F.col("v"), 9000)


def test_hamming_and_scalars(spark):
    df = spark.createDataFrame([([0b1010, 1], [0b0110, 0])], T.StructType([T.StructField("a", T.ArrayType(T.IntegerType())), T.StructField("b", T.ArrayType(T.IntegerType()))]))
    assert df.select(vectors.hamming_distance(F.col("a"), F.col("b"))).first()[0] == 3
    one = spark.createDataFrame([([3.0, 4.0],)], "v array<float>").select(vectors.normalize(F.col("v")).alias("n"), vectors.to_json(F.col("v")).alias("j"), vectors.length(F.col("v")).alias("l")).first()
    assert one["n"] == pytest.approx([0.6, 0.8]) and one["j"] == "[3.0,4.0]" and one["l"] == 2


def test_tokenizers(spark):
    df = spark.createDataFrame([("Crème brûlée-2 ÉTÉ",), (None,)], "t string")
    tok = lambda k: [r[0] for r in df.select(fulltext.tokens(F.col("t"), k)).collect()]
    assert tok("unicode61") == [["creme", "brulee", "2", "ete"], []]
    none = df.select(fulltext.tokens(F.col("t"), diacritics=0)).first()[0]
    assert none == ["crème", "brûlée", "2", "été"]
    viet = spark.createDataFrame([("ộ ơ cafe\u0301",)], "t string")
    assert [viet.select(fulltext.tokens(F.col("t"), diacritics=k)).first()[0] for k in (0, 1, 2)] == [["ộ", "ơ", "cafe"], ["ộ", "o", "cafe"], ["o", "o", "cafe"]]
    assert tok("ascii")[0] == ["crème", "brûlée", "2", "ÉtÉ"]
    assert tok("trigram")[0][:2] == ["crè", "rèm"] and tok("trigram")[1] == []
    assert [stem(w) for w in ("relational", "hopping", "sky", "été")] == ["relat", "hop", "sky", "été"]


def test_phrases(spark):
    df = spark.createDataFrame([("a", "alpha beta alpha beta"), ("b", "alpha gamma beta"), ("c", None), ("d", "")], "key string, t string")
    assert {r["key"]: list(r["tf"]) for r in fulltext.match(df, ["Alpha-Beta"], "t").collect()} == {"a": [2]}
    assert fulltext.match(df, ["!!"], "t").count() == 0
    assert {r["key"] for r in fulltext.match(df, ["alpha", "gamma"], "t", match_all=True).collect()} == {"b"}
    assert {(r["term"], r["key"], r["tf"]) for r in fulltext.postings(df, "t").collect()} >= {("alpha", "a", 2), ("gamma", "b", 1)}


def test_batch_equals_single(spark, docs, rows):
    q = docs.where("key in ('a', 'f')").select(F.col("key").alias("query"), F.col("embedding").alias("qvec"))
    got = search.knn_batch(docs.repartition(3), q, 3)
    for name in ("a", "f"):
        one = search.knn(docs, docs.where(F.col("key") == name).select("embedding"), 3)
        assert [(r["key"]) for r in got.where(F.col("query") == name).orderBy("rank").collect()] == [r["key"] for r in one.collect()]


def test_text_index(spark, tmp_path):
    df = spark.createDataFrame([("a", "alpha beta alpha beta"), ("b", "alpha gamma beta"), ("c", None), ("d", ""), ("e", "the Alphabet, ALPHA beta gamma")], "key string, t string")
    ix = fulltext.TextIndex(spark, f"file://{tmp_path}/ix")
    ix.update(df, "t")

    def same(df):
        for words, every in ((["alpha"], False), (["alpha beta", "gamma"], False), (["alpha", "gamma"], True), (["!!", "beta"], False), (["beta beta"], False), (["alpha alpha beta"], False)):
            m = lambda x: sorted((r["key"], r["length"], list(r["tf"])) for r in x.collect())
            assert m(ix.match(words, every)) == m(fulltext.match(df, words, "t", match_all=every)), words
            b = lambda x: {r["key"]: pytest.approx(r["rank"]) for r in x.collect()}
            assert b(ix.bm25(words, every)) == b(fulltext.bm25(df, words, "t", match_all=every)), words

    same(df)
    assert {r["key"]: list(r["tf"]) for r in ix.match(["alph*"]).collect()} == {"a": [2], "b": [1], "e": [2]}
    assert {r["key"]: list(r["tf"]) for r in ix.match(["alpha be*"]).collect()} == {"a": [2], "e": [1]}
    ix.update(spark.createDataFrame([("b", "delta"), ("f", "alpha beta")], "key string, t string"), "t")
    ix.delete(spark.createDataFrame([("a",)], "key string"))
    same(spark.createDataFrame([("b", "delta"), ("c", None), ("d", ""), ("e", "the Alphabet, ALPHA beta gamma"), ("f", "alpha beta")], "key string, t string"))
    # a search reads the postings alone, with the terms asked for pushed to the scan
    plan = ix.match(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "alpha" in plan.split("PushedFilters")[1]


def test_batches_of_any_number_of_queries(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 6)).astype(np.float32)
    df = spark.createDataFrame([(f"k{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("none", None), ("zero", [0.0] * 6), ("short", [1.0])], "key string, v array<float>")
    q = spark.range(5000).select(F.col("id").alias("query"), F.array(*[F.sin(F.col("id") * (k + 1)).cast("double") for k in range(6)]).alias("qvec"))
    got = search.knn_batch(df, q, 3, "l2", "key", "v")
    assert got.count() == 15_000 and got.where("query = 4999").count() == 3
    for i in (1, 77, 4999):
        want = search.knn(df, [math.sin(i * (k + 1)) for k in range(6)], 3, metric="l2", key="key", vector="v").collect()
        mine = got.where(F.col("query") == i).orderBy("rank").collect()
        assert [(r["key"], pytest.approx(r["distance"])) for r in mine] == [(r["key"], r["distance"]) for r in want]
    assert search.knn_batch(df, q.limit(0), 3, "cosine", "key", "v").count() == 0 and search.knn_batch(df.limit(0), q, 3, "l1", "key", "v").count() == 0


class Letters:
    """Vectors by the first letters, so that prefixes can be told."""

    def __call__(self, texts):
        return np.array([[float(t[:1] == "q"), float(t[:1] == "d"), float(len(t))] for t in texts])


def test_queries_given_as_text(spark, tmp_path):
    schema = T.StructType.fromDDL("key string, body string, embedding array<float>")
    d = Definition("key", "embedding", 3, schema, metric="l2", full_text=("body",))
    c = Collection(spark, f"file://{tmp_path}/c", d, embedder=Letters(), source="body", document_prefix="d: ", query_prefix="q: ")
    c.create()
    rows = spark.createDataFrame([("a", "one roof"), ("b", "roof tiles"), ("c", "gutter")], "key string, body string")
    c.upsert(rows.withColumn("o", F.lit(1)), ["o"])
    assert {r["key"]: list(r["embedding"]) for r in c.get(["a", "b"], include_vectors=True).collect()} == {"a": [0.0, 1.0, 11.0], "b": [0.0, 1.0, 13.0]}
    assert [r["key"] for r in c.search("one woof", 2).collect()] == ["a", "b"]
    with pytest.raises(SheafError, match="7201"):
        search.knn(rows.withColumn("embedding", F.array(F.lit(1.0))), "text", 2)
    r = Retriever(c)
    got = r.retrieve("one woof", ["roof"], top=3).orderBy("position").collect()
    assert {x["score_kind"] for x in got} == {"Relevance"} and [x["key"] for x in got] == ["a", "b", "c"] and got[0]["score"] > got[2]["score"]
    got = r.retrieve("one woof", [" "], top=2).orderBy("position").collect()
    assert [(x["key"], x["score_kind"], x["position"]) for x in got] == [("a", "Distance", 1), ("b", "Distance", 2)] and got[0]["score"] <= got[1]["score"]
    assert Retriever(c, prefer_hybrid=False).retrieve("one woof", ["roof"], top=1).first()["score_kind"] == "Distance"
    # one threshold, two polarities
    assert r.retrieve("one woof", top=3, threshold=got[0]["score"]).count() == 1 and r.retrieve("one woof", ["roof"], top=3, threshold=0.02).count() == 2
    with pytest.raises(SheafError, match="7202"):
        Retriever(c, most=4).retrieve("x", top=3, skip=2)
    bare = Collection(spark, f"file://{tmp_path}/b", Definition("key", "embedding", 3, schema, metric="l2"), embedder=Letters(), source="body")
    bare.create()
    with pytest.raises(SheafError, match="7203"):
        Retriever(bare, require_hybrid=True).retrieve("x")
    assert Retriever(bare).retrieve("x", ["roof"]).count() == 0
    c.upsert(rows.where("key = 'a'").select("key", F.lit("slate").alias("body"), F.lit(2).alias("o")), ["o"])
    c.delete(rows.where("key = 'b'").select("key"))
    assert c.indexes["body"].match(["roof"]).count() == 0 and [x["key"] for x in c.indexes["body"].match(["slate"]).collect()] == ["a"]

import random

import numpy as np
import pytest

from sheafwork.llm import neardup as N


def sim(a, b, k=3):
    s = [set(zip(*(t.split()[i:] for i in range(k)), strict=False)) for t in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, text string")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    out = []
    for g in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(8, 60))]
        for _ in range(rng.randint(1, 5)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                i = rng.randrange(len(t))
                rng.choice([lambda i=i: t.insert(i, rng.choice(words)), lambda i=i: t.pop(i) if len(t) > 8 else None, lambda i=i: t.__setitem__(i, rng.choice(words))])()
            out.append((f"k{len(out):04d}", " ".join(t)))
    return out


def test_against_brute_force(spark, corpus):
    got = {(r[0], r[1]) for r in N.NearDuplicates(frame(spark, corpus), shingle=3, similarity=0.7, least_words=8).pairs().collect()}
    want = {(a, b) for i, (a, x) in enumerate(corpus) for b, y in corpus[i + 1 :] if sim(x, y) >= 0.7}
    assert want and got <= want and len(want - got) <= 0.01 * len(want)


def test_every_bucket_is_a_star_and_loses_no_pair(spark, corpus):
    want = {(a, b) for i, (a, x) in enumerate(corpus) for b, y in corpus[i + 1 :] if sim(x, y) >= 0.7}
    # the first half of the texts shares one bucket a bin; pairs besides the stars come from the prefix filter
    few = N.NearDuplicates(frame(spark, corpus), shingle=3, similarity=0.7, least_words=8, bins=12, rows=1, hubs=1)
    got = {(r[0], r[1]) for r in few.pairs().collect()}
    assert got <= want and len(want - got) <= 0.02 * len(want)
    rows = spark.createDataFrame([(b, i) for b in range(3) for i in range(b + 2)], "bucket long, id long")
    for hubs, edges, rest in ((1, 1 + 2 + 3, {1, 2, 3}), (2, 1 + 3 + 5, {2, 3}), (3, 1 + 3 + 6, set()), (9, 1 + 3 + 6, set())):
        stars, several = N.star_edges(rows, hubs)
        assert stars.count() == edges and {r[0] for r in several.collect()} == rest, hubs
    classes = few.classes
    full = N.prefix_pairs(N.shingle_sets(classes, 3), 0.7)
    ids = {r["id"]: r["rep"] for r in classes.select("id", "rep").collect()}
    pairs = {tuple(sorted((ids[r["a"]], ids[r["b"]]))) for r in full.collect()}
    reps = set(ids.values())
    assert {p for p in want if dict(corpus)[p[0]] != dict(corpus)[p[1]] and p[0] in reps and p[1] in reps} <= pairs


def test_numbers_of_a_large_group(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", f"k{i * 7919 % 1000:04d}") for i in range(1000)], "g string, k string")
    got = N.numbered(df, "g", "k", "n").collect()
    for g in "ab":
        keys = sorted(r["k"] for r in got if r["g"] == g)
        assert [(r["k"], r["n"]) for r in sorted(got, key=lambda r: r["k"]) if r["g"] == g] == [(k, i) for i, k in enumerate(keys)]


def test_words_and_short_texts(spark):
    t = "One two THREE, four-five six seven eight"
    rows = [("a", t), ("b", "one  two three four five\nsix seven eight"), ("c", "one two three four five six seven"), ("d", None), ("e", ""), (None, t), ("f", "..., !"), ("a", t)]
    got = [tuple(r) for r in N.NearDuplicates(frame(spark, rows), shingle=3, similarity=0.7, least_words=8).pairs().collect()]
    assert got == [("a", "b")]


def test_copies(spark):
    few = [(f"c{i}", "a b c d e f g h") for i in range(4)] + [("near", "a b c d e f g h i")]
    got = {tuple(r) for r in N.NearDuplicates(frame(spark, few), shingle=3, similarity=0.7).pairs().collect()}
    assert len(got) == 6 + 4 and ("c0", "near") in got and ("c3", "near") in got
    for n in (N.SPAN, N.SPAN + 1, N.SPAN + 2):  # one form on either side of the span
        many = [(f"c{i:03d}", "a b c d e f g h") for i in range(n)] + [("near", "a b c d e f g h i")]
        got = {tuple(r) for r in N.NearDuplicates(frame(spark, many), shingle=3, similarity=0.7).pairs().collect()}
        own = {(f"c{i:03d}", f"c{j:03d}") for i in range(n) for j in range(i + 1, min(n, i + 1 + N.SPAN))}
        assert got == own | {(f"c{i:03d}", "near") for i in range(min(n, N.SPAN))}


def test_groups(spark):
    base = "a b c d e f g h i j k l m n o p q r s t".split()
    chain = [(f"k{i}", " ".join([*base, *(f"x{j}" for j in range(2 * i))])) for i in range(5)] + [("z", "nothing of the sort is in this text at all"), ("k0b", " ".join(base))]
    got = {r["key"]: r for r in N.NearDuplicates(frame(spark, chain), shingle=3, similarity=0.8).groups().collect()}
    assert {got[f"k{i}"]["group_id"] for i in range(5)} == {"k0"} and got["z"]["group_id"] == "z" and got["z"]["links"] == 0
    assert got["k0b"]["class_id"] == "k0" and got["k0"]["links"] == got["k0b"]["links"] >= 1


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("p", "q"), ("p", "p")], "a string, b string")
    got = {r["rep"]: r["group_id"] for r in N.components(e).collect()}
    assert set(got.values()) == {"n000", "p"} and len(got) == 63
    assert N.components(e.limit(0)).count() == 0


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "key string, text string, norm string, id long, rep string, digest string")
    n = N.NearDuplicates(df)
    assert n.pairs().count() == 0 and n.groups().count() == 0
    df = spark.createDataFrame([("a", "a b c d e f g h", 1), ("b", "a b c d e f g h", 2)], "key string, text string, id int")
    assert N.NearDuplicates(df).pairs().count() == 1


def test_long_text(spark):
    t = "word " * 5 + " ".join(f"t{i}" for i in range(60_000))
    assert N.NearDuplicates(frame(spark, [("a", t), ("b", t + " end")]), shingle=3, similarity=0.9).pairs().count() == 1


def test_signatures_estimate_similarity():
    kept = {}
    a = [f"w{i}" for i in range(120)]
    b = [*a[:100], *(f"v{i}" for i in range(20))]
    h, o = N.shingle_hashes([" ".join(a), " ".join(b), "x y z", ""], 3, kept)
    s = N.signatures(h, o, 4, 400)
    assert abs((s[0] == s[1]).mean() - sim(" ".join(a), " ".join(b))) < 0.1
    assert (s[2] == s[2][0]).all() and (s[3] == N.EMPTY).all() and not (s[:3] == N.EMPTY).any()
    assert N.bands(s, 5).shape == (4, 80) and len(np.unique(N.bands(s, 5)[2])) == 80

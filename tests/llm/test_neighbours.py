import numpy as np
import pytest

from sheafwork.llm import neighbours as N

PROFILE = "collection string, dimensions int, distance_function string, neighbour_count int, neighbour_max_distance double"


def brute(x, keys, metric, k, within):
    x = x.astype(np.float64)
    if metric == "cos":
        n = np.linalg.norm(x, axis=1)
        d = 1 - x @ x.T / np.outer(n, n)
    elif metric == "l2":
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    else:
        d = np.abs(x[:, None] - x[None]).sum(2)
    np.fill_diagonal(d, np.inf)
    return {(keys[i], keys[j]) for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:k] if d[i, j] <= within}


def clustered(rng, n, dims, noise):
    centres = rng.standard_normal((n // 4, dims))
    return np.concatenate([centres + noise * rng.standard_normal(centres.shape) for _ in range(4)]).astype(np.float32)


@pytest.mark.parametrize(("name", "short", "within"), [("CosineDistance", "cos", 0.2), ("EuclideanDistance", "l2", 3.0), ("ManhattanDistance", "l1", 12.0)])
@pytest.mark.parametrize("bounded", [True, False])
def test_recall(spark, name, short, within, bounded):
    x = clustered(np.random.default_rng(1), 800, 24, 0.2)
    keys = [f"k{i:04d}" for i in range(len(x))]
    df = spark.createDataFrame([("c", k, v.tolist()) for k, v in zip(keys, x, strict=True)], "collection string, key string, embedding array<float>")
    f = N.Forest(df, spark.createDataFrame([("c", 24, name, 3, within)], PROFILE), bounded=bounded)
    got = {(r["key"], r["neighbour"]) for r in f.neighbours().collect()}
    want = brute(x, keys, short, 3, within if bounded else np.inf)
    assert len(want & got) / len(want) >= 0.97
    if bounded:
        assert len(got - want) <= 0.01 * len(want)


def test_unusable_vectors_and_copies(spark):
    rows = [("c", "a", [1.0, 0.0]), ("c", "b", [1.0, 0.0]), ("c", "b", [1.0, 0.0]), ("c", "n", None), ("c", "l", [1.0]), ("c", "z", [0.0, 0.0]), ("c", "i", [float("inf"), 0.0]), ("c", "x", [float("nan"), 1.0]), ("c", "u", [None, 1.0]), ("d", "e", [1.0, 0.0]), (None, "f", [1.0, 0.0]), ("c", None, [1.0, 0.0]), ("o", "p", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "collection string, key string, embedding array<float>")
    p = spark.createDataFrame([("c", 2, "CosineDistance", 5, 0.1), ("d", 2, "EuclideanDistance", 5, 0.1), ("o", 2, "Unknown", 5, 0.1)], PROFILE)
    got = sorted((r["collection"], r["key"], r["neighbour"], r["rank"]) for r in N.Forest(df, p).neighbours().collect())
    assert got == [("c", "a", "b", 1), ("c", "b", "a", 1)]


def test_many_equal_vectors(spark):
    df = spark.createDataFrame([("c", f"k{i:04d}", [1.0, 2.0, 3.0]) for i in range(900)] + [("c", "other", [3.0, -1.0, 0.5])], "collection string, key string, embedding array<float>")
    got = N.Forest(df, spark.createDataFrame([("c", 3, "CosineDistance", 5, 0.01)], PROFILE)).neighbours().groupBy("key").count().collect()
    assert len(got) == 900 and {r["count"] for r in got} == {5}


def test_copies_come_by_key(spark):
    x = {"a": [1.0, 2.0, 3.0], "b": [1.0, 2.0, 3.5]}
    keys = {f"k{i:03d}": "b" if i % 3 == 0 else "a" for i in range(60)} | {"single": "b"}
    df = spark.createDataFrame([("c", key, x[v]) for key, v in keys.items()], "collection string, key string, embedding array<float>")
    got = N.Forest(df, spark.createDataFrame([("c", 3, "EuclideanDistance", 25, 1.0)], PROFILE)).neighbours().orderBy("key", "rank").collect()
    for key, v in keys.items():
        mine = [(r["neighbour"], r["rank"]) for r in got if r["key"] == key]
        want = sorted((k for k in keys if k != key), key=lambda k: (keys[k] != v, k))[:25]
        assert mine == [(k, i + 1) for i, k in enumerate(want)]


@pytest.mark.parametrize(("name", "short", "within", "dims"), [("EuclideanDistance", "l2", 0.35, 48), ("ManhattanDistance", "l1", 2.4, 64)])
def test_long_vectors_lose_no_pair(spark, name, short, within, dims):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((60, dims))
    a *= 100 / np.linalg.norm(a, axis=1, keepdims=True)
    step = rng.standard_normal(a.shape)
    step *= 0.9 * within / (np.linalg.norm(step, axis=1, keepdims=True) if short == "l2" else np.abs(step).sum(1, keepdims=True))
    x = np.concatenate([a, a + step]).astype(np.float32)
    keys = [f"k{i:03d}" for i in range(len(x))]
    df = spark.createDataFrame([("c", k, v.tolist()) for k, v in zip(keys, x, strict=True)], "collection string, key string, embedding array<float>")
    got = {(r["key"], r["neighbour"]) for r in N.Forest(df, spark.createDataFrame([("c", dims, name, 3, within)], PROFILE)).neighbours().collect()}
    assert got == brute(x, keys, short, 3, within) and len(got) == 120


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "collection string, key string, embedding array<float>, id long, h long")
    p = spark.createDataFrame([("c", 3, "CosineDistance", 5, 0.01)], PROFILE)
    assert N.Forest(df, p).neighbours().count() == 0
    assert N.Forest(df, p.limit(0)).neighbours().count() == 0


def test_exact_distances():
    a, b = np.array([[3.0, 4.0]], np.float32), np.array([[0.0, 4.0]], np.float32)
    assert N.exact(a, b, "l2")[0] == 3 and N.exact(a, b, "l1")[0] == 3 and N.exact(a, b, "cos")[0] == pytest.approx(0.2)


def test_strings_of_many_lengths():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63 - 1, 500, dtype=np.int64)
    b = a ^ (np.int64(1) << rng.integers(0, 62, 500))
    bits = lambda v: format(v, "063b")
    want = [next((k for k in range(63) if bits(x)[k] != bits(y)[k]), 63) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert N.common(a, b).tolist() == want and N.common(a, a).tolist() == [63] * 500
    assert N.common(np.array([2**62 - 1]), np.array([0])).tolist() == [1]


def test_ladders_and_ascent_against_brute_force():
    rng = np.random.default_rng(4)
    h = np.sort(rng.integers(0, 2**63 - 1, 300, dtype=np.int64) >> 40 << 40 | rng.integers(0, 2**20, 300))
    lad = N.ladders(h, 10)
    shared = np.stack([N.common(np.full(300, x), h) for x in h])
    for j in range(1, 10):
        want = [np.sort(r)[::-1][(1 << j) - 1] if (1 << j) <= 300 else 0 for r in shared]
        assert lad[:, j].tolist() == want, j
    begin, end = N.stretches(h, lad[:, 4])
    assert (end - begin >= 16).all() and [(r >= lv).sum() for r, lv in zip(shared, lad[:, 4], strict=True)] == (end - begin).tolist()
    two = np.stack([lad, lad[::-1]], axis=1)
    for m in (1, 2, 7, 100, 5000):
        got = N.ascent(two, m)
        for i in (0, 50, 299):
            offered = lambda lv, i=i: sum(1 << ((two[i, t] >= lv).sum() - 1) for t in range(2))
            assert offered(got[i]) >= min(m, offered(0)) and (got[i] == 63 or offered(got[i] + 1) < m)


@pytest.mark.parametrize("kind", ["tight", "unstructured"])
def test_recall_without_a_bound_or_structure(spark, kind):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    x = (10 * rng.standard_normal(64) + 0.05 * x).astype(np.float32) if kind == "tight" else x
    keys = [f"k{i:04d}" for i in range(len(x))]
    df = spark.createDataFrame([("c", k, v.tolist()) for k, v in zip(keys, x, strict=True)], "collection string, key string, embedding array<float>")
    f = N.Forest(df, spark.createDataFrame([("c", 64, "EuclideanDistance", 10, None)], PROFILE), bounded=False)
    got = {(r["key"], r["neighbour"]) for r in f.neighbours().collect()}
    d = ((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * (x.astype(np.float64) @ x.T.astype(np.float64)))
    np.fill_diagonal(d, np.inf)
    want = {(keys[i], keys[j]) for i in range(len(x)) for j in np.argpartition(d[i], 10)[:10]}
    assert len(want & got) / len(want) >= 0.93 and f.measured["c"][1] >= 0.97

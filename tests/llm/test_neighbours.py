import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from nuntia.llm import neighbours as nb


def brute(ids, x, asks, k):
    out = {}
    for i in asks:
        s = np.einsum("j,kj->k", x[i], x)
        s[ids == ids[i]] = -np.inf
        order = np.lexsort((ids, -s))
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order[:k] if s[j] > -np.inf]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row], "clash") for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, score string")


@pytest.mark.parametrize("shard_rows", [8192, 150])
def test_exact_search_with_ties_and_uneven_lengths(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(nb, "SHARD_ROWS", shard_rows)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 8)).astype(np.float32) * rng.uniform(0.1, 5, (700, 1)).astype(np.float32)
    x[200:500] = x[7]  # one very common vector
    ids = rng.permutation(10_000)[:700]
    want = brute(ids, x.astype(float), [i for i in range(700) if ids[i] % 20 == 0], 20)
    assert found(nb.nearest(frame(spark, ids, x), F.col("vec_id") % 20 == 0, 20)) == want


def test_several_groups_of_queries(spark, monkeypatch):
    monkeypatch.setattr(nb, "QUERY_ROWS", 10)
    monkeypatch.setattr(nb, "AT_ONCE", 3)
    rng = np.random.default_rng(4)
    x, ids = rng.integers(-1, 2, (300, 4)).astype(np.float32) + 0.5, np.arange(300)
    assert found(nb.nearest(frame(spark, ids, x), F.col("vec_id") % 5 == 0, 7)) == brute(ids, x.astype(float), range(0, 300, 5), 7)


def test_relaxed_pruning_loses_few_neighbours():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16)) * 3
    x = centres[rng.integers(30, size=4000)] + rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree, asks = nb.VantageTree(np.arange(4000), x), np.arange(0, 4000, 40)
    exact, _ = tree.search(asks, x[asks], 10, 1.0)
    assert all(exact[n].tolist() == [j for j, _ in brute(np.arange(4000), x, [i], 10)[i]] for n, i in enumerate(asks))
    relaxed, _ = tree.search(asks, x[asks], 10, 0.6)
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, relaxed, strict=True)])
    assert 0.9 <= recall <= 1


def asked(spark, monkeypatch, x, shard_rows, k=10):
    """The neighbours found, and how many copies of queries were sent to cells besides their own."""
    monkeypatch.setattr(nb, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(nb, "FEW", 0)
    counts = []
    found_in = nb.found_in

    def counted(data, asks, *rest):
        counts.append((asks.count(), data.select("cell", "shard").distinct().count()))
        return found_in(data, asks, *rest)

    monkeypatch.setattr(nb, "found_in", counted)
    ids = np.arange(len(x))
    out = found(nb.nearest(frame(spark, ids, x), F.col("vec_id") % 20 == 0, k))
    monkeypatch.setattr(nb, "found_in", found_in)
    return out, counts


def test_queries_are_sent_to_few_cells_of_clustered_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 12)) * 4
    x = (centres[rng.integers(40, size=4000)] + rng.normal(size=(4000, 12)) * 0.3).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out, counts = asked(spark, monkeypatch, x, 100)
    assert out == brute(np.arange(4000), x.astype(float), range(0, 4000, 20), 10)
    (home, shards), (others, _) = counts
    assert home == 200 and shards >= 20 and home + others < 0.25 * 200 * shards


def test_cells_of_vectors_without_structure_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 24)).astype(np.float32) * rng.uniform(0.2, 3, (1500, 1)).astype(np.float32)
    x[300:700] = x[5]
    out, counts = asked(spark, monkeypatch, x, 100, 20)
    assert out == brute(np.arange(1500), x.astype(float), range(0, 1500, 20), 20) and len(counts) == 2


def test_ids_with_several_vectors_have_several_rankings(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nb.nearest(df, F.col("vec_id") == 0, 5).collect())
    assert got == [(0, 1, 1, 2.0), (0, 1, 2, 3.0), (0, 2, 1, 1.0), (0, 2, 2, 1.0)]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (7, [2.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [-1.0, 5.0]), (None, [1.0, 1.0]), (20, [0.0, 0.0]), (40, None), (60, [1.0, 1.0, 1.0]), (80, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = found(nb.nearest(df, F.col("vec_id") % 20 == 0, 20))
    assert out == {0: [(7, 2.0), (9, -1.0)], 60: [(8, 6.0)]}
    assert nb.nearest(df.where("false"), F.col("vec_id") % 20 == 0).collect() == []


def peak(f):
    """The result, and the most MB that were allocated at a time meanwhile."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_for_equal_vectors():
    """1,024 queries against 8,192 rows of one vector of 768 components."""
    x = np.tile(np.random.default_rng(1).normal(size=768), (8192, 1))
    tree = nb.VantageTree(np.arange(8192)[::-1], x, k=20)
    asks = np.arange(0, 8192, 8)
    (ids, scores), mb = peak(lambda: tree.search(asks, x[asks], 20, 1.0))
    assert mb < 200 and (scores == scores[0, 0]).all() and len(tree.ids) == 21
    assert all(r.tolist() == [i for i in range(21) if i != asks[n]][:20] for n, r in enumerate(ids))


def test_memory_for_ties_of_different_vectors():
    """Vectors that differ where the queries are zero: all scores are equal, and no row stands for another."""
    rng = np.random.default_rng(2)
    x = np.c_[np.ones((4096, 1)), rng.normal(size=(4096, 255))]
    asks = np.zeros((512, 256))
    asks[:, 0] = 2.0
    tree = nb.VantageTree(rng.permutation(4096), x, k=20)
    (ids, scores), mb = peak(lambda: tree.search(np.arange(512) + 10_000, asks, 20, 1.0))
    assert mb < 200 and (scores == 2.0).all() and (ids == np.arange(20)).all()


def test_rows_that_stand_for_equal_ones():
    x = np.array([[1.0, 0.0], [1.0, -0.0], [2.0, 0.0], [1.0, 0.0], [2.0, 0.0]])
    assert nb.first_of_equals(np.array([9, 3, 5, 4, 1]), x, 2).tolist() == [4, 1, 3, 2]


def test_trees_of_many_lengths_share_one_bound(spark, monkeypatch):
    monkeypatch.setattr(nb, "SHARD_ROWS", 10)
    monkeypatch.setattr(nb, "SAMPLE_VALUES", 4096)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4 + i % 8).tolist()) for i in range(1600)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    trees = nb.top_trees(df)
    held = lambda node: 0 if isinstance(node, int) else len(node[0]) + held(node[3]) + held(node[4])
    assert len(trees) == 8 and all(t.cells > 1 for t in trees.values()) and sum(held(t.root) for t in trees.values()) <= 4096


@pytest.mark.parametrize("few", [0, 8, 1000])
def test_one_round_or_two_agree(spark, monkeypatch, few):
    monkeypatch.setattr(nb, "SHARD_ROWS", 100)
    monkeypatch.setattr(nb, "FEW", few)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 6)).astype(np.float32)
    x[100:400] = x[3]
    assert found(nb.nearest(frame(spark, np.arange(900), x), F.col("vec_id") % 20 == 0, 20)) == brute(np.arange(900), x.astype(float), range(0, 900, 20), 20)


def test_query(spark, sf_dir):
    df = nb.op10_neighbours(spark, sf_dir)
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got, want = found(df), brute(ids, x, [i for i in range(len(ids)) if ids[i] % 20 == 0], 20)
    recall = np.mean([len({v for v, _ in got[q]} & {v for v, _ in w}) / len(w) for q, w in want.items()])
    assert set(got) == set(want) and recall >= 0.9
    at = {int(i): n for n, i in enumerate(ids)}
    assert all(abs(s - x[at[q]] @ x[at[v]]) < 1e-12 for q, r in got.items() for v, s in r)

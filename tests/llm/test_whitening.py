from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from nuntia.llm import whitening as wh

TYPES = [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]


def brute(vectors, k):
    """Whitening from fractions, eigenvectors aside: n, S, covariance, deviations by vector."""
    whole = [tuple(floor(Fraction(256) * Fraction(float(c))) for c in v) for v in vectors]
    fit = sorted(set(whole))
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    mean = [Fraction(v, n) for v in s]
    cov = np.array([[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n) for j in range(d)] for i in range(d)])
    return n, s, cov, whole


def agrees(rows, ids, vectors, k=4):
    n, s, cov, whole = brute(vectors, k)
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(k, len(s))
    by = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(ids) * k and len(by) == len(ids) * k
    for c in range(1, k + 1):
        got = np.array([by[i, c]["whitened"] for i in ids])
        want = np.array([[float(x[j] - Fraction(s[j], n)) for j in range(len(s))] for x in whole]) @ basis[:, c - 1] / np.sqrt(values[c - 1])
        assert np.allclose(got, want * (1 if got @ want > 0 else -1), rtol=1e-6, atol=1e-6)
    for i, x in zip(ids, whole, strict=True):
        r = by[i, 1]
        assert r["n"] == n and r["deviation"] == sum((n * x[j] - s[j]) ** 2 for j in range(len(s)))
        assert abs(r["explained"] / (values[0] / cov.trace()) - 1) < 1e-9 and r["identity_error"] < 1e-6


def test_query(spark, sf_dir):
    df = wh.op13_whitening(spark, sf_dir)
    assert df.dtypes == TYPES
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").limit(10**6).collect()
    x = np.array([r["embedding"] for r in rows], float)
    whole = np.floor(256 * x).astype(np.int64)
    fit = np.unique(whole, axis=0)
    n, s = len(fit), fit.sum(0)
    values, basis = np.linalg.eigh(np.cov(fit.T, bias=True))
    got = {(r["vec_id"], r["component"]): r for r in df.collect()}
    assert len(got) == 4 * len(rows)
    for c in range(1, 5):
        w = np.array([got[r["vec_id"], c]["whitened"] for r in rows])
        want = (whole - s / n) @ basis[:, -c] / np.sqrt(values[-c])
        assert np.allclose(w, want * np.sign(w @ want), atol=1e-6)
        assert all(abs(got[r["vec_id"], c]["explained"] / (values[-c] / values.sum()) - 1) < 1e-9 for r in rows[:5])
    assert [got[r["vec_id"], 1]["deviation"] for r in rows] == ((n * whole - s) ** 2).sum(1).tolist()
    assert {r["n"] for r in got.values()} == {n} and max(r["identity_error"] for r in got.values()) < 1e-9


def test_repeats_count_once_and_large_entries_stay_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    x[20:45] = x[3]
    x[50:, 1] *= 1e4
    df = spark.createDataFrame([(i, v.tolist(), "c") for i, v in enumerate(x)], "vec_id long, embedding array<double>, whitened string")
    agrees(wh.whiten(df).collect(), list(range(60)), x.tolist())


@pytest.mark.parametrize("scale", [1, 1 << 15, 1 << 40, 1 << 62])
def test_scatter_is_exact(scale):
    rng = np.random.default_rng(3)
    x = rng.integers(-scale, scale, (5000, 4), endpoint=True) + scale // 2
    own = wh.Scatter.about(x[:100])
    own.add(x)
    big = x.astype(object)
    want = big.T.dot(big)
    for i, s, products in own.rows():
        assert int(s) == sum(map(int, x[:, i])) and [int(v) for v in products] == want[i].tolist()


def test_scatter_of_tasks_is_merged(spark):
    x = np.random.default_rng(4).integers(-300, 300, (900, 3))
    df = spark.createDataFrame([(3, bytearray(b)) for b in wh.packed(x)], wh.PACKED).repartition(7)
    model = wh.fitted(df, 4)[3]
    assert model.n == 900 and model.sums.tolist() == x.sum(0).tolist() and np.allclose(np.sort(model.values)[::-1], np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, []), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [-inf, 1.0]), (7, [2.0, 1.0]), (9, [-1.0, 5.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (10, [0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("clash"))
    out = wh.whiten(df).collect()
    count = {}
    for r in out:
        count[r["vec_id"]] = count.get(r["vec_id"], 0) + 1
    assert count == {0: 4, 7: 2, 9: 2, None: 2, 8: 3, 10: 1}
    alone = [r for r in out if r["vec_id"] in (8, 10)]
    assert all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] == 0 for r in alone)
    assert {r["n"] for r in out if r["vec_id"] not in (8, 10)} == {4}
    assert wh.whiten(df.where("false")).collect() == [] and wh.whiten(df.where("vec_id IN (1, 2, 4)")).collect() == []


def test_entries_beyond_a_long_and_components_without_spread(spark):
    rows = [(0, [1e300, 1.0]), (1, [-1e300, 1.0]), (2, [0.0, 1.0])]
    out = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by = {(r["vec_id"], r["component"]): r for r in out}
    assert by[0, 1]["deviation"] is None and abs(abs(by[0, 1]["whitened"]) - 1.5**0.5) < 1e-9 and by[0, 1]["whitened"] == -by[1, 1]["whitened"]
    assert by[0, 2]["whitened"] is None and by[0, 2]["explained"] == 0 and by[2, 1]["identity_error"] < 1e-9

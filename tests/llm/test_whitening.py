"""Embedding whitening against plain sums and another eigensolver."""

import math
from fractions import Fraction

import numpy as np
import pytest

from liftline.llm import queries as Q
from liftline.llm import whitening
from liftline.llm.shared import prepare

SCHEMA = "vec_id long, embedding array<float>, component int, n string"


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepare(spark)


def test_eigenvectors():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 40, 90):
        b = rng.normal(size=(n, n))
        diagonal = np.diag(rng.integers(0, 3, n).astype(float))
        graded = b @ np.diag(10.0 ** -np.arange(0, 8, 8 / n)[:n]) @ b.T
        for a in (b @ b.T, np.eye(n) * 3, diagonal, b[:, : n // 3 + 1] @ b[:, : n // 3 + 1].T, graded, np.zeros((n, n))):
            values, vectors = whitening.eigenvectors(a)
            scale = max(np.linalg.norm(a, 2), 1e-300)
            assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * n * scale
            assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-11
            assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * n * scale


def test_polar_is_the_sign_of_the_eigenvalues():
    rng = np.random.default_rng(1)
    base, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    signs = np.where(np.arange(12) < 5, 1.0, -1.0)
    a = base @ np.diag(signs * 10.0 ** rng.uniform(-9, 0, 12)) @ base.T
    assert np.abs(whitening.polar((a + a.T) / 2) - base @ np.diag(signs) @ base.T).max() < 1e-6


def plain(rows, components=32):
    """Exact covariance, and the eigenvectors of another solver."""
    x = np.array([[math.floor(Fraction(float(c)) * 64) + 1_000_000 for c in v] for v in rows], object)
    n, sums = len(x), x.sum(axis=0)
    apart = n * x - sums
    cov = np.array([[float(Fraction(int(c), n**3)) for c in line] for line in apart.T.dot(apart)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = [i for i in range(min(components, len(values))) if values[i] > len(values) * 2e-16 * values[0]]
    white = (apart / n).astype(float) @ vectors[:, keep] / np.sqrt(values[keep])
    return n, (apart * apart).sum(axis=1).tolist(), white, values[keep] / np.trace(cov)


def assert_same(got, rows, components=32):
    n, deviation, white, explained = plain([v for _, v in rows], components)
    k = len(explained)
    by = {}
    for r in got:
        assert r.n == n and r.identity_error <= 1e-4
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(by) == len(rows)
    signs = None
    for i, (vec, _) in enumerate(rows):
        own = by[vec]
        assert sorted(own) == list(range(1, k + 1))
        assert {r.deviation for r in own.values()} == {deviation[i] if deviation[i] < 2**63 else None}
        mine = np.array([own[c].whitened for c in range(1, k + 1)])
        signs = np.sign(mine * white[i]) if signs is None else signs
        assert np.allclose(mine, white[i] * signs, rtol=1e-6, atol=1e-7)
        assert np.allclose([own[c].explained for c in range(1, k + 1)], explained, rtol=1e-9)


@pytest.mark.parametrize(("dims", "scale"), [(3, 1.0), (40, 1.0), (6, 1e6), (4, 1e15)])
def test_whitened_rows(spark, dims, scale):
    rng = np.random.default_rng(dims)
    mixed = rng.normal(size=(dims, dims))
    good = [(i, [float(np.float32(x)) for x in scale * (mixed @ rng.normal(size=dims)) + 3]) for i in range(150)]
    odd = [(500, None), (501, [None] * dims), (502, [float("nan")] * dims), (503, [float("inf")] + [0.0] * (dims - 1)), (504, [])]
    odd += [(505, [1.0] * (dims + 1)), (506, [-3e38] * dims)]
    df = spark.createDataFrame([(*r, 1, "x") for r in good + odd], SCHEMA).repartition(4)
    assert_same(whitening.whitened_rows(df).collect(), good)


def test_repeated_and_null_ids(spark):
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (7, [0.0, -1.0]), (7, [5.0, 0.5]), (8, [0.0, 0.0])]
    got = whitening.whitened_rows(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 1), (0, 2), (0, 2), (7, 1), (7, 1), (7, 2), (7, 2), (8, 1), (8, 2)]


def test_nothing_to_whiten(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        got = whitening.whitened_rows(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))
        assert got.columns == columns and got.collect() == []


def test_query_on_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in Q.table(spark, sf_dir, "embeddings").collect()]
    assert_same(Q.op13_embedding_whitening(spark, sf_dir).collect(), rows)

"""Whitening against numpy's eigenvectors, and exact distances by Python's integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import queries, whitening


def by_hand(rows, k=16):
    """(vec_id, component) -> (n, deviation, |whitened|, explained), from all rows at once."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, x in kept:
        d = [n * c - s for c, s in zip(x, sums)]
        w = np.array([c / n for c in d]) @ u
        for j in range(min(k, (e > 1e-9 * e[0]).sum())):
            out.setdefault((i, j + 1), []).append((n, sum(c * c for c in d), abs(w[j]) / math.sqrt(e[j]), e[j] / e.sum()))
    return out


def same(got, expected):
    assert len(got) == sum(map(len, expected.values()))
    for r in got:
        assert any(r.n == n and r.deviation == d and abs(abs(r.whitened) - w) < 1e-8 * max(1, w) and abs(r.explained - x) < 1e-9 for n, d, w, x in expected[r.vec_id, r.component]), r
    assert max(r.identity_error for r in got) < 1e-9


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 24)))]
    odd = [None, [], [None] + [0.0] * 23, [math.nan] * 24, [math.inf] + [1.0] * 23, [1.0] * 23, [-1.0] * 25]
    return rows + [(900 + i, v) for i, v in enumerate(odd)] + rows[:40] * 3 + [(None, rows[5][1])]


def test_whole_and_repeated_rows(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("x", "e", "n", "component")}).repartition(5)
    same(whitening.whiten(table).collect(), by_hand([r for r in rows if r[1] is None or len(r[1]) in (0, 24)]))


def test_range_finder_converges_or_expands(spark):
    """A spectrum that falls is found by power passes, one that doesn't by all dimensions; both as numpy finds it."""
    rng = np.random.default_rng(8)
    for scale, needs_all in ((4.0 ** -np.arange(60) * 1e4, False), (np.ones(60), True)):
        data = rng.standard_normal((500, 60)) * scale
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
        fit = whitening.written(whitening.integers(table).select("x").distinct(), "fit")
        values, axes, trace, whole = whitening.principal(fit, whitening.centre_of(fit), 4)
        assert whole == needs_all
        x = np.floor(64 * data)
        e, u = np.linalg.eigh(np.cov(x.T, bias=True))
        assert np.allclose(values, e[::-1][:4], rtol=1e-10) and abs(trace - e.sum()) < 1e-9 * trace
        assert np.allclose(np.abs((u[:, ::-1][:, :4] * axes).sum(axis=0)), 1, atol=1e-9)


def test_edges(spark):
    """No rows, one vector, vectors on a line, equal eigenvalues, entries of any size."""
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([])).collect() == []
    assert whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)])).collect() == []
    line = [(i, [float(i), 2.0 * i, -3.0 * i]) for i in range(9)]
    same(whitening.whiten(make(line)).collect(), by_hand(line))
    square = whitening.whiten(make([(i, [float(a), float(b)]) for i, (a, b) in enumerate(((1, 0), (-1, 0), (0, 1), (0, -1)))])).collect()
    assert {r.component for r in square} == {1, 2} and all(abs(r.explained - 0.5) < 1e-12 for r in square)
    large = whitening.whiten(make([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])])).collect()
    assert {(r.vec_id, r.component) for r in large if r.deviation is None} >= {(1, 1), (2, 1)} and all(math.isfinite(r.whitened) for r in large)


def test_registered_query(spark):
    at = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    same(queries.op12_whitening(spark, at).collect(), by_hand(rows))

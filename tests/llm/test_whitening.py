"""Whitening against exact covariances and the eigenvectors of a dense solver."""

import math
from fractions import Fraction

import numpy as np
import pytest

from routeforge.llm import queries, whitening


def whole(vector):
    if vector is None or not len(vector) or any(v is None or not math.isfinite(v) for v in vector):
        return None
    return tuple(math.floor(256 * v) for v in vector)


def brute(rows, top=4):
    """n, {vec_id: deviations} and eigenpairs from exact covariances."""
    kept = [(i, whole(v)) for i, v in rows if whole(v) is not None]
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    centred = [[Fraction(n * x[k] - sums[k], n) for k in range(d)] for x in fit] if d < 8 else None
    if centred:
        cov = np.array([[float(sum(c[a] * c[b] for c in centred) / n) for b in range(d)] for a in range(d)])
    else:
        a = np.array(fit, float) - np.array([s / n for s in sums])
        cov = a.T @ a / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    return kept, n, sums, values, vectors


def check(spark, rows, got, top=4, tolerance=1e-9):
    kept, n, sums, values, vectors = brute(rows)
    rank = int((values > 1e-9 * values[0]).sum())
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    assert sorted(by_id, key=str) == sorted({i for i, _ in kept}, key=str)
    assert len(got) == len(kept) * min(top, rank, len(values))
    signs = {}
    for i, x in kept:
        for r in by_id[i]:
            k = r.component - 1
            assert r.n == n
            expected = sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True))
            assert expected in [o.deviation for o in by_id[i]]
            assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-6)
            assert r.identity_error < 1e-9
            if len(by_id[i]) == min(top, rank, len(values)):  # ids that repeat are checked by their deviations
                centred = np.array([float(Fraction(n * v - s, n)) for v, s in zip(x, sums, strict=True)])
                value = centred @ vectors[:, k] / math.sqrt(values[k])
                if abs(value) > 1e-3:
                    sign = signs.setdefault(k, np.sign(value * r.whitened))
                    assert r.whitened * sign == pytest.approx(value, rel=tolerance * 1e3, abs=tolerance)
    return by_id


def run(spark, rows, schema="vec_id long, embedding array<float>"):
    df = spark.createDataFrame(rows, schema)
    fitted = whitening.fit_whitening(df)
    found = whitening.whiten(df, fitted)
    return fitted, found.collect()


def test_query_equals_dense_solver(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(spark, rows, queries.QUERIES["op11_whitening"](spark, folder).collect())


def test_unusable_rows_copies_and_clashing_columns(spark, tmp_path):
    rng = np.random.RandomState(3)
    points = rng.randn(60, 5) * [40, 9, 4, 1, 0.5] + 3
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(points)]
    rows += [(100 + i, rows[7][1]) for i in range(40)]  # copies count once
    rows += [(7, rows[8][1]), (None, rows[9][1])]
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    rows += [(200 + k, v) for k, v in enumerate(bad)]
    schema = "vec_id long, embedding array<double>, x string, n string, component int, whitened string"
    df = spark.createDataFrame([(*r, "clash", "clash", 9, "clash") for r in rows], schema).repartition(5)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.QUERIES["op11_whitening"](spark, str(tmp_path)).collect()
    usable = [r for r in rows if r[1] is None or len(r[1]) != 2]
    by_id = check(spark, usable, got)
    assert not {200 + k for k in range(len(bad))} & set(by_id)
    assert len(by_id[7]) == 8 and len({r.n for r in got}) == 1


def test_axes_without_variance(spark):
    rng = np.random.RandomState(5)
    a = np.round(rng.randn(50, 2), 2)
    flat = [(i, [float(p[0]), float(p[1]), float(p[0]), 2.5]) for i, p in enumerate(a)]  # two axes of four
    fitted, got = run(spark, flat)
    assert len(fitted.variances) == 2 and all(len(r.whitened) == 2 for r in got)
    assert fitted.explained.sum() == pytest.approx(1.0, rel=1e-12) and fitted.identity_error < 1e-9
    fitted, got = run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert fitted.n == 1 and [r.whitened for r in got] == [[], []] and [r.deviation for r in got] == [0, 0]
    fitted, got = run(spark, [(1, None)])
    assert fitted is None and got == []


def test_ill_conditioned_columns(spark):
    """Columns almost alike: a single Gram matrix would lose the small axis, whose variance is 1e-15 of the largest."""
    rng = np.random.RandomState(8)
    base, small = rng.randint(-(2**31), 2**31, 400), rng.randint(-40, 41, 400)
    rows = [(i, [float(b), float(b + s / 256)]) for i, (b, s) in enumerate(zip(base.tolist(), small.tolist(), strict=True))]
    fitted, _ = run(spark, rows, "vec_id long, embedding array<double>")
    fit = {whole(v) for _, v in rows}
    n = len(fit)
    sums = [sum(x[k] for x in fit) for k in range(2)]
    centred = [[Fraction(n * x[k] - sums[k], n) for k in range(2)] for x in fit]
    a, b, c = (sum(p[i] * p[j] for p in centred) / n for i, j in ((0, 0), (0, 1), (1, 1)))
    least = (a * c - b * b) / (a + c)  # of the two eigenvalues; exact to 1e-15
    assert fitted.variances[1] == pytest.approx(float(least), rel=1e-5)
    assert fitted.identity_error < 1e-4


def test_far_values(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0]), (4, [1.0, 7.0])]
    fitted, got = run(spark, rows, "vec_id long, embedding array<double>")
    by_id = {r.vec_id: r for r in got}
    assert by_id[1].deviation is None and all(math.isfinite(v) for r in got for v in r.whitened)
    assert fitted.n == 4


def test_empty_table(spark):
    fitted, got = run(spark, [])
    assert fitted is None and got == []

"""Operator 11 against whole numbers in plain Python, and its defined results of odd rows."""

import math
from fractions import Fraction

import numpy as np
import pytest

from flowlens.llm import embedding_whitening as ew

SCHEMA = "vec_id long, embedding array<double>, x string, n string, component string, d0 string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", None, "c", "d") for i, v in rows], SCHEMA).repartition(3)


def plain(rows, components=4):
    """Exact sums, covariance by fractions; the covariance's own decomposition is numpy's."""
    kept = [(i, [min(max(math.floor(256 * c), -(1 << 63)), (1 << 63) - 1) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    v = np.array([[float(Fraction(n * sum(x[a] * x[b] for x in fit) - sums[a] * sums[b], n * n)) for b in range(d)] for a in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, x in kept:
        c = np.array([float(Fraction(n * x[k] - sums[k], n)) for k in range(d)])
        for k in range(min(components, d)):
            out.setdefault((i, k + 1), []).append((n, sum((n * x[j] - sums[j]) ** 2 for j in range(d)), c @ u[:, k] / math.sqrt(e[k]), e[k] / np.trace(v)))
    return out


def same(got, want, tolerance=1e-9):
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    assert {k: len(v) for k, v in by.items()} == {k: len(v) for k, v in want.items()}
    sign = {}
    for key, rows in by.items():
        for r, (n, deviation, whitened, explained) in zip(sorted(rows, key=lambda r: r.deviation), sorted(want[key], key=lambda t: t[1]), strict=True):
            assert (r.n, int(r.deviation)) == (n, deviation)
            assert r.explained == pytest.approx(explained, rel=1e-4)
            if abs(whitened) > 1e-3:
                assert sign.setdefault(r.component, math.copysign(1, r.whitened * whitened)) * whitened == pytest.approx(r.whitened, rel=tolerance * 1e3, abs=tolerance)
            assert 0 <= r.identity_error <= 1e-4


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = ew.op11_embedding_whitening(spark, sf)
    assert [t for c, t in got.dtypes[:7]] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    same(got.collect(), plain(rows))


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=3) * (1, 5, 0.2)]) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [math.nan, 0.0, 0.0]), (104, [math.inf, 0.0, 0.0]), (3, rows[3][1]), (None, rows[4][1]), (105, [-0.0, 0.0, -0.001]), (106, [v + 1e-9 for v in rows[6][1]])]
    same(ew.whitening(table(spark, rows + odd)).collect(), plain(rows + odd))
    assert len({r.vec_id for r in ew.whitening(table(spark, rows + odd), components=2).where("component > 2").collect()}) == 0


def test_large_numbers_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(size=2) * (1e14, 3e9)]) for i in range(30)] + [(31, [1e30, 1.0]), (32, [-1e30, 2.0])]
    got = ew.whitening(table(spark, rows[:30])).collect()
    same(got, plain(rows[:30]), 1e-7)
    far = ew.whitening(table(spark, rows))
    want = plain(rows)
    assert {(r.vec_id, r.component): r.deviation for r in far.collect() if r.deviation is not None} == {k: t[0][1] for k, t in want.items() if t[0][1] < 10**38}
    assert far.where("deviation is null").count() == 2 * sum(t[0][1] >= 10**38 for k, t in want.items() if k[1] == 1)
    y = np.array([[(1 << 63) - 1, -5], [-(1 << 63), 7]], object)
    sums, cross = ew._scatter(y)
    assert list(sums) == [-1, 2] and cross[0, 0] == ((1 << 63) - 1) ** 2 + (1 << 126) and cross[0, 1] == -5 * ((1 << 63) - 1) - 7 * (1 << 63)


def test_without_variance(spark):
    assert ew.whitening(table(spark, [])).count() == 0 and ew.whitening(table(spark, [(1, None)])).count() == 0
    got = ew.whitening(table(spark, [(1, [0.5, 2.0]), (2, [0.5, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in got) == [(i, k, 1, 0, 0.0, 0.0, 0.0) for i in (1, 2) for k in (1, 2)]
    line = ew.whitening(table(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])).collect()
    assert all(r.whitened == 0 for r in line if r.component == 2) and all(abs(r.explained - 1) < 1e-12 for r in line if r.component == 1)
    with pytest.raises(ValueError, match="one length"):
        ew.whitening(table(spark, [(1, [0.5, 2.0]), (2, [0.5])]))


def test_shift_changes_nothing(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(50)]
    fits = []
    for k in (101, 1):
        monkeypatch.setattr(ew, "_SHIFT_ROWS", k)
        fits.append(ew.fitted(ew.whole(table(spark, rows)).select("x").distinct()))
    assert fits[0].sums == fits[1].sums and (fits[0].components == fits[1].components).all() and (fits[0].variances == fits[1].variances).all()

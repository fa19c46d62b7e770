import math

import numpy as np
import pytest

from covista.llm import queries
from covista.llm.secular import Spectrum, rank_one
from covista.llm.whitening import whiten

ROW = "vec_id bigint, embedding array<double>"


def brute(rows, components=8):
    """vec_id -> (deviation, whitened per component), eigenvalue shares, gaps: by a dense eigensolver."""
    ok = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in rows
          if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in ok], object)
    n, s = len(x), x.sum(0)
    away = x * n - s
    deviation = [int(v) for v in (away * away).sum(1)]
    y = away.astype(float) / n
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, len(e))
    live = e[:k] > 1e-12 * e.sum()
    w = np.where(live, y @ u[:, :k] / np.sqrt(np.where(live, e[:k], 1)), 0)
    return [i for i, _ in ok], n, deviation, w, np.where(live, e[:k] / max(e.sum(), 1e-300), 0)


def check(rows, got, full=True):
    ids, n, deviation, w, share = brute(rows)
    k = w.shape[1]
    assert len(got) == k * len(ids)
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(by) == len(got)
    signs = [1.0] * k
    for c in range(k):
        at = int(np.abs(w[:, c]).argmax())
        signs[c] = math.copysign(1, by[ids[at], c + 1]["whitened"] * w[at, c])
    for a, i in enumerate(ids):
        for c in range(k):
            r = by[i, c + 1]
            assert (r["n"], r["deviation"]) == (n, deviation[a])
            assert r["explained"] == pytest.approx(share[c], rel=1e-9, abs=1e-12)
            assert r["whitened"] == pytest.approx(signs[c] * w[a, c], abs=1e-6)
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and (not full or errors.pop() <= 1e-4)


def test_query_matches_dense_solver(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.op11_whitening(spark, sf)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"),
                          ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    check(rows, got.collect())


def test_odd_rows_and_many_parts(spark):
    rng = np.random.default_rng(5)
    good = [(i, (rng.normal(size=5) * [5, 3, 2, 1, 0.5]).tolist()) for i in range(200)]
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    rows = good + [(300 + i, good[7][1]) for i in range(100)] + odd        # a third of all rows are copies
    df = spark.createDataFrame([(i, v, "a", 1.5) for i, v in rows], ROW + ", x string, n double").repartition(40, "vec_id")
    check(rows, whiten(df).collect())


def test_without_variance_short_vectors_and_empty(spark):
    flat = [(i, [1.0, float(i), 2.0]) for i in range(6)]
    got = whiten(spark.createDataFrame(flat, ROW)).collect()
    check(flat, got, full=False)
    assert {r["whitened"] for r in got if r["component"] > 1} == {0.0}
    same = whiten(spark.createDataFrame([(1, [0.5]), (1, [0.5]), (None, [0.5])], ROW)).collect()
    assert [(r["vec_id"], r["whitened"], r["explained"], r["deviation"]) for r in sorted(same, key=str)] == \
        [(1, 0.0, 0.0, 0), (1, 0.0, 0.0, 0), (None, 0.0, 0.0, 0)]
    ragged = whiten(spark.createDataFrame([(1, []), (2, [1.0]), (3, [1.0, 4.0]), (4, [1e30, 1.0])], ROW))
    padded = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 4.0])]
    assert {r["n"] for r in ragged.collect()} == {4}
    check(padded, whiten(spark.createDataFrame([(1, []), (2, [1.0]), (3, [1.0, 4.0])], ROW)).collect())
    assert whiten(spark.createDataFrame([], ROW)).collect() == []
    assert whiten(spark.createDataFrame([(1, []), (2, None)], ROW)).collect() == []


@pytest.mark.parametrize("case", ["plain", "equal values", "zero weights", "graded", "one"])
def test_rank_one_update(case):
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = 1 if case == "one" else int(rng.integers(2, 30))
        d, z = np.sort(rng.normal(size=n)), rng.normal(size=n)
        if case == "equal values":
            d = np.sort(np.round(d))
        if case == "zero weights":
            z[rng.random(n) < 0.5] = 0
        if case == "graded":
            d, z = np.sort(10.0 ** -np.arange(n)), 10.0 ** rng.integers(-12, 0, n)
        rho = 10.0 ** rng.integers(-3, 3)
        values, vectors, at = rank_one(d, z, rho)
        q = np.eye(n)
        if vectors is not None:
            q[np.ix_(at, at)] = vectors
        dense = np.diag(d) + rho * np.outer(z, z)
        assert np.abs(q @ np.diag(values) @ q.T - dense).max() <= 1e-12 * max(1, np.abs(dense).max())
        assert np.abs(q.T @ q - np.eye(n)).max() <= 1e-12


def test_spectra_combine_to_that_of_all_vectors():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(150, 12)) * 50, np.ones((40, 12))])
    parts = []
    for rows in np.array_split(x, 7):
        s = Spectrum(12)
        for r in rows:
            s.add(r)
        parts.append(s)
    whole = parts[0]
    for s in parts[1:]:
        whole.merge(s)
    y = x - x.mean(0)
    assert whole.n == len(x) and np.allclose(whole.mean, x.mean(0))
    assert np.abs(whole.vectors @ np.diag(whole.values) @ whole.vectors.T - y.T @ y).max() <= 1e-8

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from covista.operators.graph import core, eigen

SCHEMA = "sub_category string, src long, dst long, weight double"
K = ["sub_category"]


def cliques(extra=()):
    rows = [("A", i, j, 10.0) for b in (0, 10) for i in range(b, b + 5) for j in range(i + 1, b + 5)]
    return rows + [("A", 4, 10, 1.0), *extra]


def blocks(seed, n=48, parts=4):
    """A graph of planted groups, in two categories, with a part of its own and a negative link."""
    rng = random.Random(seed)
    rows = []
    for cat in "AB":
        rows += [(cat, i, j, rng.uniform(1, 5)) for i in range(n) for j in range(i + 1, n)
                 if rng.random() < (0.6 if i % parts == j % parts else 0.05)]
    return rows + [("A", 900, 901, 2.0), ("A", 902, 903, -1.0)]


def groups(m, label="cluster"):
    out = {}
    for r in m.collect():
        out.setdefault((r.sub_category, r[label]), set()).add(r.sku)
    return sorted((c, sorted(g)) for (c, _), g in out.items())


def dense(rows, category, members):
    """Leading eigenpair of B(g) of a group, its split's gain, from the whole matrix."""
    e = {(a, b): w for c, a, b, w in rows if c == category and w > 0}
    ids = sorted({x for ab in e for x in ab})
    at = {v: i for i, v in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for (x, y), w in e.items():
        a[at[x], at[y]] = a[at[y], at[x]] = w
    a /= a.sum()
    k = a.sum(1)
    g = [at[v] for v in members]
    b = (a - np.outer(k, k))[np.ix_(g, g)]
    b -= np.diag(b.sum(1))
    values, vectors = np.linalg.eigh(b)
    s = np.where(vectors[:, -1] > 0, 1, -1)
    return values[-1], vectors[:, -1], s @ b @ s / 2


@pytest.mark.parametrize("task_rows", [eigen.TASK_ROWS, 0])
def test_two_cliques(spark, task_rows):
    e = spark.createDataFrame(cliques([("A", 20, 21, 1.0), ("B", 1, 2, 3.0)]), SCHEMA)
    assert groups(eigen.leading_eigenvector(e, task_rows=task_rows)) == [
        ("A", [0, 1, 2, 3, 4]), ("A", [10, 11, 12, 13, 14]), ("A", [20, 21]), ("B", [1, 2])]


def test_leading_pair_equals_dense_solver(spark):
    rows = [r for r in blocks(3) if r[1] < 900]
    e = spark.createDataFrame(rows, SCHEMA)
    shares = eigen.shares(e, K)
    label = shares.groupBy(*K, "v").agg(F.sum("w").alias("k")).withColumn("c", F.lit(0).cast("bigint"))
    got = eigen.leading_vectors(shares, label, K).collect()
    for cat in "AB":
        mine = sorted((r.v, r.x, r.theta) for r in got if r.sub_category == cat)
        value, vector, _ = dense(rows, cat, [m[0] for m in mine])
        x = np.array([m[1] for m in mine])
        assert mine[0][2] == pytest.approx(value, rel=1e-3)
        assert abs(x @ vector) / np.linalg.norm(x) > 0.99


def test_no_split_by_the_leading_vector_is_left(spark):
    rows = blocks(5)
    e = spark.createDataFrame(rows, SCHEMA)
    found = groups(eigen.leading_eigenvector(e))
    assert sum(len(g) for _, g in found) == 2 * 48 + 4
    assert ("A", [900, 901]) in found and ("A", [902]) in found and ("A", [903]) in found
    for cat, g in found:
        if len(g) > 1:
            value, _, gain = dense(rows, cat, g)
            assert value <= 1e-6 or gain <= 1e-9


def test_product_equals_dense(spark):
    rows = [r for r in blocks(7) if r[1] < 900]
    e = spark.createDataFrame(rows, SCHEMA)
    v = core.vertices(e).withColumn("c", F.col("v") % 3).withColumn("x", (F.col("v") % 7 - 3).cast("double"))
    got = {(r.sub_category, r.v): r.y for r in eigen.modularity_product(e, v.select(*K, "v", "c"), v.select(*K, "v", "x")).collect()}
    for c in range(3):
        g = [i for i in range(48) if i % 3 == c]
        e_ = {(a, b): w for cat, a, b, w in rows if cat == "A"}
        a = np.zeros((48, 48))
        for (i, j), w in e_.items():
            a[i, j] = a[j, i] = w
        a /= a.sum()
        k = a.sum(1)
        b = (a - np.outer(k, k))[np.ix_(g, g)]
        b -= np.diag(b.sum(1))
        assert np.allclose(b @ [i % 7 - 3 for i in g], [got["A", i] for i in g], atol=1e-9)


def test_empty_and_negative_graphs(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert eigen.leading_eigenvector(none).collect() == []
    negative = spark.createDataFrame([("A", 1, 2, -1.0)], SCHEMA)
    assert groups(eigen.leading_eigenvector(negative)) == [("A", [1]), ("A", [2])]

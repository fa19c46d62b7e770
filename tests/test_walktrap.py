import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from covista.operators.graph import core as G
from covista.operators.graph.merges import best_cut_steps
from covista.operators.graph.split import detect
from covista.operators.graph.walktrap import (cut_walks, unmerged, walk_distance, walk_probabilities, walk_vectors,
                                              walktrap, walktrap_merges)
from covista.params import Params

SCHEMA = "sub_category string, src long, dst long, weight double"


def step_matrix(edges):
    names = sorted({v for e in edges for v in e[1:3]})
    at = {v: i for i, v in enumerate(names)}
    a = np.zeros((len(names), len(names)))
    for _, s, d, w in edges:
        a[at[s], at[d]] = a[at[d], at[s]] = w
    a += np.diag(a.sum(1) / (a > 0).sum(1))
    k = a.sum(1)
    return names, a / k[:, None], k


def cliques(cat, n, size, bridge=0.1):
    rows = []
    for c in range(n):
        rows += [(cat, c * size + i, c * size + j, 1.0) for i in range(size) for j in range(i)]
        if c:
            rows.append((cat, c * size, (c - 1) * size, bridge))
    return rows


def random_graph(seed, n=40, links=110):
    rnd = random.Random(seed)
    pairs = {tuple(sorted(rnd.sample(range(n), 2))) for _ in range(links)}
    return [("A", a, b, round(rnd.random() + 0.1, 3)) for a, b in sorted(pairs)]


def test_walk_probabilities_are_the_power_of_the_step_matrix(spark):
    edges = random_graph(1)
    names, p, _ = step_matrix(edges)
    want = np.linalg.matrix_power(p, 3)
    got = np.zeros_like(want)
    for r in walk_probabilities(spark.createDataFrame(edges, SCHEMA), 3).collect():
        got[names.index(r.s), names.index(r.v)] = r.p
    assert np.abs(got - want).max() < 1e-9


def test_projected_distances_are_near_the_exact_ones(spark):
    edges = cliques("A", 4, 8) + [("A", a + 100, b + 100, w) for _, a, b, w in random_graph(2)]
    names, p, k = step_matrix(edges)
    rows = np.linalg.matrix_power(p, 8) * np.sqrt(k.mean() / k)
    vec = walk_vectors(spark.createDataFrame(edges, SCHEMA), dims=64)
    pairs = vec.alias("a").crossJoin(vec.alias("b")).filter("a.v < b.v")
    found = pairs.select(F.col("a.v").alias("i"), F.col("b.v").alias("j"), F.expr(walk_distance(64)).alias("d")).collect()
    ratio = []
    for r in found:
        true = ((rows[names.index(r.i)] - rows[names.index(r.j)]) ** 2).sum()
        if true > 1e-9:
            ratio.append(r.d / true)
    ratio = np.array(ratio)
    assert 0.85 < ratio.mean() < 1.15 and ratio.std() < 0.3 and ratio.max() < 2.1


def test_dendrogram_of_many_graphs(spark):
    graphs = {"A": cliques("A", 5, 6), "B": cliques("B", 2, 4), "C": [("C", 1, 2, 1.0), ("C", 2, 1, 2.0), ("C", 3, 3, 1.0)],
              "R": [("R", *e[1:]) for e in random_graph(3)], "S": [("S", 0, i, 1.0) for i in range(1, 400)],
              "N": [("N", 1, 2, -1.0), ("N", 2, 3, 0.0)], "P": [("P", 4, 4, 1.0)]}
    df = spark.createDataFrame([e for g in graphs.values() for e in g], SCHEMA)
    every, merges = walktrap_merges(df)
    steps = {}
    for s in merges.orderBy("sub_category", "step").collect():
        steps.setdefault(s.sub_category, []).append(s)
    clusters = {}
    for r in cut_walks(every, merges).collect():
        clusters.setdefault(r.sub_category, {}).setdefault(r.cluster, set()).add(r.sku)
    # planted groups, alone vertices, a star in few rounds
    assert clusters["A"] == {c + 1: set(range(c * 6, c * 6 + 6)) for c in range(5)}
    assert clusters["B"] == {c + 1: set(range(c * 4, c * 4 + 4)) for c in range(2)}
    assert clusters["C"] == {1: {1, 2}} and clusters["N"] == {1: {1}, 2: {2}, 3: {3}} and "P" not in clusters
    assert len(steps["S"]) == 399 and unmerged(df, merges).isEmpty()
    # the gains sum to the modularity of every cut
    simple = G.simplify(df)
    k = {}
    for _, a, b, w in graphs["R"]:
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
    alone = -sum((x / sum(k.values())) ** 2 for x in k.values())
    n, one = len(k), lambda t: t.filter("sub_category = 'R'")
    comps = one(G.connected_components(simple)).select("comp").distinct().count()
    assert [s.step for s in steps["R"]] == list(range(1, n - comps + 1))
    for cut, last in ((cut_walks(one(every), one(merges)), one(best_cut_steps(merges)).first().upto),
                      (cut_walks(one(every), one(merges), k=9), n - 9)):
        assert one(G.modularity(simple, cut)).first().modularity == pytest.approx(
            alone + sum(s.gain for s in steps["R"] if s.step <= last), abs=1e-9)
        assert cut.select("cluster").distinct().count() == n - last
    with pytest.raises(ValueError):
        cut_walks(one(every), one(merges), k=comps - 1)


def test_method_code_two_is_walktrap(spark):
    df = spark.createDataFrame(cliques("A", 2, 4), SCHEMA)
    assert detect(df, Params(method=2, k=2).validate()).select("cluster").distinct().count() == 2
    assert walktrap(df.limit(0)).count() == 0

import itertools
import random
from collections import deque

import pytest

from covista.operators import overlap
from covista.operators.graph.betweenness import edge_betweenness

SCHEMA = "sub_category string, src long, dst long, weight double"


def brute(edges):
    """Edge scores by listing all shortest paths of all pairs."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    score = {tuple(sorted(e)): 0.0 for e in edges}

    def paths(s, t):
        best, found, queue = None, [], deque([[s]])
        while queue:
            p = queue.popleft()
            if best is not None and len(p) > best:
                break
            if p[-1] == t:
                best = len(p)
                found.append(p)
                continue
            queue.extend([*p, n] for n in near[p[-1]] if n not in p)
        return found
    for s, t in itertools.combinations(sorted(near), 2):
        all_paths = paths(s, t)
        for p in all_paths:
            for e in zip(p, p[1:]):
                score[tuple(sorted(e))] += 1 / len(all_paths)
    return score


def test_edge_scores_equal_brute_force(spark):
    rng = random.Random(2)
    graphs = {"A": [(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (4, 5), (5, 6), (6, 4), (20, 21)],
              "B": sorted({tuple(sorted(rng.sample(range(9), 2))) for _ in range(14)})}
    rows = [(c, a, b, 1.0) for c, es in graphs.items() for a, b in es] + [("A", 1, 0, 2.0), ("A", 3, 3, 1.0)]
    got = {(r.sub_category, r.src, r.dst): r.score for r in edge_betweenness(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {(c, *e): s for c, es in graphs.items() for e, s in brute(es).items()}
    assert got == pytest.approx(want)


def test_stated_sources_and_empty_graph(spark):
    e = spark.createDataFrame([("A", 1, 2, 1.0), ("A", 2, 3, 1.0)], SCHEMA)
    source = spark.createDataFrame([("A", 1)], "sub_category string, v long")
    assert {(r.src, r.dst): r.score for r in edge_betweenness(e, sources=source).collect()} == {(1, 2): 2.0, (2, 3): 1.0}
    assert edge_betweenness(e.limit(0)).collect() == []


def test_bitmap_overlaps(spark):
    rng = random.Random(4)
    sets = {s: {rng.choice([v, -v - 1, v << 33]) for v in (rng.randrange(200) for _ in range(60))} for s in range(8)}
    sv = spark.createDataFrame([("A", s, v) for s, vs in sets.items() for v in vs], "sub_category string, sku long, visitor long")
    pairs = spark.createDataFrame([("A", a, b) for a, b in itertools.combinations(range(9), 2)], "sub_category string, sku1 long, sku2 long")
    got = {(r.sku1, r.sku2): r.com for r in overlap.pair_overlap(overlap.visitor_words(sv), pairs).collect()}
    sets[8] = set()
    assert got == {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(range(9), 2)}


def test_sketches_of_days_add_up_to_a_window(spark):
    q = spark.range(40_000).selectExpr("'A' sub_category", "id % 3 sku", "id div 2 visitor", "date_add(date'2020-01-01', cast(id % 10 as int)) visit_date")
    sketches = overlap.daily_visitor_sketches(q)
    exact = {r.sku: r.n for r in q.filter("visit_date between '2020-01-03' and '2020-01-06'").groupBy("sku").agg({"visitor": "count"})
             .withColumnRenamed("count(visitor)", "n").collect()}
    distinct = {r.sku: r[1] for r in q.filter("visit_date between '2020-01-03' and '2020-01-06'").select("sku", "visitor").distinct()
                .groupBy("sku").count().collect()}
    for r in overlap.sku_views_estimate(sketches, "2020-01-03", "2020-01-06").collect():
        assert abs(r.pv - distinct[r.sku]) <= 4 * overlap.ERROR * distinct[r.sku] and exact[r.sku] >= distinct[r.sku]


def test_pairs_of_short_sets_are_one_row_and_large_sets_stay_words(spark, monkeypatch):
    """A pair is joined once for each SKU, not once for each word of a SKU; sets over the bound are looked up by word."""
    rng = random.Random(5)
    size = {s: 4 if s < 4 else 90 for s in range(8)}
    sets = {s: {64 * w + rng.randrange(3) for w in rng.sample(range(100), n)} for s, n in size.items()}
    sv = spark.createDataFrame([("A", s, v) for s, vs in sets.items() for v in vs], "sub_category string, sku long, visitor long")
    pairs = spark.createDataFrame([("A", a, b) for a, b in itertools.combinations(range(8), 2)] + [("A", 0, 99), (None, 0, 1)],
                                  "sub_category string, sku1 long, sku2 long")
    want = {("A", a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(range(8), 2)} | {("A", 0, 99): 0, (None, 0, 1): 0}
    words = overlap.visitor_words(sv)
    for limit in (0, 10, 128):
        assert {(r.sub_category, r.sku1, r.sku2): r.com for r in overlap.pair_overlap(words, pairs, limit).collect()} == want
    lists = {r.sku: (r.n, r.l) for r in overlap.word_lists(words, 10).collect()}
    assert {s for s, (n, l) in lists.items() if l is None} == {4, 5, 6, 7}
    assert all(set(l) == sets[s] for s, (n, l) in lists.items() if l is not None)

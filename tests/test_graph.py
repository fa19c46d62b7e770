from pyspark.sql import functions as F

from covista.operators.graph import core, label_prop, merges, moving
from covista.operators.graph.split import split_large
from covista.params import Params

SCHEMA = "sub_category string, src long, dst long, weight double"


def two_cliques(spark, extra=()):
    rows = []
    for base in (0, 10):
        for i in range(base, base + 5):
            for j in range(i + 1, base + 5):
                rows.append(("A", i, j, 10.0))
    rows.append(("A", 4, 10, 1.0))
    rows += list(extra)
    return spark.createDataFrame(rows, SCHEMA)


def groups(m):
    out = {}
    for r in m.collect():
        out.setdefault(r.cluster, set()).add(r.sku)
    return sorted(map(sorted, out.values()))


CLIQUES = [[0, 1, 2, 3, 4], [10, 11, 12, 13, 14]]


def test_simplify_loops_and_parallel_edges(spark):
    e = spark.createDataFrame([("A", 1, 2, 1.0), ("A", 2, 1, 3.0), ("A", 1, 1, 9.0)], SCHEMA)
    assert [(r.src, r.dst, r.weight) for r in core.simplify(e).collect()] == [(1, 2, 3.0)]


def test_every_method_separates_two_cliques(spark):
    e = two_cliques(spark)
    assert groups(moving.louvain(e)) == CLIQUES
    assert groups(moving.potts_communities(e, 1.0)) == CLIQUES
    assert groups(label_prop.label_propagation(e)) == CLIQUES
    assert groups(merges.fast_greedy(e)) == CLIQUES


def test_fast_greedy_k_and_modularity(spark):
    e = two_cliques(spark)
    assert groups(merges.fast_greedy(e, k=1)) == [sorted(CLIQUES[0] + CLIQUES[1])]
    m = moving.louvain(e)
    q = core.modularity(core.simplify(e), m).collect()[0].modularity
    # two cliques of 10 edges (weight 10) and one bridge (weight 1): 2m = 402
    expect = (400 / 201) / 2 - 2 * (201 / 402) ** 2
    assert abs(q - expect) < 1e-12


def test_signed_method_keeps_negative_pairs_apart(spark):
    e = two_cliques(spark).withColumn("weight", F.col("weight") - 5.0)
    assert groups(moving.signed_potts_communities(e, 1.0, 1.0)) == CLIQUES


def test_components_and_split_refines(spark):
    e = two_cliques(spark, [("A", 20, 21, 1.0)])
    comp = {r.sku: r.comp for r in core.connected_components(e).collect()}
    assert comp[14] == 0 and comp[21] == 20
    p = Params(cl_size_thresh=6, sub_method=8, iter_count=3, sg_gamma=1.0)
    top = core.as_membership(spark.createDataFrame(
        [("A", s, 0 if s < 20 else 20) for s in [0, 1, 2, 3, 4, 10, 11, 12, 13, 14, 20, 21]],
        "sub_category string, sku long, label long"))
    out = split_large(e, top, p).collect()
    parts = {}
    for r in out:
        parts.setdefault(r.cluster_id, set()).add(r.sku)
    assert sorted(map(sorted, parts.values())) == [CLIQUES[0], CLIQUES[1], [20, 21]]
    assert {r.cluster_id for r in out if r.sku >= 20} == {"2-0"}


def cluster_sets(labels, label="label"):
    out = {}
    for r in labels.collect():
        out.setdefault(r[label], set()).add(r.sku)
    return sorted(map(sorted, out.values()))


def test_tiny_weights_keep_every_vertex(spark):
    e = spark.createDataFrame([("A", 1, 2, 1.6e-7), ("A", 2, 3, 1.6e-7), ("A", 1, 3, 1.6e-7), ("A", 4, 5, 0.5)], SCHEMA)
    for m in (merges.fast_greedy(e), moving.louvain(e), label_prop.label_propagation(e), moving.potts_communities(e, 0.5)):
        assert groups(m) == [[1, 2, 3], [4, 5]]


def test_no_move_is_left(spark):
    import random
    rng = random.Random(3)
    rows = [("A" if i % 2 else "B", rng.randrange(30), rng.randrange(30), rng.random() - 0.2) for i in range(220)]
    e = spark.createDataFrame(rows, SCHEMA)
    positive = e.filter("weight > 0")
    for gamma in (0.5, 1.0, 2.0):
        m = moving.potts_communities(positive, gamma)
        assert moving.moves_left(positive, m, gamma=gamma).count() == 0
    signed = moving.signed_potts_communities(e, 1.0, 1.0)
    assert moving.moves_left(e, signed, gamma=1.0, lam=1.0, signed=True).count() == 0
    labels = label_prop.label_propagation_labels(positive)
    rows = core.directed(core.with_int_weight(core.simplify(positive), ["sub_category"]), ["sub_category"], ["w"])
    assert label_prop.wanted_labels(rows, labels, ["sub_category"]).count() == 0
    merged, table = merges.fast_greedy_merges(positive)
    assert moving.moves_left(positive, core.as_membership(merged)).count() == 0
    # the merge table's gains are exact: they add up to the modularity reached from single vertices
    gained = {r.sub_category: r.g for r in table.groupBy("sub_category").agg(F.sum("gain").alias("g")).collect()}
    simple = core.simplify(positive)
    alone = core.vertices(simple).selectExpr("sub_category", "v as sku", "v as cluster")
    start = {r.sub_category: r.modularity for r in core.modularity(simple, alone).collect()}
    end = {r.sub_category: r.modularity for r in core.modularity(simple, core.as_membership(merged)).collect()}
    assert all(abs(end[c] - start[c] - gained[c]) < 1e-9 for c in end)
    assert sorted(r.step for r in table.filter("sub_category = 'A'").collect()) == list(range(1, table.filter("sub_category = 'A'").count() + 1))
    cut = merges.cut_merges(table, merged.select("sub_category", "sku"), merges.best_cut_steps(table))
    assert groups(cut.filter("sub_category = 'A'")) == groups(core.as_membership(merged).filter("sub_category = 'A'"))


def test_hub_joins_in_few_rounds_and_k(spark, monkeypatch):
    import pytest
    e = spark.createDataFrame([("A", 0, i, 1.0) for i in range(1, 300)], SCHEMA)
    rounds = []
    real = merges._joins
    monkeypatch.setattr(merges, "_joins", lambda *a: rounds.append(1) or real(*a))
    labels, table = merges.fast_greedy_merges(e)
    assert len(rounds) <= 5 and core.as_membership(labels).select("cluster").distinct().count() == 300 - table.count()
    two = spark.createDataFrame([("A", 1, 2, 1.0), ("A", 3, 4, 1.0)], SCHEMA)
    assert groups(merges.fast_greedy(two, k=2)) == [[1, 2], [3, 4]]
    with pytest.raises(ValueError):
        merges.fast_greedy(two, k=1)


def test_cluster_numbers_follow_the_smallest_sku(spark):
    lab = spark.createDataFrame([(c, s, s % 17) for c in "AB" for s in range(200)], "sub_category string, sku long, label long")
    got = {(r.sub_category, r.sku): r.cluster for r in core.as_membership(lab.repartition(5)).collect()}
    assert got == {(c, s): s % 17 + 1 for c in "AB" for s in range(200)}


def test_hubs_are_ordered_over_range_partitions(spark, monkeypatch):
    """A star larger than a window may hold is one community, and a round is the same both ways."""
    import random
    star = spark.range(1, 60_001).selectExpr("'A' sub_category", "0L src", "id dst", "1.0D weight")
    assert moving.WINDOW_ROWS < 60_000
    m = moving.louvain(star)
    assert m.agg(F.count("sku"), F.countDistinct("cluster")).first()[:] == (60_001, 1)
    rng = random.Random(8)
    e = spark.createDataFrame([("A", rng.randrange(40), rng.randrange(40), rng.random() - 0.2) for _ in range(260)], SCHEMA)
    K = ["sub_category"]
    rows, state, totals = moving.level0(e, K, True)
    moves = moving.best_moves(rows, state, totals, K, 1.0, 1.0)
    one, two = (sorted(moving.accepted_moves(rows, moves, totals, K, 1.0, 1.0, hub).collect()) for hub in (False, True))
    assert one == two and one
    links = core.with_int_weight(core.simplify(e.filter("weight > 0")), K)
    links = core.directed(links, K, ["w"])
    joins = sorted(merges.first_joins(links, K)[0].collect())
    monkeypatch.setattr(merges, "WINDOW_ROWS", 0)
    assert sorted(merges.first_joins(links, K)[0].collect()) == joins and joins

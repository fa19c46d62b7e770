"""Walktrap communities (G3, method 2): distances of short random walks, merged by Ward's rule.

A walk from v steps to u with probability w_vu / k_v, where every vertex has a loop of the mean weight of
its links, so that walks do not alternate (Pons & Latapy 2006).  With P the matrix of these steps, two
vertices are apart by r² = Σ_u (P^t_iu − P^t_ju)² / k_u, communities by the r² of their members' mean rows,
and the merge of adjacent communities that raises the sum of squares least comes first:

    Δσ = |A| |B| / (|A| + |B|) · r²(A, B)

The rows of P^t are as long as the graph has vertices, so they are never built for clustering.  Each vertex
keeps ``dims`` numbers instead: its row of P^t K^-1/2 R for random signs R (Johnson & Lindenstrauss), got by
stepping K^-1/2 R ``steps`` times along the edges.  A squared distance is then right within a relative
standard error of sqrt(2 / dims), whatever the size of the graph.  Numbers are integers (multiples of 2^-30),
so results do not depend on the order of additions; ``walk_probabilities`` gives the exact rows.

Merging runs in rounds.  Each community picks the neighbour with the smallest Δσ (ties by smallest pair); of
two that pick each other, the one picked more often is a centre.  Those that picked it join it in the same
round if their Δσ is at most twice that of the centre's own best, so every merge of a round is within a
factor of two of the best one for its community, and a hub takes alike leaves at once.  The order can
differ from the strictly sequential one.  The merge table holds every step until no two communities are
adjacent, with its exact modularity gain; the dendrogram is cut at the best modularity or at ``k``.

Vertices that have no positive edge stay alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.ranking import running_before
from ...runtime import KEY, cut_lineage, drop_table
from .core import as_membership, directed, simplify, vertices, with_int_weight
from .merges import best_cut_steps, cut_merges

STEPS = 8            # fixed value: the length of the job's walks
DIMS = 64
UNIT = float(1 << 30)
WINDOW_ROWS = 50_000 # members of one centre that one task orders; beyond that range partitions do
NEAR = 2.0           # a centre takes members up to this multiple of its own best merge in one round
SAFETY = 100_000     # rounds; reaching it raises


def _links(edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both directions of the positive edges, ``keys + [v, u, w]``, and ``keys + [v, kv, deg]``."""
    e = with_int_weight(simplify(edges, keys), keys)
    rows = cut_lineage(directed(e.filter(F.col("w") > 0), keys, ["w"]), "links")
    return rows, cut_lineage(rows.groupBy(*keys, "v").agg(F.sum("w").alias("kv"), F.count(F.lit(1)).alias("deg")), "nodes")


def _with_loop() -> F.Column:
    """A vertex's strength with its loop."""
    return F.col("kv").cast("double") * (F.col("deg") + 1) / F.col("deg")


def strengths(edges: DataFrame, keys: list[str] = [KEY]) -> DataFrame:
    """``keys + [v, k]``: every vertex's strength with its loop, in integer weight units."""
    return _links(edges, keys)[1].select(*keys, "v", _with_loop().alias("k"))


def _shares(rows: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The step matrix P: ``keys + [v, u, share]``, loops included."""
    out = rows.join(nodes, [*keys, "v"]).select(*keys, "v", "u", (F.col("w").cast("double") / _with_loop()).alias("share"))
    return out.unionByName(nodes.select(*keys, "v", F.col("v").alias("u"), (F.lit(1.0) / (F.col("deg") + 1)).alias("share")))


def walk_probabilities(edges: DataFrame, steps: int, keys: list[str] = [KEY]) -> DataFrame:
    """``keys + [s, v, p]``: the probability that a walk of ``steps`` steps from ``s`` ends at ``v``, where it
    is not 0.  One row per pair that walks join: for short walks or small graphs."""
    rows, nodes = _links(edges, keys)
    share = cut_lineage(_shares(rows, nodes, keys), "shares")
    p = nodes.select(*keys, F.col("v").alias("s"), "v", F.lit(1.0).alias("p"))
    for _ in range(steps):
        p = cut_lineage(p.join(share, [*keys, "v"]).groupBy(*keys, "s", F.col("u").alias("v"))
                         .agg(F.sum(F.col("p") * F.col("share")).alias("p")), "walks")
    return p


def _columns(dims: int) -> list[str]:
    return [f"x{i}" for i in range(dims)]


def _project(rows: DataFrame, nodes: DataFrame, keys: list[str], steps: int, dims: int) -> DataFrame:
    xs = _columns(dims)
    share = cut_lineage(_shares(rows, nodes, keys), "shares")
    mean = nodes.groupBy(*keys).agg(F.avg(_with_loop()).alias("mean"))
    signs = [F.xxhash64("v", F.lit(b)).alias(f"h{b}") for b in range((dims + 63) // 64)]
    size = F.round(F.sqrt(F.col("mean") / _with_loop()) * F.lit(UNIT)).cast("bigint")
    start = nodes.join(mean, keys).select(*keys, "v", size.alias("size"), *signs)
    state = start.select(*keys, "v", *[F.expr(f"(shiftright(h{i // 64}, {i % 64}) & 1) * 2 * size - size AS {x}") for i, x in enumerate(xs)])
    for _ in range(steps):
        new = cut_lineage(share.join(state.withColumnRenamed("v", "u"), [*keys, "u"]).groupBy(*keys, "v").agg(
            *[F.expr(f"sum(cast(round(share * {x}) AS bigint)) AS {x}") for x in xs]), "walks")
        drop_table(state)
        state = new
    drop_table(share)
    return state


def walk_vectors(edges: DataFrame, steps: int = STEPS, dims: int = DIMS, keys: list[str] = [KEY]) -> DataFrame:
    """``keys + [v, x0, x1, …]``: projected rows of the walks.  The mean over the columns of the squared
    differences of two rows, by 2^60, is r² times the graph's mean strength (``walk_distance``)."""
    rows, nodes = _links(edges, keys)
    return _project(rows, nodes, keys, steps, dims)


def walk_distance(dims: int, a: str = "a", b: str = "b", na: str = "1.0D", nb: str = "1.0D") -> str:
    """SQL of r² times the mean strength, between the rows (sums of ``na`` and ``nb`` rows) of tables ``a`` and ``b``."""
    apart = [f"({a}.{x} / {na} - {b}.{x} / {nb}) / {UNIT}D" for x in _columns(dims)]
    return "(" + " + ".join(f"({d}) * ({d})" for d in apart) + f") / {dims}"


def _best(rows: DataFrame, state: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """Every community's neighbour with the smallest Δσ: ``keys + [v, u, delta]``."""
    on = lambda t, end: [F.col(f"r.{k}") == F.col(f"{t}.{k}") for k in keys] + [F.col(f"r.{end}") == F.col(f"{t}.v")]
    # a pair is computed once, the smaller end first, so that both ends see the same number
    pair = rows.filter("v < u").alias("r").join(state.alias("a"), on("a", "v")).join(state.alias("b"), on("b", "u"))
    delta = f"cast(a.n AS double) * b.n / (a.n + b.n) * ({walk_distance(dims, 'a', 'b', 'a.n', 'b.n')})"
    pair = pair.select(*[F.col(f"r.{k}").alias(k) for k in keys], F.expr("r.v AS x"), F.expr("r.u AS y"), F.expr(delta).alias("delta"))
    both = pair.select(*keys, "delta", "x", "y", F.expr("explode(array(struct(x AS v, y AS u), struct(y AS v, x AS u))) AS e"))
    least = both.groupBy(*keys, F.col("e.v").alias("v")).agg(F.min(F.struct("delta", "x", "y", F.col("e.u").alias("u"))).alias("b"))
    return least.select(*keys, "v", F.col("b.u").alias("u"), F.col("b.delta").alias("delta"))


def _joins(best: DataFrame, keys: list[str]) -> DataFrame:
    """``keys + [v, a, delta]``: the communities ``v`` that join the centre ``a`` in this round."""
    liked = best.groupBy(*keys, F.col("u").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    mutual = best.join(best.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")), [*keys, "u", "v"])
    mutual = mutual.join(liked, [*keys, "v"]).join(liked.select(*keys, F.col("v").alias("u"), F.col("n").alias("nu")), [*keys, "u"])
    centre = mutual.filter((F.col("n") > F.col("nu")) | (F.col("n") == F.col("nu")) & (F.col("v") < F.col("u")))
    centre = centre.select(*keys, F.col("v").alias("a"), F.col("delta").alias("own"))
    return (best.withColumnRenamed("u", "a").join(centre, [*keys, "a"])
                .filter(F.col("delta") <= F.lit(NEAR) * F.col("own")).select(*keys, "v", "a", "delta"))


def _gains(rows: DataFrame, state: DataFrame, joins: DataFrame, total: DataFrame, keys: list[str], hub: bool) -> DataFrame:
    """The merges ``keys + [a, b, delta, gain]`` of a round; the members of a centre join by (delta, v)."""
    strength = state.select(*keys, "v", "kv")
    held = joins.join(strength, [*keys, "v"])
    if hub:
        held = running_before(held.withColumn("o", F.struct("delta", "v")), [*keys, "a"], F.col("o"), F.col("kv"), "taken").drop("o")
    else:
        before = Window.partitionBy(*keys, "a").orderBy("delta", "v").rowsBetween(Window.unboundedPreceding, -1)
        held = held.withColumn("taken", F.coalesce(F.sum("kv").over(before), F.lit(0)))
    held = held.join(strength.withColumnRenamed("v", "a").withColumnRenamed("kv", "ka"), [*keys, "a"])
    mine = joins.select(*keys, "v", "a", F.struct("delta", "v").alias("o"))
    theirs = joins.select(*keys, F.col("v").alias("u"), F.col("a").alias("a2"), F.struct("delta", "v").alias("o2"))
    inside = (rows.join(mine, [*keys, "v"]).join(theirs, [*keys, "u"], "left")
                  .filter((F.col("u") == F.col("a")) | F.coalesce((F.col("a2") == F.col("a")) & (F.col("o2") < F.col("o")), F.lit(False)))
                  .groupBy(*keys, "v").agg(F.sum("w").cast("double").alias("inside")))
    gain = 2 * (F.col("inside") / F.col("m2") - F.col("kv") / F.col("m2") * ((F.col("ka") + F.col("taken")) / F.col("m2")))
    return held.join(inside, [*keys, "v"]).join(total, keys).select(*keys, "a", F.col("v").alias("b"), "delta", gain.alias("gain"))


def walktrap_merges(edges: DataFrame, keys: list[str] = [KEY], steps: int = STEPS, dims: int = DIMS) -> tuple[DataFrame, DataFrame]:
    """``(vertices, merges)``: ``keys + [sku]`` and ``keys + [step, a, b, delta, gain]``, the whole dendrogram."""
    every = cut_lineage(vertices(simplify(edges, keys), keys).withColumnRenamed("v", "sku"), "vertices")
    xs = _columns(dims)
    rows, nodes = _links(edges, keys)
    total = cut_lineage(nodes.groupBy(*keys).agg(F.sum("kv").cast("double").alias("m2")), "total")
    state = cut_lineage(_project(rows, nodes, keys, steps, dims).join(nodes.select(*keys, "v", "kv"), [*keys, "v"])
                        .withColumn("n", F.lit(1).cast("bigint")), "state")
    rounds: list[DataFrame] = []
    for number in range(SAFETY):
        best = cut_lineage(_best(rows, state, keys, dims), "best")
        joins = cut_lineage(_joins(best, keys), "joins")
        most = joins.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if most is None:
            break
        rounds.append(cut_lineage(_gains(rows, state, joins, total, keys, most > WINDOW_ROWS).withColumn("number", F.lit(number)), "merges"))
        to = joins.select(*keys, "v", F.col("a").alias("t"))

        def moved(df, end):
            there = to.select(*keys, F.col("v").alias(end), "t")
            return df.join(there, [*keys, end], "left").withColumn(end, F.coalesce("t", end)).drop("t")
        old = (rows, state, best, joins)
        state = cut_lineage(moved(state, "v").groupBy(*keys, "v").agg(*[F.expr(f"sum({c}) AS {c}") for c in (*xs, "kv", "n")]), "state")
        rows = cut_lineage(moved(moved(rows, "v"), "u").filter(F.col("v") != F.col("u"))
                           .groupBy(*keys, "v", "u").agg(F.sum("w").alias("w")), "links")
        for table in old:
            drop_table(table)
    else:
        raise RuntimeError("merging did not end")
    merges = total.limit(0).select(*keys, *[F.lit(0).cast(t).alias(c) for c, t in (
        ("a", "bigint"), ("b", "bigint"), ("delta", "double"), ("gain", "double"), ("number", "int"))])
    for table in rounds:
        merges = merges.unionByName(table)
    merges = merges.withColumn("o", F.struct("number", "delta", "a", "b"))
    merges = running_before(merges, keys, F.col("o"), F.lit(1), "r")
    return every, merges.select(*keys, (F.col("r") + 1).alias("step"), "a", "b", "delta", "gain")


def cut_walks(every: DataFrame, merges: DataFrame, keys: list[str] = [KEY], k: int | None = None) -> DataFrame:
    """``keys + [sku, cluster]`` of the dendrogram at its best modularity, or with ``k`` communities; fewer
    than a graph's connected components is an error, and a graph of at most ``k`` vertices is not merged."""
    if k is None:
        return cut_merges(merges, every, best_cut_steps(merges, keys), keys)
    sizes = every.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.join(merges.groupBy(*keys).agg(F.max("step").alias("last")), keys, "left")
    if not sizes.filter(F.col("n") - F.coalesce("last", F.lit(0)) > F.lit(k)).isEmpty():
        raise ValueError(f"k = {k} is below the number of connected components of a graph")
    return cut_merges(merges, every, sizes.select(*keys, F.greatest(F.col("n") - F.lit(k), F.lit(0)).alias("upto")), keys)


def walktrap_labels(edges: DataFrame, keys: list[str] = [KEY], k: int | None = None) -> DataFrame:
    """``keys + [sku, label]``."""
    every, merges = walktrap_merges(edges, keys)
    return cut_walks(every, merges, keys, k).withColumnRenamed("cluster", "label")


def walktrap(edges: DataFrame, k: int | None = None, keys: list[str] = [KEY]) -> DataFrame:
    """G3 (method 2): ``keys + [sku, cluster]``."""
    return as_membership(walktrap_labels(edges, keys, k), keys)


def unmerged(edges: DataFrame, merges: DataFrame, keys: list[str] = [KEY]) -> DataFrame:
    """A row of ``keys`` for every positive edge whose ends the whole dendrogram leaves apart; none is left."""
    every = vertices(simplify(edges, keys), keys).withColumnRenamed("v", "sku")
    ends = merges.groupBy(*keys).agg(F.max("step").alias("upto"))
    final = cut_lineage(cut_merges(merges, every, ends, keys), "clusters")
    at = lambda c: final.select(*keys, F.col("sku").alias(c), F.col("cluster").alias("c" + c))
    e = simplify(edges, keys).filter(F.col("weight") > 0)
    return e.join(at("src"), [*keys, "src"]).join(at("dst"), [*keys, "dst"]).filter(F.col("csrc") != F.col("cdst")).select(*keys)

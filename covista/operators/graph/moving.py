"""Local moving of vertices between communities (G5 multilevel, G8 and G9 Potts models).

Objective, in edge-weight units, for a partition c of a graph with positive part w⁺ and negative
part w⁻ (Traag & Bruggeman 2009; with w⁻ = 0 and γ it is Reichardt & Bornholdt's Potts model,
with γ = 1 it is modularity × 2m):

    H = Σ_{c(v)=c(u)} (w⁺_vu − w⁻_vu) − γ Σ_c (K⁺_c)² / 2m⁺ + λ Σ_c (K⁻_c)² / 2m⁻

Moving v from community a to c changes H by twice

    [w⁺(v→c) − γ k⁺_v K⁺_c / 2m⁺] − [w⁺(v→a∖v) − γ k⁺_v (K⁺_a − k⁺_v) / 2m⁺]   minus the same
    bracket built from w⁻, k⁻, K⁻, 2m⁻ and λ.

A round: every vertex finds its best move to a neighbouring community (largest gain, then smallest
community id).  Two moves i: a→c and j: b→d together change H by the sum of their gains plus

    (w_ij − γ k⁺_i k⁺_j / 2m⁺ …) · ([c=d] + [a=b] − [c=b] − [a=d])      (with the signs turned for w⁻, k⁻).

So a vertex waits if a neighbour with a better move (larger gain, then smaller id) makes the link's
share negative: over a positive link one goes where the other leaves, over a negative link both go to
or leave one community.  The share of the strengths is bounded: a move is accepted if its gain exceeds
γ k⁺_i k⁺_j / 2m⁺ over all better moves with the same target or the same source (and λ k⁻_i k⁻_j / 2m⁻
over those that touch either community).  The accepted moves then raise H strictly, the best move of a
graph is always accepted, and the loop ends with no improving move left.  Then the graph is contracted
(communities become vertices, parallel rows summed, loops kept) and the next level starts, as in the
multilevel method, until a level has no move.  All graphs
(categories, clusters being split) move in the same jobs, keyed by ``keys``.  A round writes two
tables, the moves and the new state, and deletes those of the round before.

Edges are split by the joins (written tables on both sides) where a hub holds many of them.  The moves
that touch one community are ordered by a window while no community has more than ``WINDOW_ROWS`` of them;
beyond that, running sums over range partitions give the same sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.ranking import running_before
from ...runtime import KEY, cut_lineage, drop_table
from .core import as_membership, directed, simplify, with_int_weight

TOL = 1e-10          # a gain counts from this share of the vertex's weight on
SAFETY = 100_000     # rounds of a level; reaching it raises
WINDOW_ROWS = 50_000 # moves of one community that one task orders


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def level0(edges: DataFrame, keys: list[str], signed: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, state, totals)`` of the graph with every vertex alone in its community.

    ``rows``: both directions of every edge with its positive and negative integer weight.  ``state``:
    ``keys + [v, c, kp, kn]``.  Without ``signed`` only positive weights link; vertices stay.
    """
    e = with_int_weight(simplify(edges, keys), keys)
    e = e.select(*keys, "src", "dst", F.greatest("w", F.lit(0)).alias("wp"),
                 F.greatest(-F.col("w"), F.lit(0)).alias("wn") if signed else F.lit(0).cast("bigint").alias("wn"))
    rows = cut_lineage(directed(e, keys, ["wp", "wn"]))
    state = rows.groupBy(*keys, "v").agg(F.sum("wp").alias("kp"), F.sum("wn").alias("kn"))
    state = cut_lineage(state.select(*keys, "v", F.col("v").alias("c"), "kp", "kn"))
    totals = cut_lineage(state.groupBy(*keys).agg(F.sum("kp").cast("double").alias("mp2"), F.sum("kn").cast("double").alias("mn2")))
    return rows, state, totals


def best_moves(rows: DataFrame, state: DataFrame, totals: DataFrame, keys: list[str], gamma: float, lam: float) -> DataFrame:
    """The improving move of every vertex that has one: ``keys + [v, a, c, gain, kp, kn]``."""
    strength = state.groupBy(*keys, "c").agg(F.sum("kp").cast("double").alias("sum_p"), F.sum("kn").cast("double").alias("sum_n"))
    near = (rows.filter(F.col("v") != F.col("u"))
                .join(state.select(*keys, F.col("v").alias("u"), "c"), [*keys, "u"])
                .groupBy(*keys, "v", "c").agg(F.sum("wp").cast("double").alias("tp"), F.sum("wn").cast("double").alias("tn")))
    # a row for the own community even without a link into it
    own = state.select(*keys, "v", "c", F.lit(0.0).alias("tp"), F.lit(0.0).alias("tn"))
    options = near.unionByName(own).groupBy(*keys, "v", "c").agg(F.sum("tp").alias("tp"), F.sum("tn").alias("tn"))
    me = state.select(*keys, "v", F.col("c").alias("a"), F.col("kp").cast("double").alias("kp"), F.col("kn").cast("double").alias("kn"))
    options = options.join(me, [*keys, "v"]).join(strength, [*keys, "c"]).join(totals, keys)
    home = F.col("c") == F.col("a")
    kp_in, kn_in = (F.col(K) - F.when(home, F.col(k)).otherwise(0.0) for K, k in (("sum_p", "kp"), ("sum_n", "kn")))
    score = ((F.col("tp") - F.lit(gamma) * _div(F.col("kp") * kp_in, F.col("mp2")))
             - (F.col("tn") - F.lit(lam) * _div(F.col("kn") * kn_in, F.col("mn2"))))
    best = options.withColumn("score", score).groupBy(*keys, "v", "a", "kp", "kn").agg(
        F.max(F.when(~home, F.struct("score", (-F.col("c")).alias("nc")))).alias("b"),
        F.max(F.when(home, F.col("score"))).alias("stay"))
    gain = F.col("b.score") - F.col("stay")
    return (best.filter(F.col("b").isNotNull() & (gain > F.lit(TOL) * (F.col("kp") + F.col("kn"))))
                .select(*keys, "v", "a", (-F.col("b.nc")).alias("c"), gain.alias("gain"), "kp", "kn"))


def _touching(moves: DataFrame) -> DataFrame:
    """Every move once for the community it leaves and once for the one it goes to: ``x``, ``to``."""
    return (moves.withColumn("x", F.col("a")).withColumn("to", F.lit(False))
                 .unionByName(moves.withColumn("x", F.col("c")).withColumn("to", F.lit(True))))


def most_moves(moves: DataFrame, keys: list[str]) -> int:
    """The number of moves that touch the most touched community; 0 without a move."""
    return _touching(moves).groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def accepted_moves(rows: DataFrame, moves: DataFrame, totals: DataFrame, keys: list[str], gamma: float, lam: float,
                   hub: bool = False) -> DataFrame:
    """``keys + [v, to]``: moves that can be made together, see the module's description; ``hub``: a
    community may be touched by more moves than one task should order."""
    mine = moves.select(*keys, "v", "a", "c", F.col("gain").alias("g"))
    other = moves.select(*keys, F.col("v").alias("u"), F.col("a").alias("b"), F.col("c").alias("d"), F.col("gain").alias("gu"))
    better = (F.col("gu") > F.col("g")) | (F.col("gu") == F.col("g")) & (F.col("u") < F.col("v"))
    cross = (F.col("c") == F.col("b")) | (F.col("a") == F.col("d"))
    alike = (F.col("c") == F.col("d")) | (F.col("a") == F.col("b"))
    wait = (rows.filter(F.col("v") != F.col("u")).join(mine, [*keys, "v"]).join(other, [*keys, "u"])
                .filter(better & ((F.col("wp") > 0) & cross | (F.col("wn") > 0) & alike))
                .select(*keys, "v").distinct())
    free = moves.join(wait, [*keys, "v"], "left_anti")
    touch = _touching(free)

    def taken(df, k, out, *same):
        if hub:
            order = F.struct((-F.col("gain")).alias("g"), "v", "to")
            return running_before(df.withColumn("o", order), [*keys, "x", *same], F.col("o"), F.col(k), out).drop("o")
        before = Window.partitionBy(*keys, "x", *same).orderBy(F.desc("gain"), "v").rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(k).over(before), F.lit(0.0)))
    touch = taken(touch, "kp", "rp", "to")
    touch = taken(touch, "kn", "rn") if lam > 0 else touch.withColumn("rn", F.lit(0.0))
    held = (touch.groupBy(*keys, "v", "c", "gain", "kp", "kn").agg(F.sum("rp").alias("rp"), F.sum("rn").alias("rn"))
                 .join(totals, keys))
    lost = (F.lit(gamma) * _div(F.col("kp") * F.col("rp"), F.col("mp2")) + F.lit(lam) * _div(F.col("kn") * F.col("rn"), F.col("mn2")))
    return held.filter(F.col("gain") > lost).select(*keys, "v", F.col("c").alias("to"))


def move_level(rows: DataFrame, state: DataFrame, totals: DataFrame, keys: list[str], gamma: float, lam: float):
    """Rounds until no vertex has an improving move; returns ``(state, whether any vertex moved)``."""
    moved = False
    for _ in range(SAFETY):
        moves = cut_lineage(best_moves(rows, state, totals, keys, gamma, lam), "moves")
        most = most_moves(moves, keys)
        if not most:
            drop_table(moves)
            return state, moved
        taken = accepted_moves(rows, moves, totals, keys, gamma, lam, most > WINDOW_ROWS)
        new = cut_lineage(state.join(taken, [*keys, "v"], "left").select(*keys, "v", F.coalesce("to", "c").alias("c"), "kp", "kn"), "state")
        if moved:
            drop_table(state)
        drop_table(moves)
        state, moved = new, True
    raise RuntimeError("local moving did not converge")


def contract(rows: DataFrame, state: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows and state of the graph whose vertices are the communities of ``state``."""
    label = state.select(*keys, "v", "c")
    to = lambda end, new: label.select(*keys, F.col("v").alias(end), F.col("c").alias(new))
    rows = cut_lineage(rows.join(to("v", "cv"), [*keys, "v"]).join(to("u", "cu"), [*keys, "u"])
                           .groupBy(*keys, F.col("cv").alias("v"), F.col("cu").alias("u"))
                           .agg(F.sum("wp").alias("wp"), F.sum("wn").alias("wn")))
    state = cut_lineage(state.groupBy(*keys, "c").agg(F.sum("kp").alias("kp"), F.sum("kn").alias("kn"))
                             .select(*keys, F.col("c").alias("v"), "c", "kp", "kn"))
    return rows, state


def local_moving_labels(edges: DataFrame, keys: list[str] = [KEY], gamma: float = 1.0, lam: float = 0.0,
                        signed: bool = False) -> DataFrame:
    """``keys + [sku, label]`` after multilevel local moving, run until no level has a move."""
    rows, state, totals = level0(edges, keys, signed)
    mapping = state.select(*keys, F.col("v").alias("sku"), "v")
    while True:
        new, moved = move_level(rows, state, totals, keys, gamma, lam)
        if not moved:
            drop_table(rows)
            return mapping.select(*keys, "sku", F.col("v").alias("label"))
        mapping = cut_lineage(mapping.join(new.select(*keys, "v", "c"), [*keys, "v"]).select(*keys, "sku", F.col("c").alias("v")), "labels")
        old = rows
        rows, state = contract(rows, new, keys)
        drop_table(old)
        drop_table(new)


def moves_left(edges: DataFrame, membership: DataFrame, keys: list[str] = [KEY], gamma: float = 1.0, lam: float = 0.0,
               signed: bool = False, label: str = "cluster") -> DataFrame:
    """``keys + [v, a, c, gain, kp, kn]``: merges of a whole community into a neighbouring one that would
    still raise H; none are left after ``local_moving_labels``."""
    rows, state, totals = level0(edges, keys, signed)
    named = membership.select(*keys, F.col("sku").alias("v"), F.col(label).cast("bigint").alias("c"))
    rows, state = contract(rows, state.drop("c").join(named, [*keys, "v"]), keys)
    return best_moves(rows, state, totals, keys, gamma, lam)


def louvain(edges: DataFrame, gamma: float = 1.0, keys: list[str] = [KEY]) -> DataFrame:
    """G5 (method 4): multilevel modularity communities, ``keys + [sku, cluster]``."""
    return as_membership(local_moving_labels(edges, keys, gamma), keys)


def potts_communities(edges: DataFrame, gamma: float = 1.0, keys: list[str] = [KEY]) -> DataFrame:
    """G8 (method 8): Potts model on positive links with resolution γ (same energy as the
    original's spin glass; minimised by local moving instead of simulated annealing)."""
    return as_membership(local_moving_labels(edges, keys, gamma), keys)


def signed_potts_communities(edges: DataFrame, gamma: float = 1.0, lam: float = 1.0, keys: list[str] = [KEY]) -> DataFrame:
    """G9 (method 7): Potts model with positive and negative links (γ for w⁺, λ for w⁻)."""
    return as_membership(local_moving_labels(edges, keys, gamma, lam, True), keys)


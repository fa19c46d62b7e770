"""Agglomerative merging (G2 fast greedy) and dendrogram cuts.

Fast greedy joins the adjacent communities whose merge raises modularity most.  Sequential single
merges would need one job per merge, so a round makes many of them.  Every community picks its best
neighbour (largest ΔQ, ties by smallest pair).  Of two that pick each other, the one that more
communities picked is a centre, and all that picked it may join it: a hub takes its leaves in one
round.  Members that join one centre take from each other's gain, by k_i k_j / m2² each; one joins
only if its ΔQ exceeds that sum over all better ones, and waits if it is linked to a better one.  So
every gain in the merge table is exact and positive, and the best merge of a graph is always made.

Without ``k`` merging stops when no merge has positive ΔQ (the best cut of this dendrogram).  With
``k`` it goes on through negative merges, one pair per centre, until ``k`` communities remain; fewer
than the connected components is an error.  The result can differ from the strictly sequential order;
the merge table records every step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.ranking import running_before
from ...runtime import KEY, cut_lineage, drop_table
from .core import as_membership, directed, simplify, vertices, with_int_weight

TOL = 1e-12
SAFETY = 100_000     # rounds; reaching it raises
UNIT = float(1 << 60)
WINDOW_ROWS = 50_000 # members of one centre that one task orders; beyond that range partitions do


def _pairs(rows: DataFrame, nodes: DataFrame, tot: DataFrame, keys: list[str]) -> DataFrame:
    """Half the modularity gain of every merge of adjacent communities, one row per direction."""
    other = nodes.select(*keys, F.col("v").alias("u"), F.col("kv").alias("ku"))
    return (rows.filter(F.col("v") != F.col("u")).join(nodes, [*keys, "v"]).join(other, [*keys, "u"]).join(tot, keys)
                .select(*keys, "v", "u", "kv", "m2", (F.col("w").cast("double") / F.col("m2")
                        - F.col("kv").cast("double") * F.col("ku") / (F.col("m2") * F.col("m2"))).alias("dq")))


def _joins(rows: DataFrame, pairs: DataFrame, keys: list[str], negative: bool) -> DataFrame:
    """``keys + [v, a, dq, gain]``: communities ``v`` that join the centre ``a`` in this round."""
    order = F.struct("dq", (-F.least("v", "u")).alias("x"), (-F.greatest("v", "u")).alias("y"))
    best = pairs.groupBy(*keys, "v", "kv", "m2").agg(F.max(F.struct(order.alias("o"), F.col("u"))).alias("b"))
    best = best.select(*keys, "v", "kv", "m2", F.col("b.u").alias("u"), F.col("b.o.dq").alias("dq"))
    if not negative:
        best = best.filter(F.col("dq") > F.lit(TOL))
    best = cut_lineage(best, "best")
    liked = best.groupBy(*keys, F.col("u").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    back = best.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))
    mutual = best.select(*keys, "v", "u").join(back, [*keys, "u", "v"])
    mutual = (mutual.join(liked, [*keys, "v"], "left").join(
        liked.select(*keys, F.col("v").alias("u"), F.col("n").alias("nu")), [*keys, "u"], "left"))
    centre = mutual.filter((F.col("n") > F.col("nu")) | (F.col("n") == F.col("nu")) & (F.col("v") < F.col("u")))
    come = best.join(centre.select(*keys, F.col("v").alias("u")), [*keys, "u"], "left_semi")
    mine = come.select(*keys, "v", F.col("u").alias("a"), F.col("dq").alias("d"))
    theirs = come.select(*keys, F.col("v").alias("u"), F.col("u").alias("a"), F.col("dq").alias("du"))
    wait = (rows.filter(F.col("v") != F.col("u")).select(*keys, "v", "u").join(mine, [*keys, "v"]).join(theirs, [*keys, "u", "a"])
                .filter((F.col("du") > F.col("d")) | (F.col("du") == F.col("d")) & (F.col("u") < F.col("v")))
                .select(*keys, "v").distinct())
    hub = (liked.agg(F.max("n")).first()[0] or 0) > WINDOW_ROWS
    before = Window.partitionBy(*keys, "u").orderBy(F.desc("dq"), "v").rowsBetween(Window.unboundedPreceding, -1)

    def earlier(df, amount, out):
        """``df`` with the sum of ``amount`` over the better members of the same centre."""
        if hub:
            order = F.struct((-F.col("dq")).alias("g"), "v")
            return running_before(df.withColumn("o", order), [*keys, "u"], F.col("o"), amount, out).drop("o")
        return df.withColumn(out, F.coalesce(F.sum(amount.cast("double")).over(before), F.lit(0.0)))

    def with_lost(df):
        taken = earlier(df.drop("lost"), F.col("kv"), "taken")
        return taken.withColumn("lost", F.col("kv").cast("double") * F.col("taken") / (F.col("m2") * F.col("m2"))).drop("taken")
    free = with_lost(come.join(wait, [*keys, "v"], "left_anti"))
    if negative:   # the best of a centre only, so that the last merges can be counted out
        free = earlier(free, F.lit(1), "r").filter("r = 0")
    else:
        free = with_lost(free.filter(F.col("dq") - F.col("lost") > F.lit(TOL)))
    return free.select(*keys, "v", F.col("u").alias("a"), "dq", (F.col("dq") - F.col("lost")).alias("gain"))


def first_joins(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The joins of a round from single vertices, and the vertices' weights."""
    nodes = cut_lineage(rows.groupBy(*keys, "v").agg(F.sum("w").alias("kv")))
    tot = nodes.groupBy(*keys).agg(F.sum("kv").cast("double").alias("m2"))
    return _joins(rows, _pairs(rows, nodes, tot, keys), keys, False), nodes


def fast_greedy_merges(edges: DataFrame, keys: list[str] = [KEY], k: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Return ``(labels, merges)``: ``keys + [sku, label]`` and ``keys + [step, a, b, gain]``."""
    e = with_int_weight(simplify(edges, keys), keys)
    every = vertices(e, keys).select(*keys, F.col("v").alias("sku"), F.col("v"))
    rows = cut_lineage(directed(e.filter(F.col("w") > 0), keys, ["w"]))
    nodes = cut_lineage(rows.groupBy(*keys, "v").agg(F.sum("w").alias("kv")))
    tot = cut_lineage(nodes.groupBy(*keys).agg(F.sum("kv").cast("double").alias("m2")))
    mapping = cut_lineage(every)
    done = cut_lineage(tot.select(*keys, F.lit(0).cast("bigint").alias("done")))
    rounds: list[DataFrame] = []
    for _ in range(SAFETY):
        pairs = _pairs(rows, nodes, tot, keys)
        joins = cut_lineage(_joins(rows, pairs, keys, False), "joins")
        if joins.isEmpty() and k is not None:
            drop_table(joins)
            joins = cut_lineage(_joins(rows, pairs, keys, True), "joins")
        if k is not None:   # only as many merges, best first, as leave k communities
            order = F.struct((-F.col("gain")).alias("g"), "a", "v")
            ranked = running_before(joins.withColumn("o", order), keys, F.col("o"), F.lit(1), "r")
            count = mapping.select(*keys, "v").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("nc"))
            joins = cut_lineage(ranked.join(count, keys).filter(F.col("r") < F.col("nc") - F.lit(k)).select(*joins.columns), "joins")
        if joins.isEmpty():
            break
        order = F.struct((-F.col("gain")).alias("g"), "a", "v")
        steps = running_before(joins.withColumn("o", order), keys, F.col("o"), F.lit(1), "r").join(done, keys)
        rounds.append(cut_lineage(steps.select(*keys, (F.col("done") + F.col("r") + 1).alias("step"), "a", F.col("v").alias("b"),
                                               (F.col("gain") * 2).alias("gain")), "merges"))
        made = rounds[-1].groupBy(*keys).agg(F.max("step").alias("last"))
        new_done = cut_lineage(done.join(made, keys, "left").select(*keys, F.coalesce("last", "done").alias("done")))
        to = joins.select(*keys, "v", F.col("a").alias("t"))

        def moved(df, c):
            return (df.join(to.withColumnRenamed("v", c).withColumnRenamed("t", c + "_t"), [*keys, c], "left")
                      .withColumn(c, F.coalesce(c + "_t", c)).drop(c + "_t"))
        old = (rows, nodes, mapping, done, joins)
        rows = cut_lineage(moved(moved(rows, "v"), "u").groupBy(*keys, "v", "u").agg(F.sum("w").alias("w")))
        nodes = cut_lineage(moved(nodes, "v").groupBy(*keys, "v").agg(F.sum("kv").alias("kv")))
        mapping = cut_lineage(moved(mapping, "v"))
        done = new_done
        for table in old:
            drop_table(table)
    else:
        raise RuntimeError("merging did not end")
    if k is not None:
        over = mapping.select(*keys, "v").distinct().groupBy(*keys).count().filter(F.col("count") > F.lit(k))
        if not over.isEmpty():
            raise ValueError(f"k = {k} is below the number of connected components of a graph")
    merges = tot.limit(0).select(*keys, *[F.lit(0).cast(t).alias(c) for c, t in
                                          (("step", "bigint"), ("a", "bigint"), ("b", "bigint"), ("gain", "double"))])
    for table in rounds:
        merges = merges.unionByName(table)
    return mapping.select(*keys, "sku", F.col("v").alias("label")), merges


def fast_greedy(edges: DataFrame, k: int | None = None, keys: list[str] = [KEY]) -> DataFrame:
    """G2 (method 1): ``keys + [sku, cluster]``."""
    labels, _ = fast_greedy_merges(edges, keys, k)
    return as_membership(labels, keys)


def cut_merges(merges: DataFrame, vertices: DataFrame, steps: DataFrame, keys: list[str] = [KEY]) -> DataFrame:
    """Apply the merges with ``step <= upto`` (``steps`` = keys + [upto]) to ``vertices``
    (keys + [sku]) and return ``keys + [sku, cluster]``: the communities at that cut."""
    from .core import connected_components
    kept = (merges.join(steps, keys).filter(F.col("step") <= F.col("upto"))
                  .select(*keys, F.col("a").alias("src"), F.col("b").alias("dst")))
    comp = connected_components(kept, keys)
    lab = (vertices.join(comp, [*keys, "sku"], "left")
                   .select(*keys, "sku", F.coalesce("comp", "sku").alias("label")))
    return as_membership(lab, keys)


def best_cut_steps(merges: DataFrame, keys: list[str] = [KEY]) -> DataFrame:
    """The step with the highest cumulative ΔQ per graph (0 = no merge), for ``cut_merges``.  Gains are
    summed as multiples of 2^-60, which no sum of a dendrogram's gains overflows."""
    unit = merges.withColumn("g", F.round(F.col("gain") * F.lit(UNIT)).cast("bigint"))
    cum = running_before(unit, keys, "step", F.col("g"), "q").withColumn("q", F.col("q") + F.col("g"))
    best = cum.groupBy(*keys).agg(F.max(F.struct("q", (-F.col("step")).alias("ns"))).alias("b"))
    return best.select(*keys, F.when(F.col("b.q") > 0, -F.col("b.ns")).otherwise(F.lit(0)).cast("bigint").alias("upto"))

"""Graph building blocks (G1, G10, G12, G13, G15, components).

A graph is a DataFrame of undirected edges ``keys + [src, dst, weight]``; its vertices are the
endpoints (a SKU without a surviving edge is not in the graph).  ``keys`` (by default the
category) separates independent graphs, so every method runs on all of them in one job.
Weights used for sums and ties are integers (``with_int_weight``), so results do not depend on the
order of floating-point additions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.ranking import running_before
from ...runtime import KEY, cut_lineage, drop_table

def with_int_weight(edges: DataFrame, keys: list[str], out: str = "w") -> DataFrame:
    """``edges`` with an integer weight: ``weight`` times a power of two that is the largest, per graph,
    for which the graph's sum of weights stays below 2^60; a weight that is not 0 is at least 1 in size,
    so that no edge vanishes."""
    bits = F.length(F.bin(F.ceil(F.max(F.abs("weight")) * F.count(F.lit(1))).cast("bigint")))
    scale = edges.groupBy(*keys).agg(F.pow(F.lit(2.0), (F.lit(60) - bits).cast("double")).alias("_scale"))
    scaled = F.round(F.col("weight") * F.col("_scale")).cast("bigint")
    return (edges.join(scale, keys).withColumn(out, F.when(F.col("weight") > 0, F.greatest(scaled, F.lit(1)))
                                               .when(F.col("weight") < 0, F.least(scaled, F.lit(-1))).otherwise(F.lit(0)))
                 .drop("_scale"))


def simplify(edges: DataFrame, keys: list[str] = [KEY]) -> DataFrame:
    """G1: drop loops and collapse parallel edges in either direction to the largest weight."""
    e = edges.select(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    return e.filter(F.col("src") != F.col("dst")).groupBy(*keys, "src", "dst").agg(F.max("weight").alias("weight"))


def directed(edges: DataFrame, keys: list[str], wcols: list[str]) -> DataFrame:
    """Both directions of every undirected edge: ``keys + [v, u] + wcols``."""
    a = edges.select(*keys, F.col("src").alias("v"), F.col("dst").alias("u"), *wcols)
    b = edges.select(*keys, F.col("dst").alias("v"), F.col("src").alias("u"), *wcols)
    return a.unionByName(b)


def vertices(edges: DataFrame, keys: list[str] = [KEY]) -> DataFrame:
    return (edges.select(*keys, F.col("src").alias("v"))
            .unionByName(edges.select(*keys, F.col("dst").alias("v"))).distinct())


def modularity(edges: DataFrame, membership: DataFrame, gamma: float = 1.0, keys: list[str] = [KEY],
               label: str = "cluster") -> DataFrame:
    """``keys + [modularity]`` of a partition: Σ_c in_c/2m − γ Σ_c (K_c/2m)².

    ``membership`` is ``keys + [sku, label]``; edges are undirected and simple.
    """
    d = directed(edges, keys, ["weight"])
    m = membership.select(*keys, "sku", F.col(label).alias("c"))
    ends = (d.join(m.withColumnRenamed("sku", "v").withColumnRenamed("c", "cv"), [*keys, "v"])
             .join(m.withColumnRenamed("sku", "u").withColumnRenamed("c", "cu"), [*keys, "u"]))
    inside = ends.groupBy(*keys).agg(
        F.sum(F.when(F.col("cv") == F.col("cu"), F.col("weight")).otherwise(0.0)).alias("w_in"),
        F.sum("weight").alias("m2"))
    kc = ends.groupBy(*keys, "cv").agg(F.sum("weight").alias("K"))
    kk = kc.join(inside.select(*keys, "m2"), keys).groupBy(*keys).agg(
        F.sum((F.col("K") / F.col("m2")) * (F.col("K") / F.col("m2"))).alias("kk"))
    return inside.join(kk, keys).select(
        *keys, (F.col("w_in") / F.col("m2") - F.lit(gamma) * F.col("kk")).alias("modularity"))


def induced_edges(edges: DataFrame, membership: DataFrame, keys: list[str] = [KEY],
                  label: str = "cluster") -> DataFrame:
    """Edges whose two ends are in the same cluster, tagged with that cluster."""
    m = membership.select(*keys, "sku", F.col(label).alias("c"))
    return (edges.join(m.withColumnRenamed("sku", "src").withColumnRenamed("c", "c1"), [*keys, "src"])
                 .join(m.withColumnRenamed("sku", "dst").withColumnRenamed("c", "c2"), [*keys, "dst"])
                 .filter(F.col("c1") == F.col("c2"))
                 .select(*keys, F.col("c1").alias(label), "src", "dst", "weight"))


def as_membership(labels: DataFrame, keys: list[str] = [KEY], label: str = "label",
                  out: str = "cluster") -> DataFrame:
    """``keys + [sku, out]`` with 1-based cluster ids ordered by each cluster's smallest SKU.

    Clusters are numbered over range partitions, so no task holds all clusters of a graph.
    """
    first = labels.groupBy(*keys, label).agg(F.min("sku").alias("first_sku"))
    ranked = running_before(first, keys, "first_sku", F.lit(1), out).withColumn(out, F.col(out) + 1)
    return labels.join(ranked.select(*keys, label, out), [*keys, label]).select(*keys, "sku", out)


def graph_export(edges: DataFrame, membership: DataFrame, keys: list[str] = [KEY],
                 label: str = "cluster") -> DataFrame:
    """The data part of the original drawing: each edge with its display width
    (weight / 10) and the clusters of its two ends."""
    m = membership.select(*keys, "sku", F.col(label).alias("c"))
    return (edges.join(m.withColumnRenamed("sku", "src").withColumnRenamed("c", "cluster_src"), [*keys, "src"], "left")
                 .join(m.withColumnRenamed("sku", "dst").withColumnRenamed("c", "cluster_dst"), [*keys, "dst"], "left")
                 .select(*keys, "src", "dst", "weight", (F.col("weight") / 10).alias("width"),
                         "cluster_src", "cluster_dst"))


def connected_components(edges: DataFrame, keys: list[str] = [KEY], max_rounds: int = 1000) -> DataFrame:
    """``keys + [sku, component]``: component = smallest vertex id reachable.

    Rounds of min-label spreading, each followed by pointer jumping (a vertex takes its label's
    label), which shortens the number of rounds on long paths.  One small count per round tests
    convergence.
    """
    d = directed(edges.select(*keys, "src", "dst"), keys, [])
    state = cut_lineage(vertices(edges, keys).select(*keys, F.col("v").alias("sku"), F.lit(None).cast("bigint").alias("old"),
                                                     F.col("v").alias("comp")))
    for _ in range(max_rounds):
        lab = state.select(*keys, "sku", "comp")
        nb = (d.join(lab.withColumnRenamed("sku", "u").withColumnRenamed("comp", "cu"), [*keys, "u"])
                .groupBy(*keys, F.col("v").alias("sku")).agg(F.min("cu").alias("cn")))
        step = (lab.join(nb, [*keys, "sku"], "left")
                   .select(*keys, "sku", "comp", F.least("comp", F.coalesce("cn", "comp")).alias("c1")))
        jump = step.select(*keys, F.col("sku").alias("c1"), F.col("c1").alias("c2"))
        new = cut_lineage(step.join(jump, [*keys, "c1"], "left").select(
            *keys, "sku", F.col("comp").alias("old"), F.least("c1", F.coalesce("c2", "c1")).alias("comp")))
        drop_table(state)
        state = new
        if new.filter(F.col("old") != F.col("comp")).isEmpty():
            return new.select(*keys, "sku", "comp")
    raise RuntimeError("connected components did not converge within max_rounds")

"""Community method dispatch and splitting of oversized clusters.

``split_large`` reruns ``sub_method`` on the induced subgraph of every cluster with more than
``cl_size_thresh`` members, starting at γ = ``sg_gamma`` and raising γ by 0.5 per try until the
largest part fits or ``iter_count`` tries are used; the last try is kept even if still too large.
Only the resolution methods (7, 8) change with γ, so other methods get one try.  All oversized
clusters of all categories run together, keyed by ``(sub_category, parent)``; finished ones
leave the loop.  Labels become ``"cluster-sub"``; clusters that were not split get sub-id 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...params import RESOLUTION_METHODS, Params
from ...runtime import KEY, cut_lineage
from .core import as_membership, induced_edges
from .eigen import leading_eigenvector_labels
from .label_prop import label_propagation_labels
from .merges import fast_greedy_merges
from .moving import local_moving_labels, moves_left
from .walktrap import walktrap_labels


def community_labels(edges: DataFrame, method: int, p: Params, keys: list[str] = [KEY],
                     gamma: float | None = None) -> DataFrame:
    """``keys + [sku, label]`` for community method ``method`` (``params.METHODS``)."""
    gamma = p.sg_gamma if gamma is None else gamma
    if method == 1:
        return fast_greedy_merges(edges, keys, p.k)[0]
    if method == 2:
        return walktrap_labels(edges, keys, p.k)
    if method == 3:
        return leading_eigenvector_labels(edges, keys)
    if method == 4:
        return local_moving_labels(edges, keys, 1.0)
    if method == 6:
        return label_propagation_labels(edges, keys)
    if method == 7:
        return local_moving_labels(edges, keys, gamma, p.sg_lambda, True)
    if method == 8:
        return local_moving_labels(edges, keys, gamma)
    raise ValueError(f"no community method has the code {method!r}")


def detect(edges: DataFrame, p: Params, method: int | None = None, keys: list[str] = [KEY]) -> DataFrame:
    """Top-level communities: ``keys + [sku, cluster]`` with 1-based ids."""
    return as_membership(community_labels(edges, p.method if method is None else method, p, keys), keys)


def split_parts(edges: DataFrame, membership: DataFrame, p: Params, keys: list[str] = [KEY]) -> DataFrame | None:
    """The parts of every cluster that is too large, ``keys + [parent, sku, sub, gamma]`` with the γ of the
    cluster's last try, or None if none is."""
    sizes = membership.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("size"))
    big = sizes.filter(F.col("size") > F.lit(p.cl_size_thresh)).select(*keys, F.col("cluster").alias("parent"))
    gk = [*keys, "parent"]
    members = cut_lineage(membership.withColumnRenamed("cluster", "parent").join(big, gk, "left_semi")
                          .select(*gk, "sku"))
    sub_edges = cut_lineage(induced_edges(edges, membership, keys).withColumnRenamed("cluster", "parent")
                            .join(big, gk, "left_semi"))
    tries = p.iter_count if p.sub_method in RESOLUTION_METHODS else 1
    pending = members.select(*gk).distinct()
    done = None
    gamma = p.sg_gamma
    for t in range(1, tries + 1):
        if pending.isEmpty():
            break
        e = sub_edges.join(pending, gk, "left_semi")
        lab = community_labels(e, p.sub_method, p, gk, gamma)
        # members without an internal edge form their own part, as isolated vertices do
        lab = (members.join(pending, gk, "left_semi").join(lab, [*gk, "sku"], "left")
                      .select(*gk, "sku", F.coalesce("label", "sku").alias("label")))
        sub = cut_lineage(as_membership(lab, gk, out="sub").withColumn("gamma", F.lit(float(gamma))))
        biggest = sub.groupBy(*gk, "sub").count().groupBy(*gk).agg(F.max("count").alias("mx"))
        fits = biggest.filter(F.col("mx") <= F.lit(p.cl_size_thresh)).select(*gk)
        finished = sub if t == tries else sub.join(fits, gk, "left_semi")
        done = cut_lineage(finished if done is None else done.unionByName(finished))
        pending = cut_lineage(pending.join(finished.select(*gk).distinct(), gk, "left_anti"))
        gamma += 0.5
    return done


def split_large(edges: DataFrame, membership: DataFrame, p: Params, keys: list[str] = [KEY],
                parts: DataFrame | None = None) -> DataFrame:
    """``keys + [sku, cluster, sub, cluster_id]`` with ``cluster_id = "cluster-sub"``; ``parts`` may be
    given, as ``split_parts`` returns them."""
    parts = split_parts(edges, membership, p, keys) if parts is None else parts
    if parts is not None:
        out = membership.join(parts.drop("gamma").withColumnRenamed("parent", "cluster"), [*keys, "cluster", "sku"], "left")
    else:
        out = membership.withColumn("sub", F.lit(None).cast("bigint"))
    out = out.withColumn("sub", F.coalesce("sub", F.lit(0)).cast("bigint"))
    return out.select(*keys, "sku", "cluster", "sub",
                      F.concat_ws("-", F.col("cluster").cast("string"), F.col("sub").cast("string")).alias("cluster_id"))


def split_moves_left(edges: DataFrame, membership: DataFrame, parts: DataFrame | None, p: Params,
                     keys: list[str] = [KEY]) -> DataFrame:
    """A row of ``keys`` for every merge of two communities that would still raise the objective: of the top
    clusters (method 4), and within every split cluster (method 8) with the γ of its last try."""
    if (p.method, p.sub_method) != (4, 8):
        raise ValueError("only methods 4 and 8 are checked")
    left = moves_left(edges, membership, keys).select(*keys)
    if parts is None:
        return left
    gk = [*keys, "parent"]
    inner = cut_lineage(induced_edges(edges, membership, keys).withColumnRenamed("cluster", "parent"))
    for gamma in sorted(r[0] for r in parts.select("gamma").distinct().collect()):     # at most one a try
        mine = parts.filter(F.col("gamma") == F.lit(gamma))
        own = inner.join(mine.select(*gk).distinct(), gk, "left_semi")
        left = left.unionByName(moves_left(own, mine, gk, gamma=gamma, label="sub").select(*keys))
    return left

"""Weighted label propagation until no vertex would change.

Every vertex starts with its own id as label and wants the label with the largest total edge weight
among its neighbours (ties: the smallest label), but only if that weight is strictly larger than its
own label's.  In a round the vertices that want to change do so, unless one takes the label that a
neighbour of higher priority (a hash of id and round, then the smaller id) gives up, or gives up the
label that this neighbour takes.  All other pairs of changes help each other or are independent, so the
weight inside labels rises by the sum of the gains at least, and the loop ends.  The result is
deterministic (the original's random order is not) and no vertex has a strictly better label left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...runtime import KEY, cut_lineage, drop_table
from .core import as_membership, directed, simplify, vertices, with_int_weight

SAFETY = 100_000   # rounds; reaching it raises
# Fixed values of the priority (v * MIX + round * STEP) mod PRIME, the same in Spark and SQL.
MIX, STEP, PRIME = 1_000_003, 7_919, 2_147_483_647


def wanted_labels(rows: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """``keys + [v, own, want]`` of the vertices with a strictly better label."""
    votes = (rows.join(labels.select(*keys, F.col("sku").alias("u"), "label"), [*keys, "u"])
                 .groupBy(*keys, "v", "label").agg(F.sum("w").alias("sw")))
    mine = labels.select(*keys, F.col("sku").alias("v"), F.col("label").alias("own"))
    best = votes.join(mine, [*keys, "v"]).groupBy(*keys, "v", "own").agg(
        F.max(F.struct("sw", (-F.col("label")).alias("nl"))).alias("b"),
        F.max(F.when(F.col("label") == F.col("own"), F.col("sw")).otherwise(F.lit(0))).alias("held"))
    return best.filter(F.col("b.sw") > F.col("held")).select(*keys, "v", "own", (-F.col("b.nl")).alias("want"))


def label_propagation_labels(edges: DataFrame, keys: list[str] = [KEY]) -> DataFrame:
    """``keys + [sku, label]`` of simplified edges with positive weight; other vertices stay alone."""
    e = with_int_weight(simplify(edges, keys), keys)
    rows = cut_lineage(directed(e.filter(F.col("w") > 0), keys, ["w"]))
    labels = cut_lineage(vertices(e, keys).select(*keys, F.col("v").alias("sku"), F.col("v").alias("label")))
    for r in range(SAFETY):
        wants = cut_lineage(wanted_labels(rows, labels, keys), "wants")
        if wants.isEmpty():
            drop_table(wants)
            drop_table(rows)
            return labels
        ranked = wants.withColumn("pr", (F.col("v") * MIX + F.lit(r * STEP)) % PRIME)
        other = ranked.select(*keys, F.col("v").alias("u"), F.col("pr").alias("pu"), F.col("own").alias("b"), F.col("want").alias("d"))
        wait = (rows.select(*keys, "v", "u").join(ranked, [*keys, "v"]).join(other, [*keys, "u"])
                    .filter((F.col("want") == F.col("b")) | (F.col("own") == F.col("d")))
                    .filter((F.col("pu") > F.col("pr")) | (F.col("pu") == F.col("pr")) & (F.col("u") < F.col("v")))
                    .select(*keys, "v").distinct())
        taken = wants.join(wait, [*keys, "v"], "left_anti").withColumnRenamed("v", "sku")
        new = cut_lineage(labels.join(taken.drop("own"), [*keys, "sku"], "left").select(*keys, "sku", F.coalesce("want", "label").alias("label")))
        drop_table(labels)
        drop_table(wants)
        labels = new
    raise RuntimeError("label propagation did not converge")


def label_propagation(edges: DataFrame, keys: list[str] = [KEY]) -> DataFrame:
    """``keys + [sku, cluster]`` with 1-based cluster ids (G12 numbering)."""
    return as_membership(label_propagation_labels(edges, keys), keys)


def label_propagation_sql(edges_sql: str) -> str:
    """The same rounds as a recursive CTE (DuckDB oracle): each step holds all labels of one round and
    the recursion ends with the round that changes nothing.  ``edges_sql`` must define a relation
    ``edges(sub_category, src, dst, weight)``; the result is ``sub_category, sku, cluster``."""
    return edges_sql.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
le AS MATERIALIZED (SELECT sub_category, least(src, dst) AS src, greatest(src, dst) AS dst, max(weight) AS weight
       FROM edges WHERE src <> dst GROUP BY sub_category, least(src, dst), greatest(src, dst)),
lscale AS (SELECT sub_category, pow(2.0, 60 - length(bin(cast(ceil(max(abs(weight)) * count(*)) AS bigint)))) AS s
       FROM le GROUP BY sub_category),
lw AS (SELECT le.sub_category, src, dst, greatest(cast(round(weight * s) AS bigint), 1) AS w
       FROM le JOIN lscale USING (sub_category) WHERE weight > 0),
gd AS MATERIALIZED (SELECT sub_category, src AS v, dst AS u, w FROM lw UNION ALL SELECT sub_category, dst, src, w FROM lw),
lps(r, changed, sub_category, sku, label) AS (
  SELECT DISTINCT 0, 1, sub_category, v, v FROM (SELECT sub_category, src AS v FROM le UNION ALL SELECT sub_category, dst FROM le) t
  UNION ALL
  (WITH cur AS (SELECT * FROM lps),
   votes AS (SELECT gd.sub_category, gd.v, c.label, sum(gd.w) AS sw FROM gd JOIN cur c
             ON c.sub_category = gd.sub_category AND c.sku = gd.u GROUP BY ALL),
   best AS (SELECT x.sub_category, x.v, any_value(c.r) AS r, any_value(c.label) AS own, arg_max(x.label, (x.sw, -x.label)) AS want, max(x.sw) AS top,
                   coalesce(max(CASE WHEN x.label = c.label THEN x.sw END), 0) AS held
            FROM votes x JOIN cur c ON c.sub_category = x.sub_category AND c.sku = x.v GROUP BY x.sub_category, x.v),
   wants AS (SELECT *, (v * {MIX} + r * {STEP}) % {PRIME} AS pr FROM best WHERE top > held),
   wait AS (SELECT DISTINCT a.sub_category, a.v FROM gd JOIN wants a ON a.sub_category = gd.sub_category AND a.v = gd.v
            JOIN wants b ON b.sub_category = gd.sub_category AND b.v = gd.u
            WHERE (b.pr > a.pr OR (b.pr = a.pr AND b.v < a.v)) AND (a.want = b.own OR a.own = b.want)),
   taken AS (SELECT w.sub_category, w.v, w.want FROM wants w ANTI JOIN wait x ON x.sub_category = w.sub_category AND x.v = w.v)
   SELECT c.r + 1, (SELECT count(*) FROM taken), c.sub_category, c.sku, coalesce(t.want, c.label)
   FROM cur c LEFT JOIN taken t ON t.sub_category = c.sub_category AND t.v = c.sku
   WHERE (SELECT count(*) FROM taken) > 0)
),
lf AS (SELECT sub_category, sku, label FROM lps WHERE r = (SELECT max(r) FROM lps)),
firsts AS (SELECT sub_category, label, min(sku) AS first_sku FROM lf GROUP BY sub_category, label),
ranked AS (SELECT sub_category, label, dense_rank() OVER (PARTITION BY sub_category ORDER BY first_sku) AS cluster
           FROM firsts)
SELECT lf.sub_category, lf.sku, ranked.cluster FROM lf JOIN ranked USING (sub_category, label)"""

"""Edge betweenness, the number of shortest paths through every edge.

Breadth-first search runs from all sources of all graphs at once, a level a round: the frontier is a table
of (source, vertex, number of shortest paths), joined with the edges.  In an undirected graph the
neighbours of a level lie in it, the one before or the next, so a round is compared with two levels only.
Then dependencies go back from the last level: the share of a vertex's paths that arrive through a
neighbour, times one plus its own dependency (Brandes 2001).  An edge's score is the sum over all
sources, halved, as every pair of vertices is counted from both ends.

Every vertex is a source unless ``sources`` names some; the scores then count the paths from these.  The
work is sources times edges, in rows, however the edges lie; all groups are keyed by source and vertex.
Paths are counted by edges, not by weights.  Counts are doubles, exact to 2^53 paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...runtime import KEY, cut_lineage, drop_table
from .core import directed, simplify

SAFETY = 100_000     # levels; reaching it raises


def path_levels(rows: DataFrame, sources: DataFrame, keys: list[str]) -> list[DataFrame]:
    """A table per distance: ``keys + [s, v, n]`` with the number of shortest paths from s to v."""
    sv = [*keys, "s", "v"]
    levels = [cut_lineage(sources.select(*keys, F.col("v").alias("s"), "v", F.lit(1.0).alias("n")), "level")]
    for _ in range(SAFETY):
        step = (levels[-1].join(rows, [*keys, "v"]).groupBy(*keys, "s", F.col("u").alias("v")).agg(F.sum("n").alias("n")))
        for old in levels[-2:]:
            step = step.join(old.select(*sv), sv, "left_anti")
        step = cut_lineage(step, "level")
        if step.isEmpty():
            drop_table(step)
            return levels
        levels.append(step)
    raise RuntimeError("breadth-first search did not end")


def edge_betweenness(edges: DataFrame, keys: list[str] = [KEY], sources: DataFrame | None = None) -> DataFrame:
    """``keys + [src, dst, score]`` of the simplified edges; ``sources`` is keys + [v], all by default."""
    simple = cut_lineage(simplify(edges, keys).select(*keys, "src", "dst"), "edges")
    rows = cut_lineage(directed(simple, keys, []), "rows")
    whole = sources is None
    levels = path_levels(rows, rows.select(*keys, "v").distinct() if whole else sources, keys)
    score = simple.withColumn("score", F.lit(0.0))
    depend = None
    used = []
    for near, far in zip(reversed(levels[:-1]), reversed(levels[1:])):
        below = far if depend is None else far.join(depend, [*keys, "s", "v"], "left")
        share = (F.lit(1.0) if depend is None else 1 + F.coalesce("dep", F.lit(0.0))) / F.col("n")
        ends = below.select(*keys, "s", F.col("v").alias("u"), share.alias("share"))
        links = cut_lineage(near.join(rows, [*keys, "v"]).join(ends, [*keys, "s", "u"])
                                .select(*keys, "s", "v", "u", (F.col("n") * F.col("share")).alias("part")), "links")
        used.append(links)
        depend = links.groupBy(*keys, "s", "v").agg(F.sum("part").alias("dep"))
        score = score.unionByName(links.groupBy(*keys, F.least("v", "u").alias("src"), F.greatest("v", "u").alias("dst"))
                                       .agg(F.sum("part").alias("score")))
    out = score.groupBy(*keys, "src", "dst").agg((F.sum("score") / (2 if whole else 1)).alias("score"))
    out = cut_lineage(out, "betweenness")
    for table in [simple, rows, *levels, *used]:
        drop_table(table)
    return out

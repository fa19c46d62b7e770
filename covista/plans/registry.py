"""Registered queries over the driver tables and their DuckDB oracle SQL.

Every query reads the driver tables through the fixture views (FIXTURES.md) and runs over the
whole tables; its oracle is independent SQL over the same tables.  Weights are rounded to six
places in query output only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edges as E
from ..operators import ranks, views
from ..operators.potential import sku_potential
from ..params import Params, fixture_params
from ..runtime import KEY, scratch_path
from ..sources import fixtures as fx
from ..sources import sinks, text
from . import oracle_sql as O
from .pipeline import pair_stage, percentile_sweep, sweep_clusters

Query = Callable[[SparkSession, str], DataFrame]

ONE_CATEGORY = "PROMO"
MIN_PRODUCTS = 300
SWEEP = [10, 25, 50, 75, 85]
ROUND = 6


def P(**kw) -> Params:
    return fixture_params(**kw)


def _inputs(spark: SparkSession, sf: str):
    return fx.pageviews(spark, sf), fx.products(spark, sf)


def _stage(spark: SparkSession, sf: str, p: Params):
    v, pr = _inputs(spark, sf)
    return pair_stage(v, pr, p)


def _q(spark, sf, p):
    v, pr = _inputs(spark, sf)
    return views.qualified_views(v, pr, p)


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.round(c, ROUND).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- Spark side

def q_qualified_views(spark, sf, p=None):
    return _q(spark, sf, p or P())


def q_qualified_views_one_category(spark, sf):
    return _q(spark, sf, P(category=ONE_CATEGORY))


def q_sku_visitor_sets(spark, sf):
    return views.sku_visitors(_q(spark, sf, P()))


def q_sku_views(spark, sf):
    p = P()
    return views.sku_views(_q(spark, sf, p), p.min_view_thresh)


def q_total_visitors(spark, sf):
    return views.total_visitors(_q(spark, sf, P()))


def q_sku_profile(spark, sf):
    return views.sku_profile(_q(spark, sf, P()))


def q_daily_category_visits(spark, sf):
    return views.daily_category_visits(_q(spark, sf, P()))


def q_sku_potential(spark, sf, rule="on_or_after"):
    q = _q(spark, sf, P(visible_rule=rule))
    return sku_potential(views.sku_profile(q), views.daily_category_visits(q), rule)


def q_sku_pairs(spark, sf):
    return _stage(spark, sf, P()).pairs


def q_sku_pairs_ordered(spark, sf):
    return _stage(spark, sf, P(ordered=True)).pairs


def q_pair_profile(spark, sf):
    pp = _stage(spark, sf, P()).pair_profile
    return pp.select(KEY, F.concat_ws("_", F.col("sku1").cast("string"), F.col("sku2").cast("string")).alias("pair_id"),
                     "sku1", "sku2", "ssc1", "ssc2", "maxfvd")


def _joint(mode, rule="on_or_after"):
    def run(spark, sf):
        return _stage(spark, sf, P(joint_mode=mode, visible_rule=rule)).stats.select(KEY, "sku1", "sku2", "pot_joint")
    return run


def q_pair_stats(spark, sf, p=None):
    return _stage(spark, sf, p or P()).stats


def _pmi(norm):
    def run(spark, sf):
        st = _stage(spark, sf, P(norm=norm)).stats
        return _r(E.pmi_weights(st, norm), "weight")
    return run


def q_pmi_threshold(spark, sf):
    p = P()
    w = E.pmi_weights(_stage(spark, sf, p).stats, p.norm)
    return _r(E.pmi_threshold(w, p.pmi_perc), "threshold")


def pmi_edges_cut(spark, sf, p=None):
    p = p or P()
    st = _stage(spark, sf, p).stats
    return _r(E.pmi_edges(st, p.norm, p.pmi_perc, p.method), "weight")


def q_pmi_edges_shifted(spark, sf):
    return pmi_edges_cut(spark, sf, P(method=7))


def q_edge_summary(spark, sf):
    p = P()
    w = E.pmi_weights(_stage(spark, sf, p).stats, p.norm)
    cut = E.cut_edges(w, E.pmi_threshold(w, p.pmi_perc))
    out = E.edge_summary(w, "before").unionByName(E.edge_summary(cut, "after"))
    return _r(out, "mean", "std", "min", "p25", "p50", "p75", "max")


def q_pair_counts(spark, sf):
    p = P()
    st = _stage(spark, sf, p).stats
    w = E.pmi_weights(st, p.norm)
    return E.pair_counts(st, w, E.cut_edges(w, E.pmi_threshold(w, p.pmi_perc)))


def q_eligible_categories(spark, sf):
    return views.eligible_categories(fx.products(spark, sf), MIN_PRODUCTS)


def q_metric_percentiles(spark, sf):
    return ranks.metric_percentiles(fx.product_metrics(spark, sf), ranks.METRIC_COLUMNS)


def q_percentile_sweep(spark, sf):
    v, pr = _inputs(spark, sf)
    return _r(percentile_sweep(v, pr, P(), SWEEP), "weight")


def q_read_delimited_visits(spark, sf):
    """Sku visits as tab-separated text in the shared folder, read back through the text source."""
    path = scratch_path(spark, "visits")
    views.sku_visitors(_q(spark, sf, P())).select(F.format_string(" %d\t%d", "sku", "visitor")).write.text(path)
    return text.read_delimited(spark, path, text.SKU_VISITS)


def q_pair_stats_csv(spark, sf):
    """Pair statistics as CSV with a header, read back typed."""
    path = scratch_path(spark, "stats")
    sinks.write_pair_stats(_stage(spark, sf, P()).stats, path)
    return text.read_pair_stats(spark, path)


QUERIES: dict[str, Query] = {
    "read_delimited_visits": q_read_delimited_visits,
    "pair_stats_csv": q_pair_stats_csv,
    "qualified_views": q_qualified_views,
    "qualified_views_one_category": q_qualified_views_one_category,
    "sku_visitor_sets": q_sku_visitor_sets,
    "sku_views": q_sku_views,
    "total_visitors": q_total_visitors,
    "sku_profile": q_sku_profile,
    "daily_category_visits": q_daily_category_visits,
    "sku_potential": q_sku_potential,
    "sku_potential_after": lambda s, sf: q_sku_potential(s, sf, "after"),
    "sku_pairs": q_sku_pairs,
    "sku_pairs_ordered": q_sku_pairs_ordered,
    "pair_profile": q_pair_profile,
    "joint_potential_daily_min": _joint("daily_min"),
    "joint_potential_row_weighted": _joint("row_weighted", "after"),
    "joint_potential_min_of_sums": _joint("min_of_sums"),
    "pair_stats": q_pair_stats,
    **{f"pmi_norm{n}": _pmi(n) for n in (1, 2, 3, 4, 5)},
    "pmi_threshold": q_pmi_threshold,
    "pmi_edges_cut": pmi_edges_cut,
    "pmi_edges_shifted": q_pmi_edges_shifted,
    "edge_summary": q_edge_summary,
    "pair_counts": q_pair_counts,
    "eligible_categories": q_eligible_categories,
    "metric_percentiles": q_metric_percentiles,
    "percentile_sweep": q_percentile_sweep,
}


# ---------------------------------------------------------------- DuckDB side

def _rs(col: str, expr: str | None = None) -> str:
    return f"round({expr or col}, {ROUND}) AS {col}"


def _oracles() -> dict[str, str]:
    p = P()
    base = lambda pp, sel: "WITH " + O.base_ctes(pp) + "\n" + sel
    full = O.pipeline_sql
    out = {
        "qualified_views": base(p, "SELECT * FROM q"),
        "qualified_views_one_category": base(P(category=ONE_CATEGORY), "SELECT * FROM q"),
        "sku_visitor_sets": base(p, "SELECT * FROM sv"),
        "read_delimited_visits": base(p, "SELECT sku, visitor FROM sv"),
        "pair_stats_csv": full(p, "SELECT sub_category, sku1, sku2, pv1, pv2, com, total, pot1, pot2, pot_joint FROM stats"),
        "sku_views": base(p, "SELECT sub_category, sku, pv FROM kept"),
        "total_visitors": base(p, "SELECT * FROM total"),
        "sku_profile": base(p, "SELECT * FROM prof"),
        "daily_category_visits": base(p, "SELECT * FROM traffic"),
        "sku_potential": base(p, "SELECT * FROM pot"),
        "sku_potential_after": base(P(visible_rule="after"), "SELECT * FROM pot"),
        "sku_pairs": full(p, "SELECT sub_category, sku1, sku2, com FROM pairs"),
        "sku_pairs_ordered": full(P(ordered=True), "SELECT sub_category, sku1, sku2, com FROM pairs"),
        "pair_profile": full(p, "SELECT sub_category, cast(sku1 AS varchar) || '_' || cast(sku2 AS varchar) AS pair_id, "
                                "sku1, sku2, ssc1, ssc2, maxfvd FROM pp"),
        "joint_potential_daily_min": full(p, "SELECT sub_category, sku1, sku2, pot_joint FROM stats"),
        "joint_potential_row_weighted": full(P(joint_mode="row_weighted", visible_rule="after"),
                                             "SELECT sub_category, sku1, sku2, pot_joint FROM stats"),
        "joint_potential_min_of_sums": full(P(joint_mode="min_of_sums"),
                                            "SELECT sub_category, sku1, sku2, pot_joint FROM stats"),
        "pair_stats": full(p, "SELECT sub_category, sku1, sku2, pv1, pv2, com, total, pot1, pot2, pot_joint FROM stats"),
        "pmi_threshold": full(p, f"SELECT sub_category, {_rs('threshold')} FROM thr"),
        "pmi_edges_cut": full(p, f"SELECT sub_category, src, dst, {_rs('weight')} FROM edges"),
        "pmi_edges_shifted": full(P(method=7), f"SELECT sub_category, src, dst, {_rs('weight')} FROM edges"),
        "pair_counts": full(p, """
            SELECT s.sub_category, s.n_pairs, coalesce(w.n_null, 0) AS n_null_weight, coalesce(e.n_edges, 0) AS n_edges
            FROM (SELECT sub_category, count(*) AS n_pairs FROM stats GROUP BY sub_category) s
            LEFT JOIN (SELECT sub_category, count(*) FILTER (WHERE weight IS NULL) AS n_null FROM w GROUP BY sub_category) w
              USING (sub_category)
            LEFT JOIN (SELECT sub_category, count(*) AS n_edges FROM edges GROUP BY sub_category) e USING (sub_category)"""),
        "eligible_categories": f"""
            SELECT SubCategory AS sub_category, count(*) AS n_products FROM ({fx.SQL_PRODUCTS}) t
            WHERE VisibleOnWeb = 1 GROUP BY SubCategory HAVING count(*) > {MIN_PRODUCTS}""",
        "metric_percentiles": ranks.metric_percentiles_sql(fx.sql_product_metrics()),
    }
    for n in (1, 2, 3, 4, 5):
        out[f"pmi_norm{n}"] = full(P(norm=n), f"SELECT sub_category, src, dst, {_rs('weight')} FROM w")
    summ = lambda src, stage: f"""
        SELECT sub_category, '{stage}' AS stage, count(*) AS count, {_rs('mean', 'avg(weight)')},
               {_rs('std', 'stddev_samp(weight)')}, {_rs('min', 'min(weight)')},
               {_rs('p25', 'quantile_cont(weight, 0.25)')}, {_rs('p50', 'quantile_cont(weight, 0.5)')},
               {_rs('p75', 'quantile_cont(weight, 0.75)')}, {_rs('max', 'max(weight)')}
        FROM {src} WHERE weight IS NOT NULL GROUP BY sub_category"""
    out["edge_summary"] = full(p, summ("w", "before") + " UNION ALL " + summ("edges", "after"))
    sweep_thr = " UNION ALL ".join(
        f"SELECT sub_category, cast({float(s)} AS double) AS pmi_perc, quantile_cont(weight, {s / 100.0}) AS threshold "
        f"FROM w WHERE weight > 0 GROUP BY sub_category" for s in SWEEP)
    # the sweep needs one more CTE after ``edges``
    out["percentile_sweep"] = ("WITH " + O.base_ctes(p) + O.pair_ctes(p) + O.edge_ctes(p)
                               + f""",
sw AS ({sweep_thr})
SELECT sw.pmi_perc, w.sub_category, w.src, w.dst, {_rs('weight', 'w.weight')}
FROM w JOIN sw USING (sub_category) WHERE w.weight > sw.threshold""")
    return out


# ---------------------------------------------------------------- graph queries

from ..operators.graph import core as G  # noqa: E402
from ..operators.graph.label_prop import label_propagation, label_propagation_sql  # noqa: E402
from ..operators.graph.moving import (accepted_moves, best_moves, level0, louvain, moves_left,  # noqa: E402
                                      potts_communities, signed_potts_communities)
from ..operators.graph.merges import best_cut_steps, cut_merges, fast_greedy, fast_greedy_merges, first_joins  # noqa: E402
from ..operators.graph.eigen import leading_eigenvector, modularity_product, possible_splits  # noqa: E402
from ..operators.graph.betweenness import edge_betweenness  # noqa: E402
from ..operators.graph import walktrap as W  # noqa: E402
from ..operators import overlap  # noqa: E402
from ..operators.pairs import shared_visitor_counts, sku_pairs_by_prefix  # noqa: E402
from ..functions.quantiles import RANK_ERROR, quantile_sketches, sketched_percentiles  # noqa: E402
from . import qc as QC  # noqa: E402
from ..runtime import cut_lineage  # noqa: E402



def flagship_edges(spark, sf, p=None):
    """The cut edge list (full precision), materialised once per call."""
    p = p or P()
    return cut_lineage(E.pmi_edges(_stage(spark, sf, p).stats, p.norm, p.pmi_perc, p.method))


def _ssc_membership(spark, sf):
    """A fixed partition for exact checks: each SKU in its sub-sub-category."""
    pr = fx.products(spark, sf)
    return pr.select(F.col("SubCategory").alias(KEY), F.col("ProductItemID").alias("sku"),
                     F.col("SubSubCategory").alias("cluster"))


def q_graph_simplify(spark, sf):
    return _r(G.simplify(flagship_edges(spark, sf)), "weight")


def q_modularity(spark, sf):
    e = G.simplify(flagship_edges(spark, sf))
    return _r(G.modularity(e, _ssc_membership(spark, sf)), "modularity")


def q_induced_edges(spark, sf):
    e = flagship_edges(spark, sf)
    return _r(G.induced_edges(G.simplify(e), label_propagation(e)), "weight")


def q_graph_export(spark, sf):
    return _r(G.graph_export(G.simplify(flagship_edges(spark, sf)), _ssc_membership(spark, sf)), "weight", "width")


def _lp(spark, sf):
    return cut_lineage(label_propagation(flagship_edges(spark, sf)))


def q_community_label_propagation(spark, sf):
    return _lp(spark, sf)


def q_cluster_sizes(spark, sf):
    return QC.cluster_sizes(_lp(spark, sf))


def q_cluster_image_table(spark, sf):
    return QC.attach_images(_lp(spark, sf), fx.sku_images(spark, sf))


def q_qc_table(spark, sf):
    return QC.qc_table(_lp(spark, sf), fx.sku_images(spark, sf), "cluster")


def q_lp_modularity(spark, sf):
    e = G.simplify(flagship_edges(spark, sf))
    return _r(G.modularity(e, _lp(spark, sf)), "modularity")


def q_connected_components(spark, sf):
    return G.connected_components(G.simplify(flagship_edges(spark, sf)))


def q_community_louvain(spark, sf):
    return louvain(flagship_edges(spark, sf))


def q_community_potts(spark, sf):
    return potts_communities(flagship_edges(spark, sf), gamma=0.5)


SIGNED = dict(method=7, sg_gamma=0.5, sg_lambda=0.5)


def q_community_signed_potts(spark, sf):
    return signed_potts_communities(flagship_edges(spark, sf, P(**SIGNED)), 0.5, 0.5)


def q_community_fast_greedy(spark, sf):
    return fast_greedy(flagship_edges(spark, sf))


def production() -> Params:
    """The production settings on the fixture's window."""
    return P(method=4, sub_method=8, cl_size_thresh=30, iter_count=5, sg_gamma=0.5, sg_lambda=0.5)


def _clusters(spark, sf):
    p = production()
    e = flagship_edges(spark, sf, p)
    return e, cut_lineage(QC.cluster(e, p), "clusters")


def q_split_large(spark, sf):
    return _clusters(spark, sf)[1]


def q_cluster_production(spark, sf):
    """Production clusters in the review table with their images."""
    return QC.qc_table(_clusters(spark, sf)[1], fx.sku_images(spark, sf))


def _sweep(spark, sf):
    p = production()
    v, pr = _inputs(spark, sf)
    e = cut_lineage(percentile_sweep(v, pr, p, SWEEP, MIN_PRODUCTS), "edges")
    return e, cut_lineage(sweep_clusters(e, p), "clusters")


def q_sweep_sizes(spark, sf):
    """P5: cluster sizes of every percentile and eligible category."""
    m = _sweep(spark, sf)[1]
    return m.groupBy("pmi_perc", KEY, "cluster_id").agg(F.count(F.lit(1)).alias("size"))


def invariants(edges, membership, label, left, keys=[KEY]):
    """Per graph: vertices, vertices without a cluster, clusters that hold parts of two components, and
    improving moves left (``left``: one row each).  A right partition has 0 in the last three."""
    e = G.simplify(edges, keys)
    comp = G.connected_components(e, keys)
    both = comp.join(membership.select(*keys, "sku", F.col(label).alias("c")), [*keys, "sku"], "left")
    torn = (both.filter("c is not null").groupBy(*keys, "c").agg(F.countDistinct("comp").alias("n"))
                .groupBy(*keys).agg(F.sum((F.col("n") > 1).cast("bigint")).alias("torn")))
    out = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("vertices"), F.sum(F.col("c").isNull().cast("bigint")).alias("unlabelled"))
    out = out.join(torn, keys, "left").withColumn("torn", F.coalesce("torn", F.lit(0)))
    moves = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("moves_left"))
    return out.join(moves, keys, "left").withColumn("moves_left", F.coalesce("moves_left", F.lit(0)))


def q_louvain_invariants(spark, sf):
    e = flagship_edges(spark, sf)
    m = cut_lineage(louvain(e))
    return invariants(e, m, "cluster", moves_left(e, m))


def q_potts_invariants(spark, sf):
    e = flagship_edges(spark, sf)
    m = cut_lineage(potts_communities(e, 0.5))
    return invariants(e, m, "cluster", moves_left(e, m, gamma=0.5))


def q_signed_potts_invariants(spark, sf):
    e = flagship_edges(spark, sf, P(**SIGNED))
    m = cut_lineage(signed_potts_communities(e, 0.5, 0.5))
    return invariants(e, m, "cluster", moves_left(e, m, gamma=0.5, lam=0.5, signed=True))


def q_fast_greedy_invariants(spark, sf):
    """No merge of two communities with a gain is left: the same test as for whole-community moves."""
    e = flagship_edges(spark, sf)
    m = cut_lineage(fast_greedy(e))
    return invariants(e, m, "cluster", moves_left(e, m))


def _split_invariants(e, p, keys):
    top = cut_lineage(QC.detect(e, p, keys=keys), "clusters")
    parts = QC.split_parts(e, top, p, keys)
    m = cut_lineage(QC.split_large(e, top, p, keys, parts), "clusters")
    return invariants(e, m, "cluster_id", QC.split_moves_left(e, top, parts, p, keys), keys)


def q_split_invariants(spark, sf):
    p = production()
    return _split_invariants(flagship_edges(spark, sf, p), p, [KEY])


def q_sweep_invariants(spark, sf):
    p = production()
    v, pr = _inputs(spark, sf)
    return _split_invariants(cut_lineage(percentile_sweep(v, pr, p, SWEEP, MIN_PRODUCTS), "edges"), p, ["pmi_perc", KEY])


def _round(gamma, lam, **kw):
    """The first round of local moving from single vertices: every best move, its gain as a share of the
    graph's weight, and whether the round makes it."""
    def run(spark, sf):
        signed = lam > 0
        rows, state, totals = level0(flagship_edges(spark, sf, P(**kw)), [KEY], signed)
        moves = cut_lineage(best_moves(rows, state, totals, [KEY], gamma, lam))
        made = accepted_moves(rows, moves, totals, [KEY], gamma, lam).select(KEY, "v", F.lit(1).alias("made"))
        return moves.join(totals, KEY).join(made, [KEY, "v"], "left").select(
            KEY, F.col("v").alias("sku"), F.col("c").alias("target"), F.coalesce("made", F.lit(0)).alias("made"),
            F.round(F.try_divide("gain", "mp2"), ROUND).alias("gain"))   # NULL in a graph without positive links
    return run


def q_merge_round(spark, sf):
    """The first round of fast greedy: the communities that join a centre, and their exact gains."""
    e = G.with_int_weight(G.simplify(flagship_edges(spark, sf)), [KEY])
    rows = cut_lineage(G.directed(e.filter("w > 0"), [KEY], ["w"]))
    joins, _ = first_joins(rows, [KEY])
    return joins.select(KEY, F.col("v").alias("sku"), F.col("a").alias("centre"), F.round("gain", ROUND).alias("gain"))


def q_cut_merges(spark, sf):
    """The dendrogram of fast greedy cut at its best step is fast greedy's own partition, so every
    SKU is told by both: rows where the two differ would carry two numbers."""
    e = flagship_edges(spark, sf)
    labels, merges = fast_greedy_merges(e)
    merges = cut_lineage(merges, "merges")
    cut = cut_merges(merges, labels.select(KEY, "sku"), best_cut_steps(merges))
    own = G.as_membership(labels).withColumnRenamed("cluster", "own")
    return (cut.join(own, [KEY, "sku"]).groupBy(KEY).agg(F.count(F.lit(1)).alias("vertices"),
            F.sum((F.col("cluster") != F.col("own")).cast("bigint")).alias("differ")))


def q_pair_overlap_arrays(spark, sf):
    """O3: the visitor sets of all pairs that share a visitor, intersected as bitmaps; F6 as in the pairs."""
    p = P()
    st = _stage(spark, sf, p)
    sv = cut_lineage(st.sv.join(st.kept.select(KEY, "sku"), [KEY, "sku"], "left_semi"), "visitors")
    found = overlap.pair_overlap(cut_lineage(overlap.visitor_words(sv), "words"), shared_visitor_counts(sv, p.hot_visitor_skus))
    return found.filter(F.col("com") > F.lit(p.joint_view_thresh))


def q_sku_views_sketched(spark, sf):
    """A2 from daily sketches: per category the SKUs, and those whose estimate is off by more than four
    standard errors and one visitor."""
    q = cut_lineage(_q(spark, sf, P()), "views")
    exact = views.sku_view_counts(views.sku_visitors(q))
    both = exact.join(overlap.sku_views_estimate(overlap.daily_visitor_sketches(q)).withColumnRenamed("pv", "guess"), [KEY, "sku"], "left")
    off = F.abs(F.coalesce("guess", F.lit(0)) - F.col("pv")) > F.lit(4 * overlap.ERROR) * F.col("pv") + 1
    return both.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_skus"), F.sum(off.cast("bigint")).alias("n_off"))


def q_edge_betweenness(spark, sf):
    return _r(edge_betweenness(flagship_edges(spark, sf)), "score")


def q_community_leading_eigenvector(spark, sf):
    return leading_eigenvector(flagship_edges(spark, sf))


def q_leading_eigenvector_invariants(spark, sf):
    """``moves_left`` counts the clusters that their leading eigenvector would still split with a gain."""
    e = flagship_edges(spark, sf)
    m = cut_lineage(leading_eigenvector(e))
    return invariants(e, m, "cluster", possible_splits(e, m))


def q_modularity_product(spark, sf):
    """The modularity matrix of every sub-sub-category's SKUs times a fixed vector."""
    e = flagship_edges(spark, sf)
    mem = _ssc_membership(spark, sf).select(KEY, F.col("sku").alias("v"), F.col("cluster").alias("c"))
    x = mem.select(KEY, "v", (F.col("v") % 7 - 3).cast("double").alias("x"))
    return modularity_product(e, mem, x).select(KEY, F.col("v").alias("sku"), F.round("y", 9).alias("y"))


def q_sku_pairs_prefix(spark, sf):
    """J2 and F6 by prefix filtering."""
    p = P()
    st = _stage(spark, sf, p)
    return sku_pairs_by_prefix(st.sv, st.kept, p.joint_view_thresh, p.hot_visitor_skus)


def q_pmi_threshold_sketched(spark, sf):
    """A9 from mergeable sketches of (category, sub-sub-category of the first SKU): per category the positive
    weights, and whether the threshold's rank among them is off by more than twice the sketch's error."""
    p = P()
    w = E.pmi_weights(_stage(spark, sf, p).stats, p.norm).filter("weight > 0").select(KEY, "src", "weight")
    ssc = fx.products(spark, sf).select(F.col("SubCategory").alias(KEY), F.col("ProductItemID").alias("src"), F.col("SubSubCategory").alias("ssc"))
    w = cut_lineage(w.join(ssc, [KEY, "src"]), "weights")
    perc = p.pmi_perc / 100.0
    t = sketched_percentiles(cut_lineage(quantile_sketches(w, [KEY, "ssc"], "weight"), "sketches"), [KEY], {"t": perc})
    ranks_at = w.join(t, KEY).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_weights"), F.avg((F.col("weight") < F.col("t")).cast("double")).alias("lo"),
        F.avg((F.col("weight") <= F.col("t")).cast("double")).alias("hi"))
    off = (F.col("lo") > F.lit(perc + 2 * RANK_ERROR)) | (F.col("hi") < F.lit(perc - 2 * RANK_ERROR))
    return ranks_at.select(KEY, "n_weights", off.cast("bigint").alias("n_off"))


def q_walk_probabilities(spark, sf):
    return _r(W.walk_probabilities(flagship_edges(spark, sf), 2), "p")


def q_walk_distances(spark, sf):
    """Per category the linked pairs, and those whose projected walk distance is off the exact one, from whole
    rows of ``W.STEPS`` steps, by more than six standard errors."""
    e = flagship_edges(spark, sf)
    g = cut_lineage(G.simplify(e).filter("weight > 0").select(KEY, "src", "dst"), "edges")
    vec = cut_lineage(W.walk_vectors(e), "walks")
    on = lambda t, end: (F.col(f"g.{KEY}") == F.col(f"{t}.{KEY}")) & (F.col(f"g.{end}") == F.col(f"{t}.v"))
    guess = (g.alias("g").join(vec.alias("a"), on("a", "src")).join(vec.alias("b"), on("b", "dst"))
              .select(F.col(f"g.{KEY}").alias(KEY), "src", "dst", F.expr(W.walk_distance(W.DIMS)).alias("guess")))
    p = W.walk_probabilities(e, W.STEPS)
    k = W.strengths(e)
    mean = k.groupBy(KEY).agg(F.avg("k").alias("mean"))
    to = lambda end, sign: (g.join(p.withColumnRenamed("s", end), [KEY, end])
                             .select(KEY, "src", "dst", "v", (F.lit(sign) * F.col("p")).alias("p")))
    apart = to("src", 1.0).unionByName(to("dst", -1.0)).groupBy(KEY, "src", "dst", "v").agg(F.sum("p").alias("d"))
    exact = (apart.join(k, [KEY, "v"]).join(mean, KEY).groupBy(KEY, "src", "dst")
                  .agg(F.sum(F.col("d") * F.col("d") * F.col("mean") / F.col("k")).alias("exact")))
    off = F.abs(F.col("guess") - F.col("exact")) > F.lit(6 * (2.0 / W.DIMS) ** 0.5) * F.col("exact") + F.lit(1e-9)
    return (guess.join(exact, [KEY, "src", "dst"], "left").groupBy(KEY)
                 .agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.coalesce(off, F.lit(True)).cast("bigint")).alias("n_off")))


def q_community_walktrap(spark, sf):
    return W.walktrap(flagship_edges(spark, sf))


def q_walktrap_invariants(spark, sf):
    """``moves_left`` counts the links between communities that the whole dendrogram leaves apart."""
    e = flagship_edges(spark, sf)
    every, merges = W.walktrap_merges(e)
    merges = cut_lineage(merges, "merges")
    return invariants(e, cut_lineage(W.cut_walks(every, merges)), "cluster", W.unmerged(e, merges))


QUERIES.update({
    "sku_pairs_prefix": q_sku_pairs_prefix,
    "pmi_threshold_sketched": q_pmi_threshold_sketched,
    "walk_probabilities": q_walk_probabilities,
    "walk_distances": q_walk_distances,
    "community_walktrap": q_community_walktrap,
    "walktrap_invariants": q_walktrap_invariants,
    "pair_overlap_arrays": q_pair_overlap_arrays,
    "sku_views_sketched": q_sku_views_sketched,
    "edge_betweenness": q_edge_betweenness,
    "community_leading_eigenvector": q_community_leading_eigenvector,
    "leading_eigenvector_invariants": q_leading_eigenvector_invariants,
    "modularity_product": q_modularity_product,
    "graph_simplify": q_graph_simplify,
    "modularity": q_modularity,
    "induced_edges": q_induced_edges,
    "graph_export": q_graph_export,
    "community_label_propagation": q_community_label_propagation,
    "cluster_sizes": q_cluster_sizes,
    "cluster_image_table": q_cluster_image_table,
    "qc_table": q_qc_table,
    "lp_modularity": q_lp_modularity,
    "connected_components": q_connected_components,
    "community_louvain": q_community_louvain,
    "community_potts": q_community_potts,
    "community_signed_potts": q_community_signed_potts,
    "community_fast_greedy": q_community_fast_greedy,
    "split_large": q_split_large,
    "cluster_production": q_cluster_production,
    "sweep_sizes": q_sweep_sizes,
    "louvain_invariants": q_louvain_invariants,
    "potts_invariants": q_potts_invariants,
    "signed_potts_invariants": q_signed_potts_invariants,
    "fast_greedy_invariants": q_fast_greedy_invariants,
    "split_invariants": q_split_invariants,
    "sweep_invariants": q_sweep_invariants,
    "cut_merges": q_cut_merges,
    "louvain_round": _round(1.0, 0.0),
    "potts_round": _round(0.5, 0.0),
    "signed_potts_round": _round(0.5, 0.5, **SIGNED),
    "merge_round": q_merge_round,
})


def _graph_oracles() -> dict[str, str]:
    p = P()
    chain = "WITH " + O.base_ctes(p) + O.pair_ctes(p) + O.edge_ctes(p)
    ge = """,
ge AS (SELECT sub_category, least(src, dst) AS src, greatest(src, dst) AS dst, max(weight) AS weight
       FROM edges WHERE src <> dst GROUP BY sub_category, least(src, dst), greatest(src, dst)),
mem AS (SELECT SubCategory AS sub_category, ProductItemID AS sku, SubSubCategory AS cluster FROM products)"""
    modq = lambda mem: f""",
mqd AS (SELECT sub_category, src AS v, dst AS u, weight FROM ge
       UNION ALL SELECT sub_category, dst AS v, src AS u, weight FROM ge),
mqe AS (SELECT mqd.*, a.cluster AS cv, b.cluster AS cu FROM mqd
         JOIN {mem} a ON a.sub_category = mqd.sub_category AND a.sku = mqd.v
         JOIN {mem} b ON b.sub_category = mqd.sub_category AND b.sku = mqd.u),
mqt AS (SELECT sub_category, sum(CASE WHEN cv = cu THEN weight ELSE 0.0 END) AS w_in, sum(weight) AS m2
        FROM mqe GROUP BY sub_category),
mqk AS (SELECT sub_category, cv, sum(weight) AS k FROM mqe GROUP BY sub_category, cv)
SELECT mqt.sub_category, round(w_in / m2 - sum((k / m2) * (k / m2)), {ROUND}) AS modularity
FROM mqt JOIN mqk USING (sub_category) GROUP BY mqt.sub_category, w_in, m2"""
    lp = label_propagation_sql(chain)
    lp_body = lp[: lp.rindex("SELECT lf.sub_category")]
    lp_mem = lp_body + ",\nlpm AS (SELECT lf.sub_category, lf.sku, ranked.cluster FROM lf JOIN ranked USING (sub_category, label))"
    images = f",\nimg AS ({fx.SQL_SKU_IMAGES})"
    return {
        "graph_simplify": chain + ge + f"\nSELECT sub_category, src, dst, {_rs('weight')} FROM ge",
        "modularity": chain + ge + modq("mem"),
        "induced_edges": lp_mem + ge + f"""
SELECT ge.sub_category, a.cluster, ge.src, ge.dst, {_rs('weight', 'ge.weight')} FROM ge
JOIN lpm a ON a.sub_category = ge.sub_category AND a.sku = ge.src
JOIN lpm b ON b.sub_category = ge.sub_category AND b.sku = ge.dst WHERE a.cluster = b.cluster""",
        "graph_export": chain + ge + f"""
SELECT ge.sub_category, ge.src, ge.dst, {_rs('weight', 'ge.weight')}, {_rs('width', 'ge.weight / 10')},
       a.cluster AS cluster_src, b.cluster AS cluster_dst FROM ge
LEFT JOIN mem a ON a.sub_category = ge.sub_category AND a.sku = ge.src
LEFT JOIN mem b ON b.sub_category = ge.sub_category AND b.sku = ge.dst""",
        "community_label_propagation": lp,
        "cluster_sizes": lp_mem + "\nSELECT sub_category, cluster, count(*) AS size FROM lpm GROUP BY sub_category, cluster",
        "cluster_image_table": lp_mem + images + """
SELECT lpm.sub_category, lpm.sku, lpm.cluster, img.sub_sub_category, img.image_url
FROM lpm LEFT JOIN img ON img.sku = lpm.sku""",
        "qc_table": lp_mem + images + """
SELECT lpm.sub_category, lpm.sku AS SKU, cast(lpm.cluster AS varchar) AS ClusterID, img.sub_sub_category AS SubSubCat,
       img.image_url AS path,
       CASE WHEN img.image_url IS NOT NULL THEN '''<img width=''75'' src="' || img.image_url || '" ></img>''' END AS img
FROM lpm LEFT JOIN img ON img.sku = lpm.sku""",
        "lp_modularity": lp_mem + ge + modq("lpm"),
        "connected_components": chain.replace("WITH ", "WITH RECURSIVE ", 1) + ge + """,
cd AS (SELECT sub_category, src AS v, dst AS u FROM ge UNION ALL SELECT sub_category, dst AS v, src AS u FROM ge),
reach(sub_category, sku, c) AS (
  SELECT DISTINCT sub_category, v, v FROM cd
  UNION
  SELECT r.sub_category, cd.u, r.c FROM reach r JOIN cd ON cd.sub_category = r.sub_category AND cd.v = r.sku)
SELECT sub_category, sku, min(c) AS comp FROM reach GROUP BY sub_category, sku""",
        **{f"{name}_invariants": _invariant_sql(chain, "edges") for name in ("louvain", "potts", "fast_greedy", "leading_eigenvector", "walktrap", "split")},
        "louvain_round": _round_sql(chain, 1.0, 0.0),
        "potts_round": _round_sql(chain, 0.5, 0.0),
        "signed_potts_round": _round_sql("WITH " + O.base_ctes(P(**SIGNED)) + O.pair_ctes(P(**SIGNED)) + O.edge_ctes(P(**SIGNED)), 0.5, 0.5),
        "merge_round": _merge_sql(chain),
        "signed_potts_invariants": _invariant_sql(
            "WITH " + O.base_ctes(P(**SIGNED)) + O.pair_ctes(P(**SIGNED)) + O.edge_ctes(P(**SIGNED)), "edges"),
        "sweep_invariants": _invariant_sql(_oracles()["percentile_sweep"].rpartition("SELECT sw.pmi_perc")[0] + f""",
swe AS (SELECT sw.pmi_perc, w.sub_category, w.src, w.dst FROM w JOIN sw USING (sub_category)
        JOIN (SELECT SubCategory AS sub_category FROM products WHERE VisibleOnWeb = 1 GROUP BY 1 HAVING count(*) > {MIN_PRODUCTS}) el
          USING (sub_category) WHERE w.weight > sw.threshold)""", "swe", "pmi_perc, "),
        "pair_overlap_arrays": chain + f""",
sets AS (SELECT sub_category, sku, list(visitor) AS visitors FROM svk GROUP BY sub_category, sku)
SELECT a.sub_category, a.sku AS sku1, b.sku AS sku2, cast(len(list_intersect(a.visitors, b.visitors)) AS bigint) AS com
FROM sets a JOIN sets b ON a.sub_category = b.sub_category AND a.sku < b.sku
WHERE len(list_intersect(a.visitors, b.visitors)) > {p.joint_view_thresh}""",
        "sku_pairs_prefix": O.pipeline_sql(p, "SELECT sub_category, sku1, sku2, com FROM pairs"),
        "pmi_threshold_sketched": chain + """
SELECT sub_category, count(*) AS n_weights, cast(0 AS bigint) AS n_off FROM w WHERE weight > 0 GROUP BY sub_category""",
        "walk_probabilities": chain + ge + f""",
wd AS (SELECT sub_category, src AS v, dst AS u, weight FROM ge WHERE weight > 0
       UNION ALL SELECT sub_category, dst, src, weight FROM ge WHERE weight > 0),
wk AS (SELECT sub_category, v, sum(weight) AS k, count(*) AS deg FROM wd GROUP BY sub_category, v),
ws AS (SELECT wd.sub_category, v, u, weight / (k * (deg + 1) / deg) AS share FROM wd JOIN wk USING (sub_category, v)
       UNION ALL SELECT sub_category, v, v, 1.0 / (deg + 1) FROM wk)
SELECT a.sub_category, a.v AS s, b.u AS v, {_rs('p', 'sum(a.share * b.share)')}
FROM ws a JOIN ws b ON b.sub_category = a.sub_category AND b.v = a.u GROUP BY a.sub_category, a.v, b.u""",
        "walk_distances": chain + ge + """
SELECT sub_category, count(*) AS n_pairs, cast(0 AS bigint) AS n_off FROM ge WHERE weight > 0 GROUP BY sub_category""",
        "sku_views_sketched": chain + """
SELECT sub_category, count(*) AS n_skus, cast(0 AS bigint) AS n_off FROM allpv GROUP BY sub_category""",
        "edge_betweenness": _betweenness_sql(chain.replace("WITH ", "WITH RECURSIVE ", 1) + ge),
        "modularity_product": chain + ge + """,
sh AS (SELECT sub_category, 2 * sum(weight) AS m2 FROM ge WHERE weight > 0 GROUP BY sub_category),
sd AS (SELECT sub_category, src AS v, dst AS u, weight / m2 AS w FROM ge JOIN sh USING (sub_category) WHERE weight > 0
       UNION ALL SELECT sub_category, dst, src, weight / m2 FROM ge JOIN sh USING (sub_category) WHERE weight > 0),
sk AS (SELECT sd.sub_category, sd.v, mem.cluster, sum(w) AS k, cast(sd.v % 7 - 3 AS double) AS x
       FROM sd JOIN mem ON mem.sub_category = sd.sub_category AND mem.sku = sd.v GROUP BY sd.sub_category, sd.v, mem.cluster),
sc AS (SELECT sub_category, cluster, sum(k) AS kc, sum(k * x) AS kx FROM sk GROUP BY sub_category, cluster),
si AS (SELECT a.sub_category, a.v, sum(sd.w) AS kin, sum(sd.w * b.x) AS wx
       FROM sd JOIN sk a ON a.sub_category = sd.sub_category AND a.v = sd.v
       JOIN sk b ON b.sub_category = sd.sub_category AND b.v = sd.u AND b.cluster = a.cluster GROUP BY a.sub_category, a.v)
SELECT sk.sub_category, sk.v AS sku,
       round(coalesce(wx, 0) - (coalesce(kin, 0) - k * kc) * x - k * kx, 9) AS y
FROM sk JOIN sc USING (sub_category, cluster) LEFT JOIN si ON si.sub_category = sk.sub_category AND si.v = sk.v""",
        "cut_merges": chain + ge + """
SELECT sub_category, count(DISTINCT v) AS vertices, cast(0 AS bigint) AS differ
FROM (SELECT sub_category, src AS v FROM ge UNION ALL SELECT sub_category, dst FROM ge) t GROUP BY sub_category""",
    }


INT_EDGES = """,
le AS MATERIALIZED (SELECT sub_category, least(src, dst) AS src, greatest(src, dst) AS dst, max(weight) AS weight
       FROM edges WHERE src <> dst GROUP BY sub_category, least(src, dst), greatest(src, dst)),
lscale AS (SELECT sub_category, pow(2.0, 60 - length(bin(cast(ceil(max(abs(weight)) * count(*)) AS bigint)))) AS s
       FROM le GROUP BY sub_category),
lw AS (SELECT le.sub_category, src, dst, CASE WHEN weight > 0 THEN greatest(cast(round(weight * s) AS bigint), 1)
              WHEN weight < 0 THEN least(cast(round(weight * s) AS bigint), -1) ELSE 0 END AS w
       FROM le JOIN lscale USING (sub_category)),
gd AS MATERIALIZED (SELECT sub_category, src AS v, dst AS u, greatest(w, 0) AS wp, greatest(-w, 0) AS wn FROM lw
       UNION ALL SELECT sub_category, dst, src, greatest(w, 0), greatest(-w, 0) FROM lw)"""


def _round_sql(chain: str, gamma: float, lam: float) -> str:
    return chain + INT_EDGES + (f""",
k AS MATERIALIZED (SELECT sub_category, v, cast(sum(wp) AS double) AS kp, cast(sum({'wn' if lam > 0 else '0'}) AS double) AS kn
      FROM gd GROUP BY sub_category, v),
tot AS (SELECT sub_category, sum(kp) AS mp2, sum(kn) AS mn2 FROM k GROUP BY sub_category),
opt AS (SELECT gd.sub_category, gd.v, gd.u, a.kp, a.kn,
          (gd.wp - {gamma} * CASE WHEN mp2 > 0 THEN a.kp * b.kp / mp2 ELSE 0.0 END)
          - ({'gd.wn' if lam > 0 else '0'} - {lam} * CASE WHEN mn2 > 0 THEN a.kn * b.kn / mn2 ELSE 0.0 END) AS score
        FROM gd JOIN k a ON a.sub_category = gd.sub_category AND a.v = gd.v
        JOIN k b ON b.sub_category = gd.sub_category AND b.v = gd.u JOIN tot ON tot.sub_category = gd.sub_category),
mv AS MATERIALIZED (SELECT sub_category, v, arg_max(u, (score, -u)) AS c, max(score) AS gain, any_value(kp) AS kp, any_value(kn) AS kn
       FROM opt GROUP BY sub_category, v HAVING max(score) > 1e-10 * (any_value(kp) + any_value(kn))),
wt AS (SELECT DISTINCT a.sub_category, a.v FROM gd JOIN mv a ON a.sub_category = gd.sub_category AND a.v = gd.v
       JOIN mv b ON b.sub_category = gd.sub_category AND b.v = gd.u
       WHERE (b.gain > a.gain OR (b.gain = a.gain AND b.v < a.v))
         AND ((gd.wp > 0 AND (a.c = b.v OR a.v = b.c)) OR ({'gd.wn > 0' if lam > 0 else 'false'} AND a.c = b.c))),
fr AS (SELECT * FROM mv ANTI JOIN wt ON wt.sub_category = mv.sub_category AND wt.v = mv.v),
tc AS (SELECT *, v AS x, false AS toward FROM fr UNION ALL SELECT *, c AS x, true AS toward FROM fr),
rt AS (SELECT *, coalesce(sum(kp) OVER (PARTITION BY sub_category, x, toward ORDER BY gain DESC, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rp,
          coalesce(sum(kn) OVER (PARTITION BY sub_category, x ORDER BY gain DESC, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rn FROM tc),
hd AS (SELECT sub_category, v, any_value(gain) AS gain, any_value(kp) AS kp, any_value(kn) AS kn, sum(rp) AS rp, sum(rn) AS rn
       FROM rt GROUP BY sub_category, v),
ok AS (SELECT hd.sub_category, hd.v FROM hd JOIN tot USING (sub_category)
       WHERE gain > {gamma} * CASE WHEN mp2 > 0 THEN kp * rp / mp2 ELSE 0.0 END + {lam} * CASE WHEN mn2 > 0 THEN kn * rn / mn2 ELSE 0.0 END)
SELECT mv.sub_category, mv.v AS sku, mv.c AS target, CASE WHEN ok.v IS NULL THEN 0 ELSE 1 END AS made,
       round(mv.gain / nullif(mp2, 0), {ROUND}) AS gain
FROM mv JOIN tot USING (sub_category) LEFT JOIN ok ON ok.sub_category = mv.sub_category AND ok.v = mv.v""")


def _merge_sql(chain: str) -> str:
    return chain + INT_EDGES + f""",
k AS MATERIALIZED (SELECT sub_category, v, cast(sum(wp) AS double) AS k FROM gd GROUP BY sub_category, v),
tot AS (SELECT sub_category, sum(k) AS m2 FROM k GROUP BY sub_category),
pr AS MATERIALIZED (SELECT gd.sub_category, gd.v, gd.u, a.k AS kv, m2, gd.wp / m2 - a.k * b.k / (m2 * m2) AS dq
       FROM gd JOIN k a ON a.sub_category = gd.sub_category AND a.v = gd.v
       JOIN k b ON b.sub_category = gd.sub_category AND b.v = gd.u JOIN tot ON tot.sub_category = gd.sub_category WHERE gd.wp > 0),
bs AS MATERIALIZED (SELECT sub_category, v, any_value(kv) AS kv, any_value(m2) AS m2, arg_max(u, (dq, -least(v, u), -greatest(v, u))) AS u,
       max(dq) AS dq FROM pr GROUP BY sub_category, v HAVING max(dq) > 1e-12),
lk AS (SELECT sub_category, u AS v, count(*) AS n FROM bs GROUP BY sub_category, u),
ct AS (SELECT a.sub_category, a.v FROM bs a JOIN bs b ON b.sub_category = a.sub_category AND b.v = a.u AND b.u = a.v
       JOIN lk x ON x.sub_category = a.sub_category AND x.v = a.v JOIN lk y ON y.sub_category = a.sub_category AND y.v = a.u
       WHERE x.n > y.n OR (x.n = y.n AND a.v < a.u)),
cm AS MATERIALIZED (SELECT bs.* FROM bs SEMI JOIN ct ON ct.sub_category = bs.sub_category AND ct.v = bs.u),
wt AS (SELECT DISTINCT a.sub_category, a.v FROM gd JOIN cm a ON a.sub_category = gd.sub_category AND a.v = gd.v
       JOIN cm b ON b.sub_category = gd.sub_category AND b.v = gd.u AND b.u = a.u
       WHERE gd.wp > 0 AND (b.dq > a.dq OR (b.dq = a.dq AND b.v < a.v))),
fr AS (SELECT * FROM cm ANTI JOIN wt ON wt.sub_category = cm.sub_category AND wt.v = cm.v),
l1 AS (SELECT *, kv * coalesce(sum(kv) OVER (PARTITION BY sub_category, u ORDER BY dq DESC, v
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (m2 * m2) AS lost FROM fr),
l2 AS (SELECT sub_category, v, u, dq, kv * coalesce(sum(kv) OVER (PARTITION BY sub_category, u ORDER BY dq DESC, v
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (m2 * m2) AS lost FROM l1 WHERE dq - lost > 1e-12)
SELECT sub_category, v AS sku, u AS centre, round(dq - lost, {ROUND}) AS gain FROM l2"""


def _betweenness_sql(graph: str) -> str:
    """All breadth-first searches level by level (``front``: the last level, kept with the one before), then
    the dependencies level by level back."""
    return graph + f""",
bd AS MATERIALIZED (SELECT sub_category, src AS v, dst AS u FROM ge UNION ALL SELECT sub_category, dst, src FROM ge),
lv(sub_category, s, v, d, n, front) AS (
  SELECT DISTINCT sub_category, v, v, 0, cast(1 AS double), true FROM bd
  UNION ALL
  (WITH c AS (SELECT * FROM lv),
   nx AS (SELECT c.sub_category, c.s, bd.u AS v, min(c.d) + 1 AS d, sum(c.n) AS n FROM c
          JOIN bd ON bd.sub_category = c.sub_category AND bd.v = c.v WHERE c.front GROUP BY c.sub_category, c.s, bd.u),
   fresh AS (SELECT nx.* FROM nx ANTI JOIN c ON c.sub_category = nx.sub_category AND c.s = nx.s AND c.v = nx.v)
   SELECT sub_category, s, v, d, n, true FROM fresh
   UNION ALL SELECT sub_category, s, v, d, n, false FROM c WHERE front AND EXISTS (SELECT 1 FROM fresh))
),
dist AS MATERIALIZED (SELECT sub_category, s, v, d, n FROM lv WHERE front),
arc AS MATERIALIZED (SELECT a.sub_category, a.s, a.v, bd.u, a.d, a.n / b.n AS share FROM dist a
        JOIN bd ON bd.sub_category = a.sub_category AND bd.v = a.v
        JOIN dist b ON b.sub_category = a.sub_category AND b.s = a.s AND b.v = bd.u AND b.d = a.d + 1),
dep(lvl, sub_category, s, v, dep) AS (
  SELECT d, sub_category, s, v, cast(0 AS double) FROM dist WHERE d = (SELECT max(d) FROM dist)
  UNION ALL
  (WITH c AS (SELECT * FROM dep)
   SELECT x.d, x.sub_category, x.s, x.v, coalesce(sum(arc.share * (1 + c.dep)), 0) FROM dist x
   LEFT JOIN arc ON arc.sub_category = x.sub_category AND arc.s = x.s AND arc.v = x.v
   LEFT JOIN c ON c.sub_category = arc.sub_category AND c.s = arc.s AND c.v = arc.u
   WHERE x.d = (SELECT max(lvl) FROM c) - 1 GROUP BY x.d, x.sub_category, x.s, x.v)
)
SELECT arc.sub_category, least(arc.v, arc.u) AS src, greatest(arc.v, arc.u) AS dst,
       round(sum(arc.share * (1 + dep.dep)) / 2, {ROUND}) AS score
FROM arc JOIN dep ON dep.sub_category = arc.sub_category AND dep.s = arc.s AND dep.v = arc.u
GROUP BY arc.sub_category, least(arc.v, arc.u), greatest(arc.v, arc.u)"""


def _invariant_sql(chain: str, edges: str, extra: str = "") -> str:
    """What every right partition of the edge list's graphs gives."""
    return chain + f"""
SELECT {extra}sub_category, count(DISTINCT v) AS vertices, cast(0 AS bigint) AS unlabelled, cast(0 AS bigint) AS torn,
       cast(0 AS bigint) AS moves_left
FROM (SELECT {extra}sub_category, src AS v FROM {edges} WHERE src <> dst
      UNION ALL SELECT {extra}sub_category, dst FROM {edges} WHERE src <> dst) t GROUP BY {extra}sub_category"""


def oracles() -> dict[str, str]:
    out = _oracles()
    out.update(_graph_oracles())
    return out

"""User-level pipelines (P1, P2, P5): views → pair statistics → PMI edges.

All categories run at once.  The page-view log is read twice (the visitor projection and the user/day
projection); everything after that works on aggregates, and only the stages that are asked for run.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_percentiles
from ..operators.edges import pmi_edges, pmi_weights
from ..operators.graph.split import detect, split_large
from ..operators.pairs import sku_pairs
from ..operators.potential import joint_potential_keys, sku_potential
from ..operators.views import (daily_category_visits, eligible_categories, qualified_views, sku_profile_from_products,
                               sku_view_counts, sku_visitors, visible_products)
from ..params import Params
from ..runtime import KEY, cut_lineage

PAIR_STATS_COLUMNS = [KEY, "sku1", "sku2", "pv1", "pv2", "com", "total", "pot1", "pot2", "pot_joint"]


class PairStage:
    """Intermediates of P1, each built and written when first asked for.

    Written tables at stage boundaries keep later plans short and make the stages restartable on
    executor loss; joins carry no broadcast hint, the planner decides by size.
    """

    def __init__(self, views: DataFrame, products: DataFrame, p: Params):
        self.views, self.products, self.p = views, products, p.validate()

    @cached_property
    def q(self) -> DataFrame:
        """Qualified views."""
        return qualified_views(self.views, self.products, self.p)

    @cached_property
    def sv(self) -> DataFrame:
        """Distinct (category, sku, visitor)."""
        return cut_lineage(sku_visitors(self.q), "visitors")

    @cached_property
    def kept(self) -> DataFrame:
        """SKUs with more than ``min_view_thresh`` visitors: category, sku, pv."""
        return cut_lineage(sku_view_counts(self.sv).filter(F.col("pv") > F.lit(self.p.min_view_thresh)), "kept")

    @cached_property
    def total(self) -> DataFrame:
        """category, total."""
        return cut_lineage(self.sv.groupBy(KEY).agg(F.countDistinct("visitor").alias("total")), "total")

    @cached_property
    def traffic(self) -> DataFrame:
        """category, ssc, visit_date, visits."""
        return cut_lineage(daily_category_visits(self.q), "traffic")

    @cached_property
    def products_kept(self) -> DataFrame:
        """Kept SKUs: category, sku, ssc, fvd."""
        return sku_profile_from_products(visible_products(self.products, self.p), self.kept)

    @cached_property
    def profile(self) -> DataFrame:
        """Kept SKUs: category, sku, ssc, fvd, pot, pv."""
        pot = sku_potential(self.products_kept, self.traffic, self.p.visible_rule)
        return cut_lineage(self.products_kept.join(pot, [KEY, "sku"]).join(self.kept, [KEY, "sku"])
                           .select(KEY, "sku", "ssc", "fvd", "pot", "pv"), "profile")

    @cached_property
    def pairs(self) -> DataFrame:
        """category, sku1, sku2, com."""
        return cut_lineage(sku_pairs(self.sv, self.kept, self.p.joint_view_thresh, self.p.ordered,
                                     self.p.hot_visitor_skus), "pairs")

    def _with_sides(self, sides: DataFrame, columns: list[str]) -> DataFrame:
        def side(i):
            return sides.select(KEY, *[F.col(c).alias(f"{c}{i}") for c in columns])
        return (self.pairs.join(side(1), [KEY, "sku1"]).join(side(2), [KEY, "sku2"])
                .withColumn("maxfvd", F.greatest("fvd1", "fvd2"))
                .withColumn("sa", F.least("ssc1", "ssc2"))
                .withColumn("sb", F.greatest("ssc1", "ssc2")))

    @cached_property
    def pair_profile(self) -> DataFrame:
        """Pairs with the sub-sub-categories and first visible dates of both sides."""
        return self._with_sides(self.products_kept, ["sku", "ssc", "fvd"])

    @cached_property
    def stats(self) -> DataFrame:
        """PAIR_STATS_COLUMNS."""
        pp = cut_lineage(self._with_sides(self.profile, ["sku", "ssc", "fvd", "pot", "pv"]), "pairs")
        wanted = pp.select(KEY, "sa", "sb", "maxfvd").distinct()
        joint = cut_lineage(joint_potential_keys(wanted, self.traffic, self.p.joint_mode, self.p.visible_rule), "joint")
        return cut_lineage(pp.join(joint, [KEY, "sa", "sb", "maxfvd"]).join(self.total, KEY).select(*PAIR_STATS_COLUMNS), "stats")


def pair_stage(views: DataFrame, products: DataFrame, p: Params) -> PairStage:
    return PairStage(views, products, p)


def pair_stats(views: DataFrame, products: DataFrame, p: Params) -> DataFrame:
    """``sub_category, sku1, sku2, pv1, pv2, com, total, pot1, pot2, pot_joint``."""
    return pair_stage(views, products, p).stats


def edges_from_stats(stats: DataFrame, p: Params) -> DataFrame:
    """P2 on given pair statistics: ``sub_category, src, dst, weight``."""
    return pmi_edges(stats, p.norm, p.pmi_perc, p.method)


def pmi_edge_list(views: DataFrame, products: DataFrame, p: Params) -> DataFrame:
    """P1 + P2: views to the cut (or, for method 7, shifted) weighted edge list."""
    return edges_from_stats(pair_stats(views, products, p), p)


def percentile_sweep(views: DataFrame, products: DataFrame, p: Params, percentiles: list[float],
                     min_products: int | None = None) -> DataFrame:
    """P5 up to edges: the edge list for every percentile, with the percentile as a key column, of the
    categories with more than ``min_products`` products (default: all).

    Pair statistics and weights are computed once, and all thresholds come from one percentile pass.
    """
    w = pmi_weights(pair_stats(views, products, p), p.norm)
    if min_products is not None:
        w = w.join(eligible_categories(products, min_products).select(KEY), KEY, "left_semi")
    w = cut_lineage(w, "weights")
    names = {f"p{i}": perc / 100.0 for i, perc in enumerate(percentiles)}
    wide = exact_percentiles(w.filter(F.col("weight") > 0), [KEY], "weight", names)
    cases = F.explode(F.array(*[F.struct(F.lit(float(perc)).alias("pmi_perc"), F.col(f"p{i}").alias("threshold"))
                                for i, perc in enumerate(percentiles)])).alias("t")
    j = w.join(wide.select(KEY, cases).select(KEY, "t.pmi_perc", "t.threshold"), KEY)
    if p.method == 7:
        j = j.withColumn("weight", F.col("weight") - F.col("threshold")).filter(F.col("weight").isNotNull())
    else:
        j = j.filter(F.col("weight") > F.col("threshold"))
    return j.select("pmi_perc", KEY, "src", "dst", "weight")


def sweep_clusters(edges: DataFrame, p: Params) -> DataFrame:
    """P5 to the end: clusters of every (percentile, category), split where too large, in the same jobs:
    ``pmi_perc, sub_category, sku, cluster, sub, cluster_id``."""
    keys = ["pmi_perc", KEY]
    edges = cut_lineage(edges, "edges")
    return split_large(edges, cut_lineage(detect(edges, p, keys=keys), "clusters"), p, keys)

"""DuckDB SQL equivalents of the registered queries, over the driver tables.

Written independently of the Spark plans (direct range joins instead of suffix sums, a plain
self join instead of blocked pairs, ``quantile_cont`` instead of bracketed ranks) so that the
comparison checks the Spark design, not a transcription of it.
"""

from __future__ import annotations

from ..params import Params
from ..sources.fixtures import SQL_PAGEVIEWS, SQL_PRODUCTS


def _op(p: Params) -> str:
    return ">=" if p.visible_rule == "on_or_after" else ">"


def base_ctes(p: Params) -> str:
    cat = p.cat_level
    one = f" AND b.{cat} = '{p.category}'" if p.category is not None else ""
    return f"""
products AS ({SQL_PRODUCTS}),
pageviews AS ({SQL_PAGEVIEWS}),
q AS (
  SELECT b.{cat} AS sub_category, a.ProductItemID AS sku, a.VisitorId AS visitor, a.UserId AS user_id,
         cast(a.VisitDate AS date) AS visit_date, b.SubSubCategory AS ssc, b.FirstVisibleDate AS fvd
  FROM pageviews a JOIN products b ON a.ProductItemID = b.ProductItemID
  WHERE a.TimeSpentOnPage > {float(p.time_thresh)}
    AND a.VisitDate > TIMESTAMP '{p.start_date} 00:00:00' AND a.VisitDate < TIMESTAMP '{p.end_date} 00:00:00'
    AND b.VisibleOnWeb = 1 AND b.{cat} IS NOT NULL{one}),
sv AS (SELECT DISTINCT sub_category, sku, visitor FROM q WHERE visitor IS NOT NULL),
allpv AS (SELECT sub_category, sku, count(*) AS pv FROM sv GROUP BY sub_category, sku),
kept AS (SELECT * FROM allpv WHERE pv > {p.min_view_thresh}),
total AS (SELECT sub_category, count(DISTINCT visitor) AS total FROM q GROUP BY sub_category),
traffic AS (SELECT sub_category, ssc, visit_date, count(DISTINCT user_id) AS visits
            FROM q GROUP BY sub_category, ssc, visit_date),
prof AS (SELECT sub_category, sku, max(fvd) AS fvd, min(ssc) AS ssc FROM q GROUP BY sub_category, sku),
pot AS (SELECT pf.sub_category, pf.sku, cast(coalesce(sum(t.visits), 0) AS bigint) AS pot
        FROM prof pf LEFT JOIN traffic t
          ON t.sub_category = pf.sub_category AND t.ssc = pf.ssc AND t.visit_date {_op(p)} pf.fvd
        WHERE pf.fvd IS NOT NULL AND pf.ssc IS NOT NULL
        GROUP BY pf.sub_category, pf.sku)"""


def pair_ctes(p: Params) -> str:
    swapped = ("\n  UNION ALL SELECT sub_category, sku2 AS sku1, sku1 AS sku2, com FROM upairs"
               if p.ordered else "")
    if p.joint_mode == "daily_min":
        pj = "sum(least(jd.c1, jd.c2))"
    elif p.joint_mode == "row_weighted":
        pj = "sum(least(jd.c1, jd.c2) * jd.n_d)"
    else:
        pj = "least(sum(jd.c1), sum(jd.c2))"
    return f""",
svk AS (SELECT sv.* FROM sv JOIN kept USING (sub_category, sku)),
upairs AS (SELECT a.sub_category, a.sku AS sku1, b.sku AS sku2, count(*) AS com
           FROM svk a JOIN svk b ON a.sub_category = b.sub_category AND a.visitor = b.visitor AND a.sku < b.sku
           GROUP BY a.sub_category, a.sku, b.sku HAVING count(*) > {p.joint_view_thresh}),
pairs AS (SELECT * FROM upairs{swapped}),
pp AS (SELECT pr.sub_category, pr.sku1, pr.sku2, pr.com, k1.pv AS pv1, k2.pv AS pv2,
              p1.pot AS pot1, p2.pot AS pot2, f1.ssc AS ssc1, f2.ssc AS ssc2, f1.fvd AS fvd1, f2.fvd AS fvd2,
              least(f1.ssc, f2.ssc) AS sa, greatest(f1.ssc, f2.ssc) AS sb, greatest(f1.fvd, f2.fvd) AS maxfvd
       FROM pairs pr
       JOIN kept k1 ON k1.sub_category = pr.sub_category AND k1.sku = pr.sku1
       JOIN kept k2 ON k2.sub_category = pr.sub_category AND k2.sku = pr.sku2
       JOIN prof f1 ON f1.sub_category = pr.sub_category AND f1.sku = pr.sku1
       JOIN prof f2 ON f2.sub_category = pr.sub_category AND f2.sku = pr.sku2
       JOIN pot p1 ON p1.sub_category = pr.sub_category AND p1.sku = pr.sku1
       JOIN pot p2 ON p2.sub_category = pr.sub_category AND p2.sku = pr.sku2),
jk AS (SELECT DISTINCT sub_category, sa, sb, maxfvd FROM pp),
nd AS (SELECT sub_category, visit_date, count(*) AS n_d FROM traffic GROUP BY sub_category, visit_date),
jd AS (SELECT jk.sub_category, jk.sa, jk.sb, jk.maxfvd, t1.visits AS c1, t2.visits AS c2, nd.n_d
       FROM jk
       JOIN traffic t1 ON t1.sub_category = jk.sub_category AND t1.ssc = jk.sa AND t1.visit_date {_op(p)} jk.maxfvd
       JOIN traffic t2 ON t2.sub_category = jk.sub_category AND t2.ssc = jk.sb AND t2.visit_date = t1.visit_date
       JOIN nd ON nd.sub_category = jk.sub_category AND nd.visit_date = t1.visit_date),
jv AS (SELECT jk.sub_category, jk.sa, jk.sb, jk.maxfvd, cast(coalesce({pj}, 0) AS bigint) AS pot_joint
       FROM jk LEFT JOIN jd ON jd.sub_category = jk.sub_category AND jd.sa = jk.sa AND jd.sb = jk.sb
                          AND jd.maxfvd = jk.maxfvd
       GROUP BY jk.sub_category, jk.sa, jk.sb, jk.maxfvd),
stats AS (SELECT pp.sub_category, pp.sku1, pp.sku2, pp.pv1, pp.pv2, pp.com, total.total, pp.pot1, pp.pot2,
                 jv.pot_joint, pp.ssc1, pp.ssc2, pp.maxfvd
          FROM pp JOIN jv ON jv.sub_category = pp.sub_category AND jv.sa = pp.sa AND jv.sb = pp.sb
                          AND jv.maxfvd = pp.maxfvd
                  JOIN total ON total.sub_category = pp.sub_category)"""


def _log2(x: str) -> str:
    # log base 2 as the original computed it (``math.log(x, 2)`` = ln x / ln 2), which is also
    # how Spark's log2 evaluates; DuckDB's own log2 rounds differently on exact powers of two.
    return f"(ln({x}) / ln(2))"


def weight_sql(norm: int) -> str:
    com, pv1, pv2, total = "cast(com AS double)", "cast(pv1 AS double)", "cast(pv2 AS double)", "cast(total AS double)"
    pj = "cast(pot_joint AS double)"
    if norm == 1:
        lift = f"{com} * pot1 * pot2 / nullif({pv2} * {pv1} * {pj}, 0) + 1e-40"
        pxy = f"{com} / nullif({pj}, 0) + 1e-40"
        return f"{_log2(lift)} / nullif(-{_log2(pxy)}, 0) * 100"
    if norm == 2:
        a = f"{com} * {total} / nullif({pv2} * {pv1}, 0) + 1e-40"
        b = f"{com} / nullif({total}, 0) + 1e-20"
        return f"pow(2.0, {_log2(a)} + {_log2(b)})"
    if norm == 3:
        return _log2(f"{com} * pot1 * pot2 / nullif({pv2} * {pv1} * {pj}, 0) + 1e-40")
    k = norm - 2
    return _log2(f"pow({com}, {k}) * pot1 * pot2 / nullif({pv2} * {pv1} * pow({pj}, {k}), 0) + 1e-40")


def edge_ctes(p: Params) -> str:
    keep = ("w.weight - thr.threshold AS weight FROM w JOIN thr USING (sub_category) "
            "WHERE w.weight - thr.threshold IS NOT NULL") if p.method == 7 else \
           "w.weight FROM w JOIN thr USING (sub_category) WHERE w.weight > thr.threshold"
    return f""",
w AS (SELECT sub_category, sku1 AS src, sku2 AS dst, {weight_sql(p.norm)} AS weight FROM stats),
thr AS (SELECT sub_category, quantile_cont(weight, {p.pmi_perc / 100.0}) AS threshold
        FROM w WHERE weight > 0 GROUP BY sub_category),
edges AS (SELECT w.sub_category, w.src, w.dst, {keep})"""


def pipeline_sql(p: Params, select: str) -> str:
    """All CTEs up to the edges, then ``select``."""
    return "WITH " + base_ctes(p) + pair_ctes(p) + edge_ctes(p) + "\n" + select

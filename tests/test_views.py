import datetime as dt

from pyspark.sql import functions as F

from covista.operators import views as V
from covista.params import Params
from micro import D, T, products, views

P = Params(start_date="2016-01-01", end_date="2016-01-10", time_thresh=10, min_view_thresh=1)


def test_thresholds_and_exclusive_dates(spark):
    pr = products(spark, [(1, "A", "a", D(2015, 1, 1), 1), (2, "A", "a", D(2015, 1, 1), 0)])
    v = views(spark, [
        (1, 100, 100, T(2016, 1, 5), 10.0),      # dwell equal to threshold: out
        (1, 101, 101, T(2016, 1, 5), 10.5),      # in
        (1, 102, 102, T(2016, 1, 1), 30.0),      # start 00:00:00: out
        (1, 103, 103, T(2016, 1, 1, 0, 0, 1), 30.0),  # later the same day: in
        (1, 104, 104, T(2016, 1, 10), 30.0),     # end: out
        (2, 105, 105, T(2016, 1, 5), 30.0),      # product not visible: out
    ])
    q = V.qualified_views(v, pr, P)
    assert sorted(r.visitor for r in q.collect()) == [101, 103]


def test_min_views_strict_and_null_visitor(spark):
    pr = products(spark, [(1, "A", "a", D(2015, 1, 1), 1), (2, "A", "a", D(2015, 1, 1), 1)])
    v = views(spark, [(1, 1, 1, T(2016, 1, 5), 30.0), (1, 2, 2, T(2016, 1, 5), 30.0),
                      (2, 1, 1, T(2016, 1, 5), 30.0), (2, None, 5, T(2016, 1, 5), 30.0)])
    q = V.qualified_views(v, pr, P)
    kept = {r.sku: r.pv for r in V.sku_views(q, 1).collect()}
    assert kept == {1: 2}                       # sku 2 has one non-NULL visitor: not > 1
    assert V.total_visitors(q).collect()[0].total == 2


def test_traffic_counts_users_not_visitors(spark):
    pr = products(spark, [(1, "A", "a", D(2015, 1, 1), 1)])
    v = views(spark, [(1, 1, 7, T(2016, 1, 5, 1), 30.0), (1, 2, 7, T(2016, 1, 5, 2), 30.0)])
    t = V.daily_category_visits(V.qualified_views(v, pr, P)).collect()
    assert [(r.visit_date, r.visits) for r in t] == [(dt.date(2016, 1, 5), 1)]


def test_one_category_filter(spark):
    pr = products(spark, [(1, "A", "a", D(2015, 1, 1), 1), (2, "B", "b", D(2015, 1, 1), 1)])
    v = views(spark, [(1, 1, 1, T(2016, 1, 5), 30.0), (2, 1, 1, T(2016, 1, 5), 30.0)])
    q = V.qualified_views(v, pr, P.with_(category="B"))
    assert [r.sku for r in q.collect()] == [2]


def test_eligible_categories(spark):
    pr = products(spark, [(i, "A" if i < 4 else "B", "a", D(2015, 1, 1), 1) for i in range(6)])
    assert [r.sub_category for r in V.eligible_categories(pr, 2).collect()] == ["A"]


def test_text_sources_and_sinks_round_trip(spark, tmp_path):
    from covista.sources import jdbc, sinks, text
    p = tmp_path / "visits.txt"
    p.write_text(" 1\t10\n2,11 \n\nx,12\n")
    rows = [tuple(r) for r in text.read_delimited(spark, str(p), text.SKU_VISITS).collect()]
    assert rows == [(1, 10), (2, 11), (None, 12)]
    e = spark.createDataFrame([("A", 1, 2, 0.5), ("A", 2, 3, 1.5)], "sub_category string, src long, dst long, weight double")
    sinks.write_edge_list(e, str(tmp_path / "edges"))
    back = text.read_edge_list(spark, str(tmp_path / "edges" / "sub_category=A"))
    assert sorted(tuple(r) for r in back.collect()) == [(1, 2, 0.5), (2, 3, 1.5)]
    o = jdbc.jdbc_options("jdbc:x", "SELECT 1", "id", 0, 100, 4, user="u")
    assert o["dbtable"] == "(SELECT 1) q" and o["numPartitions"] == "4" and o["user"] == "u"

"""Property checks from SURVEY §5: invariants rather than hand-computed answers."""
import random

from covista.operators.graph import core, moving
from covista.operators.potential import joint_potential_keys
from micro import D


def test_labels_never_cross_components(spark):
    rnd = random.Random(5)
    rows = []
    for comp in range(3):                          # three disjoint random graphs in one key
        base = comp * 100
        for _ in range(25):
            a, b = rnd.sample(range(base, base + 12), 2)
            rows.append(("A", a, b, float(rnd.randint(1, 9))))
    e = spark.createDataFrame(rows, "sub_category string, src long, dst long, weight double")
    comm = {r.sku: r.cluster for r in moving.louvain(e).collect()}
    comp = {r.sku: r.comp for r in core.connected_components(e).collect()}
    assert set(comm) == set(comp)
    for a in comm:
        for b in comm:
            if comm[a] == comm[b]:
                assert comp[a] == comp[b]
    q = core.modularity(core.simplify(e), moving.louvain(e)).collect()[0].modularity
    singles = spark.createDataFrame([("A", v, v) for v in comm], "sub_category string, sku long, cluster long")
    assert q > core.modularity(core.simplify(e), singles).collect()[0].modularity


def test_row_weighted_equals_daily_min_with_one_ssc(spark):
    rnd = random.Random(9)
    t = spark.createDataFrame([("A", "x", D(2016, 1, d), rnd.randint(1, 9)) for d in range(1, 20)],
                              "sub_category string, ssc string, visit_date date, visits long")
    keys = spark.createDataFrame([("A", "x", "x", D(2016, 1, d)) for d in (1, 5, 19, 25)],
                                 "sub_category string, sa string, sb string, maxfvd date")
    get = lambda mode: {r.maxfvd: r.pot_joint for r in joint_potential_keys(keys, t, mode).collect()}
    assert get("row_weighted") == get("daily_min") == get("min_of_sums")


def test_filters_and_columns_reach_the_scan(spark):
    from covista.operators.views import qualified_views, sku_visitors
    from covista.plans.registry import P
    from covista.sources import fixtures as fx
    sf = "/root/testdata/sf0.001"
    q = qualified_views(fx.pageviews(spark, sf), fx.products(spark, sf), P())
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        sku_visitors(q).explain("formatted")
    plan = buf.getvalue()
    assert "GreaterThan(l_quantity,10.0)" in plan and "LessThan(l_shipdate" in plan
    assert "l_extendedprice" not in plan              # unused columns are not read

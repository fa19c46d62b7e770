import itertools
import random

from pyspark.sql import functions as F

from covista.operators.pairs import shared_visitor_counts, sku_pairs_by_prefix, split_prefixes
from covista.operators.potential import joint_potential_keys, sku_potential
from micro import D


def brute_pairs(rows):
    by_sku = {}
    for cat, sku, vis in rows:
        by_sku.setdefault((cat, sku), set()).add(vis)
    out = {}
    for (c1, s1), (c2, s2) in itertools.combinations(sorted(by_sku), 2):
        if c1 == c2:
            n = len(by_sku[(c1, s1)] & by_sku[(c2, s2)])
            if n:
                out[(c1, min(s1, s2), max(s1, s2))] = n
    return out


def test_blocked_self_join_equals_brute_force(spark):
    rnd = random.Random(7)
    rows = set()
    for _ in range(600):
        rows.add(("A" if rnd.random() < 0.7 else "B", rnd.randrange(40), rnd.randrange(30)))
    for sku in range(35):                       # one hot visitor with most SKUs
        rows.add(("A", sku, 999))
    df = spark.createDataFrame(sorted(rows), "sub_category string, sku long, visitor long")
    got = {(r.sub_category, r.sku1, r.sku2): r.com for r in shared_visitor_counts(df, hot_visitor_skus=4).collect()}
    assert got == brute_pairs(rows)


def test_prefix_filter_equals_brute_force_and_spares_a_bot(spark):
    rnd = random.Random(9)
    rows = {("A" if rnd.random() < 0.7 else "B", rnd.randrange(40), rnd.randrange(25)) for _ in range(700)}
    rows |= {("A", sku, 999) for sku in range(38)}          # a bot that saw nearly all
    rows |= {("A", 77, v) for v in range(200, 400)}         # a SKU with many visitors of its own
    df = spark.createDataFrame(sorted(rows), "sub_category string, sku long, visitor long")
    kept = df.select("sub_category", "sku").distinct()
    want = brute_pairs(rows)
    for t in (0, 1, 4):
        got = {(r.sub_category, r.sku1, r.sku2): r.com for r in sku_pairs_by_prefix(df, kept, t, hot_visitor_skus=4).collect()}
        assert got == {pair: n for pair, n in want.items() if n > t}
    prefix, busy = split_prefixes(df, 1)
    assert prefix.filter("visitor = 999").isEmpty() and busy.groupBy("sub_category", "sku").count().filter("count > 1").isEmpty()
    assert prefix.count() + busy.count() == len(rows)
    assert sku_pairs_by_prefix(df.limit(0), kept, 1).count() == 0


def _traffic(spark, rows):
    return spark.createDataFrame(rows, "sub_category string, ssc string, visit_date date, visits long")


def test_visible_rule_on_the_first_visible_day(spark):
    t = _traffic(spark, [("A", "x", D(2016, 1, 2), 5), ("A", "x", D(2016, 1, 3), 7)])
    prof = spark.createDataFrame([("A", 1, D(2016, 1, 2), "x")], "sub_category string, sku long, fvd date, ssc string")
    assert sku_potential(prof, t, "on_or_after").collect()[0].pot == 12
    assert sku_potential(prof, t, "after").collect()[0].pot == 7


def test_joint_modes_separate_with_two_ssc_same_day(spark):
    t = _traffic(spark, [("A", "x", D(2016, 1, 2), 5), ("A", "y", D(2016, 1, 2), 3),
                         ("A", "x", D(2016, 1, 3), 1), ("A", "y", D(2016, 1, 3), 4),
                         ("A", "z", D(2016, 1, 3), 9)])
    keys = spark.createDataFrame([("A", "x", "y", D(2016, 1, 1))], "sub_category string, sa string, sb string, maxfvd date")
    val = lambda mode: joint_potential_keys(keys, t, mode).collect()[0].pot_joint
    assert val("daily_min") == 3 + 1               # Σ min
    assert val("row_weighted") == 2 * 3 + 3 * 1    # each day once per ssc row of that day
    assert val("min_of_sums") == min(6, 7)         # min of sums
    assert val("daily_min") <= val("min_of_sums")


def test_suffix_form_equals_direct_form(spark):
    rnd = random.Random(3)
    days = [D(2016, 1, d) for d in range(1, 29)]
    trows = [("A", s, d, rnd.randrange(1, 20)) for s in "xyz" for d in days if rnd.random() < 0.7]
    t = _traffic(spark, trows)
    krows = [("A", a, b, rnd.choice(days)) for a, b in [("x", "y"), ("x", "z"), ("y", "y")] for _ in range(4)]
    keys = spark.createDataFrame(krows, "sub_category string, sa string, sb string, maxfvd date").distinct()
    got = {(r.sa, r.sb, r.maxfvd): r.pot_joint for r in joint_potential_keys(keys, t, "daily_min").collect()}
    cnt = {(s, d): c for _, s, d, c in trows}
    for (a, b, f), v in got.items():
        assert v == sum(min(cnt[(a, d)], cnt[(b, d)]) for d in days if d >= f and (a, d) in cnt and (b, d) in cnt)

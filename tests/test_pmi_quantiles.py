import random

import numpy as np
import pytest

from covista.functions.quantiles import RANK_ERROR, exact_percentiles, quantile_sketches, sketched_percentiles
from covista.operators.edges import pmi_edges, pmi_weights
from covista.params import Params

COLS = "sub_category string, sku1 long, sku2 long, pv1 long, pv2 long, com long, total long, pot1 long, pot2 long, pot_joint long"


def test_undefined_weights_are_null_and_dropped(spark):
    st = spark.createDataFrame([("A", 1, 2, 5, 5, 3, 100, 50, 50, 0),     # pot_joint = 0
                                ("A", 1, 3, 5, 5, 3, 100, 50, 50, 3),     # com = pot_joint
                                ("A", 2, 3, 5, 5, 3, 100, 50, 50, 30)], COLS)
    w = {(r.src, r.dst): r.weight for r in pmi_weights(st, 1).collect()}
    assert w[(1, 2)] is None and w[(1, 3)] is None and w[(2, 3)] > 0
    assert [(r.src, r.dst) for r in pmi_edges(st, 1, 0, 4).collect()] == []   # only one positive: > itself fails


def test_bad_codes_raise():
    with pytest.raises(ValueError):
        Params(norm=6).validate()
    for method in (0, 5, 9):      # known codes without a method are refused before any work
        with pytest.raises(ValueError):
            Params(method=method).validate()
        with pytest.raises(ValueError):
            Params(sub_method=method).validate()


def test_exact_percentiles_match_numpy(spark):
    rnd = random.Random(11)
    rows = [("A", float(rnd.randrange(300))) for _ in range(700)] + [("B", rnd.random()) for _ in range(3)]
    df = spark.createDataFrame(rows, "sub_category string, weight double")
    got = {r.sub_category: (r.a, r.b, r.c) for r in
           exact_percentiles(df, ["sub_category"], "weight", {"a": 0.05, "b": 0.5, "c": 0.85}).collect()}
    for k in "AB":
        vals = [v for c, v in rows if c == k]
        assert got[k] == pytest.approx(tuple(np.percentile(vals, [5, 50, 85])), rel=1e-12)


def test_merged_sketches_are_within_their_rank_error(spark):
    rnd = random.Random(4)
    rows = [(g, rnd.randrange(20), rnd.gauss(0, 1) if g == "A" else float(rnd.randrange(3))) for g in "AB" for _ in range(30_000)]
    rows += [("C", 0, 5.0), ("C", 1, None), ("D", 0, None)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    got = sketched_percentiles(quantile_sketches(df, ["g", "day"], "v"), ["g"], {"p10": 0.1, "p50": 0.5, "p99": 0.99})
    got = {r.g: r for r in got.collect()}
    assert set(got) == {"A", "B", "C"} and got["C"].p50 == 5.0
    for g in "AB":
        values = [v for h, _, v in rows if h == g]
        for name, p in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
            x = got[g][name]
            below, upto = (sum(f) / len(values) for f in ([v < x for v in values], [v <= x for v in values]))
            assert below - 2 * RANK_ERROR <= p <= upto + 2 * RANK_ERROR

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from covista.llm import queries
from covista.llm.topk import best, exact_topk


def brute(rows, k, every):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and not any(x is None or not math.isfinite(x) for x in v)]
    out = []
    for at, (q, w) in enumerate(ok):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(w, x)), c) for j, (c, x) in enumerate(ok) if j != at)
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def test_query_matches_oracle(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(duckdb.sql(queries.ORACLE_SQL["op8_exact_topk"]).fetchall())
    got = queries.op8_exact_topk(spark, sf)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect())) == want and want


ODD = ([(i, [float((i * 7 + j) % 5 - 2) for j in range(3)]) for i in range(40)]       # many ties
       + [(40, None), (41, [1.0, None, 2.0]), (42, [float("nan"), 1.0, 1.0]), (43, [float("inf"), 0.0, 0.0]),
          (None, [9.0, 9.0, 9.0]), (44, []), (50, [3.0]), (45, [0.0, 0.0, 0.0]), (10, [0.5, 0.5, 0.5]), (10, [0.5, 0.5, 0.5]), (11, [7.0, 7.0, 7.0]),
          (46, [1e6, -1e6, 1.0, 4.0])])


def test_odd_rows_and_blocks(spark):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in ODD], "vec_id bigint, embedding array<double>, block string, score int")
    for sizes in ((4096, 512), (5, 2)):
        got = exact_topk(df, F.col("vec_id") % 10 == 0, 5, block_rows=sizes[0], query_rows=sizes[1])
        assert sorted(map(tuple, got.collect())) == brute(ODD, 5, 10)


def test_rows_that_repeat_an_id_are_all_candidates(spark):
    rows = [(0, [1.0, 1.0]), (1, [5.0, 1.0]), (1, [9.0, 1.0]), (2, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(map(tuple, exact_topk(df, F.col("vec_id") == 0).collect()))
    assert got == [(0, 1, 1, 655360), (0, 2, 1, 393216), (0, 3, 2, 262144)]


def test_fewer_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    assert list(map(tuple, exact_topk(df, F.col("vec_id") == 0).collect())) == [(0, 1, 1, 256 * 512)]
    assert exact_topk(df.limit(0), F.col("vec_id") == 0).collect() == []


def test_selection_breaks_ties_by_place():
    assert sorted(best(np.array([5, 9, 5, 5, 1]), 3)) == [0, 1, 2]

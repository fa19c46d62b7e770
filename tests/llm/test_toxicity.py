import zlib

import numpy as np
from pyspark.sql import functions as F

from covista.llm import queries
from covista.llm.ftrl import sigmoid
from covista.llm.toxicity import SIZE, WORD, Scorer, chain_features, features, predict, toxicity, train_chain, training_rows

SF = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.op3_toxic_documents(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/labels.parquet").collect()
    kept = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    toxic, clean = [r for r in kept if r.toxic], [r for r in kept if not r.toxic]
    assert len(toxic) > 20 and np.mean([r.doc_id in got for r in toxic]) >= 0.88
    assert np.mean([r.doc_id in got for r in clean]) <= 0.02


def test_sparse_scorer_equals_dense_model():
    rng = np.random.default_rng(1)
    w = np.where(rng.random(SIZE) < 0.3, rng.normal(size=SIZE), 0)
    text, before = "The cat sat on the the mat, Cats", [0.2, 0.9]
    at, x = chain_features(before)
    want = sigmoid(w[features(text)].sum() + w[at] @ x)
    scorer = Scorer(np.flatnonzero(w), w[np.flatnonzero(w)])
    for _ in range(2):
        assert np.isclose(scorer.probability(set(WORD.findall(text.lower())), before), want)


def rows(n=240):
    """The second category follows the first category, not the text."""
    return [(i, f"w{chr(97 + i % 7)}x filler {'badword' if i % 2 else 'goodword'} text", "k") for i in range(n)]


def test_chain_feeds_earlier_probabilities(spark):
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string, p_toxic string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("a"), (1 - F.col("doc_id") % 2).cast("int").alias("b"))
    cats = {"a": F.col("a"), "b": F.col("b")}
    chain = train_chain(docs, labels, cats, rate={"alpha": 1.0, "l1": 0.5})
    assert len(chain) == 2 and 1 in chain[1][0]          # bucket 1: the log-odds of the first category
    got = predict(docs.select("doc_id", "text"), chain, ["a", "b"]).collect()
    assert all((r.a > 0.5) == (r.doc_id % 2 == 1) and (r.b > 0.5) == (r.doc_id % 2 == 0) for r in got)
    table = training_rows(docs, labels, cats, 10_000, 3, "doc_id", "text").collect()
    assert {r.doc_id for r in table} == {i for i, *_ in rows() if zlib.crc32(str(i).encode()) % 5}
    assert {r.fold for r in table} == {0, 1, 2}


def test_odd_rows(spark):
    odd = [(1, "stupid text", "a"), (2, None, "b"), (3, "", None), (None, "x", "c"), (2, "twice", "b"), (2, "twice", "b"),
           (7, "long words " * 50_000, "d")]
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in odd], "doc_id bigint, text string, task string, fold int")
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, None), (2, 0, 0), (3, 5, 0), (None, 1, 1), (9, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    got = toxicity(docs, labels)
    assert got.columns == ["doc_id", "p_junk", "p_toxic"] and got.count() == len(odd)
    assert {(r.p_junk, r.p_toxic) for r in toxicity(docs, labels.limit(0)).collect()} == {(0.5, 0.5)}
    assert toxicity(docs.limit(0), labels).collect() == []

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from covista.llm import queries
from covista.llm.ftrl import Ftrl, sigmoid
from covista.llm.quality import BIAS, features, keep_good, quality, train, training_rows

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op4_quality(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    labels = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in got]
    kept = [(g, q) for g, q in labels if g.held_out]
    assert len(kept) > 30 and np.mean([g.predicted == q for g, q in kept]) >= 0.98
    assert all(g.predicted for g, q in kept if q == 1)


def test_training_uses_no_held_out_row(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    ids = [r.doc_id for r in training_rows(docs, labels, "quality", 100_000).collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    assert 0 < training_rows(docs, labels, "quality", 100).count() < 200


def test_ftrl_is_the_published_update():
    at, x = np.array([1, 3]), np.array([1.0, 2.0])
    model = Ftrl(5, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z = n = w = np.zeros(2)
    for label in (1, 0, 1):
        w = np.where(abs(z) <= 0.1, 0, -(z - np.sign(z) * 0.1) / ((1 + np.sqrt(n)) / 0.5 + 0.2))
        g = (sigmoid(w @ x) - label) * x
        z, n = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / 0.5 * w, n + g * g
        model.learn(at, x, label)
    assert np.allclose(model.z[at], z) and np.allclose(model.n[at], n) and not model.z[[0, 2, 4]].any()


def test_features_count_ngrams():
    at, x = features("a b a")
    assert len(at) == 6 and x[at == BIAS] == [1.0]        # a, b, "a b", "b a", "a b a" and the bias
    assert sorted(x)[:-2] == pytest.approx([1 / 6 ** 0.5] * 4)
    assert features("")[0].tolist() == [BIAS]


ODD = [(1, "good text here", "x"), (2, "!! !! BAD !!", "y"), (3, None, "z"), (4, "", None), (None, "good", "n"),
       (2, "!! !! BAD !!", "y"), (6, "long words " * 50_000, "w")]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(d, t, 0.1, s) for d, t, s in ODD], "doc_id bigint, text string, score double, label string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (9, 1), (4, 7)], "doc_id bigint, quality int")
    got = quality(docs, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert sorted((r.doc_id, r.label) for r in training_rows(docs, labels, "quality", 100).collect()) == [
        (i, y) for i, y in ((1, 1), (2, 0), (2, 0)) if zlib.crc32(str(i).encode()) % 5]
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.score for r in quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality(docs.limit(0), labels).collect() == []
    assert not train(docs.limit(0), labels).any()

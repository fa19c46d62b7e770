import numpy as np

import corpus_pipeline
from covista.llm import quality
from covista.llm.ftrl import sigmoid
from covista.llm.piece_codec import Codec
from covista.llm.secret_scan import base_spans
from test_simhash import brute_fp, brute_roots

SF = "/root/testdata/sf0.01"


def stage_by_stage(spark, sf, tmp_path):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        out.append(docs)
    return out


def test_stages_against_brute_force(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    good, single, clean, safe, coded = stage_by_stage(spark, SF, tmp_path)
    for df in (good, single, clean, safe):
        assert df.schema.simpleString() == source.schema.simpleString()
    # quality: the model's rejections go, nothing else
    model = quality.train(source, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: r for r in source.collect()}
    keep = set()
    for d, r in rows.items():
        at, x = quality.features(r.text or "")
        if sigmoid(model[at] @ x) >= quality.CUT:
            keep.add(d)
    assert {r.doc_id for r in good.collect()} == keep
    # near duplicates: the smallest id of each component
    ids = sorted(keep)
    roots = brute_roots([brute_fp(rows[d].text) for d in ids])
    first = {ids[r] for r in roots}
    assert {r.doc_id for r in single.collect()} == first < keep
    # benchmark: documents with an item's whole text go, and hardly any other
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for d in first if any(i in rows[d].text for i in items)}
    left = {r.doc_id for r in clean.collect()}
    assert leaked and not left & leaked and len(first - leaked - left) <= max(1, 0.05 * len(leaked))
    # secrets: every document stays, its base spans are gone, texts without any are untouched
    texts = {r.doc_id: r for r in safe.collect()}
    assert set(texts) == left and all(r.n_chars == len(r.text) for r in texts.values())
    assert any(base_spans(rows[d].text) for d in left)
    for d in left:
        assert not [s for s in base_spans(texts[d].text) if s[1] > 0]
        if len(rows[d].text) == len(texts[d].text):
            assert rows[d].text == texts[d].text
    # pieces: ids decode to the texts
    codec = Codec(corpus_pipeline.MODEL)
    got = coded.collect()
    assert {r.doc_id: codec.decode(r.ids) for r in got} == {d: r.text for d, r in texts.items()}
    assert all(r.n_ids == len(r.ids) for r in got)


def test_run_and_odd_tables(spark, sf_with):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "a", 0), (2, "plain words here", "en", "a", 16),
                                  (2, "plain words here", "en", "a", 16), (3, "password = abcdef99 stays out", "de", "b", 29)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.run(spark, sf_with(documents=docs)).collect()
    codec = Codec(corpus_pipeline.MODEL)
    assert sorted(codec.decode(r.ids) for r in got) == ["", "[secret] stays out", "plain words here"]
    assert [r.n_chars for r in got if r.doc_id == 3] == [18]


def test_empty_table(spark, sf_with):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert corpus_pipeline.run(spark, sf_with(documents=docs)).collect() == []

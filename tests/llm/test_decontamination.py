import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from covista.llm import queries
from covista.llm.decontamination import (ANSWER, STRIDE, STRONG, WEAK, answer_of, contaminated, gram_product, lcs, randomised_svd,
                                         remove_contaminated, words_of)

SF = "/root/testdata/sf0.01"


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=70), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=90))
def test_lcs(a, b):
    assert lcs(a, b) == slow_lcs(a, b)


def sparse(spark, dense):
    rows = [([int(i) for i in np.flatnonzero(r)], [float(x) for x in r[r != 0]]) for r in dense]
    return spark.createDataFrame(rows, "terms array<int>, weights array<double>").repartition(3)


def test_svd_is_numpys(spark):
    rng = np.random.default_rng(0)
    dense = np.where(rng.random((60, 1500)) < 0.03, rng.random((60, 1500)), 0)
    q = rng.normal(size=(1500, 4))
    assert np.allclose(gram_product(sparse(spark, dense), q), dense.T @ (dense @ q))
    low = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 200))
    values, vectors = randomised_svd(sparse(spark, low), 200, dims=5)
    _, s, vt = np.linalg.svd(low, full_matrices=False)
    assert np.allclose(values, s[:5]) and np.allclose(np.abs(vectors.T @ vt[:5].T), np.eye(5), atol=1e-6)


def brute(docs, items):
    """Every item against every stretch of words twice its length."""
    out = set()
    for d, text in docs:
        words = words_of(text or "")
        for i, item_text in items:
            item, answer = words_of(item_text or ""), answer_of(item_text or "")
            if not item:
                continue
            for s in range(0, max(1, len(words) - len(item)), max(1, len(item) // 2)):
                near = words[s:s + 2 * len(item)]
                share = slow_lcs(item, near) / len(item)
                if share >= STRONG or share >= WEAK and answer and slow_lcs(answer, near) >= ANSWER * len(answer):
                    out.add((d, i))
                    break
    return out


def test_query_finds_exact_passages_and_little_else(spark, sf="/root/testdata/sf0.1"):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    exact = {(d, i) for d, t in docs for i, x in items if x in (t or "")}
    got = {(r.doc_id, r.item_id) for r in queries.op2_contaminated(spark, sf).collect()}
    assert len(exact) > 50 and exact <= got
    assert len(got - exact) <= 0.05 * len(exact)


def test_recall_against_brute_force_on_paraphrases(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=rng.choice([2, 2, 3, 6, 7])))
    common = [word() for _ in range(40)]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n)]
    items = [(i, " ".join(prose(rng.randint(15, 60))) + ". " + " ".join(prose(6))) for i in range(30)]
    docs = []
    for d in range(60):
        text = prose(rng.randint(30, 400))
        if d % 3:
            part = items[d % 30][1].split()
            part = [w if rng.random() > 0.08 else rng.choice(["", "very " + w, word()]) for w in part]   # edits
            at = rng.randrange(len(text))
            text[at:at] = part
        docs.append((d, " ".join(text)))
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"),
                                                       spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = brute(docs, items)
    assert len(want) >= 35 and len(got & want) >= 0.9 * len(want)
    assert {d for d, _ in got} <= {d for d, _ in docs if d % 3}


ITEM = "The quick brown fox jumps over the lazy dog while seventeen purple elephants watch quietly. Nobody expected that answer."
DOCS = [(1, f"intro words {ITEM} and an end"), (2, None), (3, ""), (None, ITEM.upper()), (4, "other text entirely " * 3),
        (4, "other text entirely " * 3), (5, "filler of words " * 40_000 + ITEM), (6, ITEM.replace("quick ", "").replace("purple", "green"))]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(d, t, 5, "x") for d, t in DOCS], "doc_id bigint, text string, item_id int, answer string")
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, ""), (10, ITEM), (None, "Nothing like this one anywhere here at all.")],
                                  "item_id bigint, text string")
    for block in (1 << 20, 150):      # one block of items, and several
        got = contaminated(docs, items, block_bytes=block).collect()
        assert sorted((str(r.doc_id), r.item_id) for r in got) == [(d, 10) for d in ("1", "1", "5", "5", "6", "6", "None", "None")]
    left = remove_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 4]
    assert contaminated(docs, items.limit(0)).collect() == [] and contaminated(docs.limit(0), items).collect() == []
    given = items.limit(1).withColumn("key", items.text.substr(1, 9))
    assert all(r.answer == (r.doc_id != 6) for r in contaminated(docs, given, answer_col="key").collect())
    assert STRIDE == 16


def words_like_text(seed):
    """A vocabulary with frequent and rare words, and prose of it."""
    rng = random.Random(seed)
    vocab = sorted({"".join(rng.choices("abcdefghijkl", k=rng.randint(2, 8))) for _ in range(12_000)})
    rng.shuffle(vocab)
    share = list(np.cumsum([1 / (i + 3) for i in range(len(vocab))]))
    return rng, lambda n: rng.choices(vocab, cum_weights=share, k=n)


def lost(spark, items, copies, prose, rng):
    """The planted pairs that are not found, of one item a document between other words."""
    docs = [(d, " ".join(prose(rng.randint(20, 60)) + part + prose(rng.randint(20, 60)))) for d, (_, part) in enumerate(copies)]
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4),
                                                       spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    return sorted({(d, i) for d, (i, _) in enumerate(copies)} - got)


def test_exact_copies_with_more_items_than_directions(spark):
    rng, prose = words_like_text(8)
    items = [(i, " ".join(prose(rng.randint(16, 59)))) for i in range(1200)]
    assert len(lost(spark, items, [(i, x.split()) for i, x in items], prose, rng)) == 0


def test_edits_up_to_the_limits_of_the_subsequence(spark):
    """Near the limits of ``strong`` and of ``weak``, at every offset to the blocks."""
    rng, prose = words_like_text(9)
    items = [(i, " ".join(prose(rng.randint(20, 53))) + ". " + " ".join(prose(6))) for i in range(400)]
    copies = []
    for i, text in items:
        for least, free in ((STRONG, 0), (WEAK, 6)):         # the answer stays whole in the second
            part = text.split()
            for at in rng.sample(range(len(part) - free), int((1 - least) * len(part))):
                part[at] = "edited" + "".join(rng.choices("mnopqr", k=4))
            assert lcs(words_of(text), words_of(" ".join(part))) >= least * len(part)
            copies.append((i, part))
    assert len(lost(spark, items, copies, prose, rng)) <= 0.01 * len(copies)


def test_exact_copies_of_long_items(spark):
    rng, prose = words_like_text(10)
    items = [(i, " ".join(prose(rng.choice([30, 130, 400, 900, 2500])))) for i in range(60)]
    assert len(lost(spark, items, [(i, x.split()) for i, x in items], prose, rng)) == 0

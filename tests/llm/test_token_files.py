import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from covista.llm import queries, simple8b
from covista.llm.token_files import read_token_files, write_token_files

PATH = queries._public("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, (1 << 64) - 1)), max_size=3000))
def test_blocks_round_trip(ids):
    x = np.array(ids, np.uint64)
    block = simple8b.encode(x)
    assert (simple8b.decode(block) == x).all() and len(simple8b.decode(block)) == len(x)
    for s in range(-(-len(x) // simple8b.SUB)):
        assert (simple8b.decode_sub(block, s) == x[s * simple8b.SUB:(s + 1) * simple8b.SUB]).all()


def brute(rows):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc, start, len(ids), ids))
        start += len(ids)
    return out


def test_query_matches_the_library(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op9_token_files(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted((d, s, n, zlib.crc32(np.array(i, "<u4").tobytes())) for d, s, n, i in brute(rows))


LETTERS = "aZéÄßİıſKΣσςжЖ中ấ"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(LETTERS + "'’.,|!*$#%&-5½\n\t \u0301\u00a0"), max_size=25), min_size=1, max_size=40))
def test_words_give_the_library_ids(texts):
    from covista.llm.token_files import word_ids
    coder = word_ids(PATH)
    want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(texts)] == want


def test_dotted_capital_before_punctuation():
    from covista.llm.token_files import word_ids
    coder = word_ids(PATH)
    for text in ("İ,", "SALİ. a", "İİ!!", "aİ% İ"):
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_odd_rows(spark, tmp_path):
    rows = [(3, None), (1, "It's 'THE ΣΑΣ' café don't \x1cx ½ <|endoftext|> a.b,,"), (None, "x"), (1, "again."), (1, "again."),
            (2, ""), (9, "Long words " * 30_000), (8, "é ́   İ\nK's\t!!")]
    df = spark.createDataFrame([(d, t, "s", 0) for d, t in rows], "doc_id bigint, text string, shard string, lens int")
    write_token_files(df, str(tmp_path / "t"), PATH, block_ids=50)
    got = [tuple(r) for r in read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()]
    assert got == [(d, s, n, i) for d, s, n, i in brute(rows)]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    write_token_files(df, str(tmp_path / "t"), PATH)
    assert read_token_files(spark, str(tmp_path / "t"), digest=True).collect() == []


def test_words_met_again_stay_when_the_memory_is_full(monkeypatch):
    import random

    import public_tokenizers

    from covista.llm import token_files
    monkeypatch.setattr(token_files, "CACHE_WORDS", 80)
    coder = token_files.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    encoded, learn = [], coder._plain
    monkeypatch.setattr(coder, "_plain", lambda words: (encoded.extend(words), learn(words)))
    rng, most = random.Random(1), 0
    for _ in range(60):
        rare = ["".join(rng.choices("abcdeéßñ", k=9)) + rng.choice(["", ",", "###", ".%%%", "*x*", "'s.", "²,", "\n\u0301."]) for _ in range(10)]
        text = " Start common,%%% words " + " ".join(rare) + " Common stay. common"
        assert coder.encode([text]) == [np.array(coder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
        most = max(most, len(coder.known), len(coder.older))
    assert encoded.count("common") == encoded.count("words") == 1
    assert most < 80


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(LETTERS + "×÷'’.,|!*$#%&<>5½\n\t ́̇ "), max_size=25)), min_size=1, max_size=12))
def test_columns_give_the_library_ids(texts):
    import pyarrow as pa

    from covista.llm.token_files import word_ids
    coder = word_ids(PATH)
    texts = texts + ["a.<|endoftext|> b<|STARTOFTEXT|>", None, ""]
    want = [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for column in (pa.array(texts, pa.string()), pa.array(["x. y", *texts], pa.string())[1:]):
        assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(column)] == want


def test_a_word_is_looked_up_once_a_batch():
    from covista.llm.token_files import WordIds

    class Counted(dict):
        lookups = 0

        def get(self, *a):
            self.lookups += 1
            return super().get(*a)

    coder = WordIds(PATH)
    texts = ["One word, another word.\nAnother one! " * 50] * 40
    want = coder.tokenizer.encode(texts[0], add_special_tokens=False).ids
    coder.known = Counted(coder.known)
    for _ in range(2):
        assert all(np.frombuffer(b, "<u4").tolist() == want for b in coder.encode(texts))
    assert coder.known.lookups < 100


def test_a_block_takes_one_step_for_all_sub_blocks():
    rng = np.random.default_rng(3)
    for n in (1, simple8b.SUB - 1, simple8b.SUB, simple8b.SUB + 1, 20 * simple8b.SUB + 7):
        x = rng.choice(np.array([0, 1, 9, 700, 40_000, 1 << 25, 1 << 59, (1 << 64) - 1], np.uint64), n)
        block = simple8b.encode(x)
        assert (simple8b.decode(block) == x).all()
        assert (simple8b.decode_sub(block, (n - 1) // simple8b.SUB) == x[(n - 1) // simple8b.SUB * simple8b.SUB:]).all()

import random
import zlib

import numpy as np
import pytest

from covista.llm import queries
from covista.llm.piece_codec import MARK, Codec, decode, encode

PATH = queries._public("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return Codec(PATH)


def table(path):
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return {m.id_to_piece(i): (i, m.get_score(i)) for i in range(m.get_piece_size())
            if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}


def brute(line, pieces, below, spell):
    """Plain dynamic program over all substrings of the whole normalised text."""
    best, back, longest = [0.0], [None], max(map(len, pieces))
    for end in range(1, len(line) + 1):
        options = [(best[end - k] + pieces[line[end - k:end]][1], k, [pieces[line[end - k:end]][0]])
                   for k in range(1, min(longest, end) + 1) if line[end - k:end] in pieces]
        if line[end - 1] not in pieces:
            options.append((best[end - 1] + below, 1, spell(line[end - 1])))
        value, k, ids = max(options, key=lambda o: o[:2])
        best.append(value)
        back.append((k, ids))
    out, at = [], len(line)
    while at:
        k, ids = back[at]
        out, at = ids + out, at - k
    return out


TEXTS = ["Hello  world\n\tfoo ① ﬁ é ", "", " ", "   a", "\n\n", "a\n b\n", f"x{MARK}y {MARK}", "the then there's 12345",
         "\U0001f600 你好", "a" * 60, "é"]


def test_best_segmentation(codec, spark, sf):
    pieces = table(PATH)
    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(25).collect()]
    for text in TEXTS + [d[:1500] for d in docs]:
        line = MARK + text.replace(" ", MARK) if text else ""
        want = brute(line, pieces, codec.below, lambda c: [codec.bytes_id[b] for b in c.encode()]) if line else []
        for _ in range(2):
            assert np.frombuffer(codec.encode(text), "<u4").tolist() == want
        assert codec.decode(want) == text.replace(MARK, " ")


def test_equals_the_library_on_a_unigram_style_vocabulary(codec):
    """Small made vocabularies whose pieces cross words are segmented whole."""
    import ahocorasick
    rng, own = random.Random(2), Codec(PATH)
    for _ in range(30):
        pieces = {"".join(rng.choices("ab" + MARK, k=rng.randint(1, 4))): None for _ in range(12)}
        pieces = {p: (i, -float(rng.randint(0, 6))) for i, p in enumerate(pieces)}
        own.build(ahocorasick, pieces)
        own.known = {"": b""}
        for _ in range(10):
            text = "".join(rng.choices("ab c", k=rng.randint(1, 20)))
            got = np.frombuffer(own.encode(text), "<u4").tolist()
            assert got == brute(MARK + text.replace(" ", MARK), pieces, own.below, lambda c: [own.bytes_id[b] for b in c.encode()])


def test_library_decodes_our_ids(codec):
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in TEXTS:
        assert m.decode(np.frombuffer(codec.encode(text), "<u4").tolist()) == text.replace(MARK, " ")


def test_query_and_round_trip(spark, sf, codec):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op10_sentencepiece(spark, sf).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert all(r.ids_crc32 == zlib.crc32(codec.encode(rows[r.doc_id])) for r in got)


def test_odd_rows(spark):
    odd = [(1, None), (2, ""), (None, "a b"), (2, "x"), (2, "x"), (5, "Long text. " * 40_000)]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in odd], "doc_id bigint, text string, piece string, n_ids int")
    coded = encode(df, PATH)
    assert coded.columns == [*df.columns, "ids"]
    back = decode(coded, PATH).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in back) == sorted((str(i), t or "") for i, t in odd)
    assert decode(encode(df.limit(0), PATH), PATH).collect() == []
    with pytest.raises(IndexError):
        Codec(PATH).decode([10 ** 6])

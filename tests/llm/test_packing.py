import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from covista.llm import queries
from covista.llm.packing import ByteLevelIds, best_fit, cut_at, pack, report, sequences

PATH = queries._public("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


def best_fit_by_search(lengths, length):
    bins = []
    for need in lengths:
        fits = [(room - need, i) for i, room in enumerate(bins) if room >= need]
        if fits:
            bins[min(fits)[1]] -= need
        else:
            bins.append(length - need)
    return sorted(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 70))
def test_segment_tree_finds_the_tightest_bin(lengths, length):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    bins, offsets = best_fit(lengths, length)
    fill = {}
    for b, o, n in zip(bins.tolist(), offsets.tolist(), lengths.tolist()):
        assert fill.get(b, 0) == o
        fill[b] = o + n
    assert sorted(length - f for f in fill.values()) == best_fit_by_search(lengths.tolist(), length)


@pytest.mark.parametrize("n, borders", [(1, [0, 1]), (8, [0, 8]), (9, [0, 1, 9]), (16, [0, 8, 16]), (20, [0, 4, 12, 20])])
def test_only_the_first_piece_is_shorter(n, borders):
    assert cut_at(n, 8) == borders


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab1'. \n\t\x0b\x1c\x85\xa0 　é中İ!s<|>"), max_size=30))
def test_words_give_the_library_ids(library, text):
    coder = ByteLevelIds(PATH)
    want = [library.encode(t, add_special_tokens=False).ids for t in (text, text + " " + text, " " + text)]
    for _ in range(2):              # new words, then remembered ones
        got = [np.frombuffer(b, "<u4").tolist() for b in coder.encode([text, text + " " + text, " " + text])]
        assert got == want


def check(rows, got, library, length):
    """Every piece by the library's ids; gapless places."""
    by_text = sorted((str(d), t or "") for d, t in rows)
    want = []
    for d, t in by_text:
        ids = ids_of(library, t)
        cuts = cut_at(len(ids), length)
        want += [(d, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    fill = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(f <= length for f in fill.values())
    short = sorted((w[3] for w in want if w[3] < length), reverse=True)
    return len(fill), len([w for w in want if w[3] == length]) + len(best_fit_by_search(short, length))


def test_query_packs_all_documents(spark, sf, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    used, one_machine = check(rows, queries.op12_packing(spark, sf).collect(), library, 1024)
    assert used == one_machine


def test_odd_rows_and_shards(spark, library):
    rows = [(3, None), (1, "It's 'THE' café don't \x1cx ½ <|endoftext|> a.b,,"), (None, "x"), (1, "again."), (1, "again."),
            (2, ""), (9, "Long words " * 3_000), (8, "é ́   İ\nK's\t!!"), (None, None)] + [(100 + i, "w " * (i % 37)) for i in range(300)]
    df = spark.createDataFrame([(d, t, "s", 0, b"k") for d, t in rows], "doc_id bigint, text string, ids string, length int, key binary")
    used, one_machine = check(rows, report(pack(df, PATH, length=64, shard_pieces=50)).collect(), library, 64)
    assert one_machine <= used <= one_machine + 8
    whole = sequences(pack(df, PATH, length=64)).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * sum(len(ids_of(library, t)) for _, t in rows)
    assert max(len(r["ids"]) for r in whole) <= 256


def test_empty_table(spark):
    assert report(pack(spark.createDataFrame([], "doc_id bigint, text string"), PATH)).collect() == []


def test_words_met_again_stay_when_the_memory_is_full(monkeypatch):
    import random

    import public_tokenizers

    from covista.llm import packing
    monkeypatch.setattr(packing, "CACHE_WORDS", 80)
    coder = packing.ByteLevelIds(public_tokenizers.path("byte_bpe_50k.json"))
    encoded, learn = [], coder._encode_lines
    monkeypatch.setattr(coder, "_encode_lines", lambda words: (encoded.extend(words), learn(words)))
    rng, most = random.Random(1), 0
    for _ in range(60):
        rare = ["".join(rng.choices("abcdeéßñ", k=9)) + rng.choice(["", ",", "###", ".%%%", "*x*", "'s.", "²,", "\n\u0301."]) for _ in range(10)]
        text = " Start common,%%% words " + " ".join(rare) + " Common stay. common"
        assert coder.encode([text]) == [np.array(coder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
        most = max(most, len(coder.known), len(coder.older))
    assert encoded.count("common") == encoded.count("words") == 1
    assert most < 80


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("abAZé×ßİ'.,!|<>1 \n\n\t\r\x85\xa0  　中—́"), max_size=25)), min_size=1, max_size=12))
def test_columns_give_the_library_ids(library, texts):
    import pyarrow as pa

    from covista.llm.common import kept
    coder = kept(("bytes", PATH), lambda: ByteLevelIds(PATH))
    texts = texts + ["a<|endoftext|> b", None, ""]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for column in (pa.array(texts, pa.string()), pa.array(["x. y", *texts], pa.string())[1:]):
        assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(column)] == want


def test_words_at_line_ends_are_encoded_once(library, monkeypatch):
    coder = ByteLevelIds(PATH)
    encoded, ids = [], coder._ids
    monkeypatch.setattr(coder, "_ids", lambda parts: (encoded.extend(parts), ids(parts))[1])
    names = [f"{a}{b}" for a in "klmnop" for b in "rstuvw"]
    text = "".join(f"{a}.\n{b} {a},\n\n{b}!" for a in names for b in names)
    assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(map(len, encoded)) < 20 * len(names)

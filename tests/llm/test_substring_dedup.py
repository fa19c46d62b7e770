import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from covista.llm import queries
from covista.llm.substring_dedup import (BITS, GEAR, MAX_CHUNK, MIN_CHUNK, MIN_WORDS, SEED_WORDS, WINDOW, borders, chunk_ends,
                                         chunks, remove_repeats, repeated_passages)

SF = "/root/testdata/sf0.01"


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=600))
def test_borders_are_the_rolling_hash(raw):
    want, h = [], []
    for i in range(len(raw)):   # h = (h << 1) + gear[byte] over the last WINDOW bytes
        value = 0
        for b in raw[max(0, i - WINDOW + 1):i + 1]:
            value = ((value << 1) + int(GEAR[b])) & 0xFFFFFFFF
        if value >> (32 - BITS) == 0:
            want.append(i + 1)
    data = np.frombuffer(raw, np.uint8)
    assert borders(data).tolist() == want if raw else chunk_ends(data) == []
    ends = chunk_ends(data)
    sizes = np.diff([0, *ends])
    assert (ends[-1] if ends else 0) == len(raw) and all(s <= MAX_CHUNK for s in sizes)
    assert all(s >= MIN_CHUNK for s in sizes[:-1])


def test_chunks_resist_insertions():
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(2000))
    a, b = chunks(text)[0], chunks("inserted words " + text[:5000] + " and some more " + text[5000:])[0]
    assert np.isin(a, b).mean() > 0.97


def brute(rows):
    """Spans by the definition, over chunks and word stretches held in dictionaries."""
    docs, held, shared = defaultdict(set), [], defaultdict(set)
    order = lambda d: (d is not None, d or 0)
    for doc, text in set(rows):
        if text:
            raw = text.encode()
            ends = chunk_ends(np.frombuffer(raw, np.uint8))
            parts = [(xxhash.xxh3_64_intdigest(raw[a:b]), a, b) for a, b in zip([0, *ends[:-1]], ends)]
            held.append((doc, text, raw, parts))
            for digest, _, _ in parts:
                docs[digest].add(doc)
    runs = []
    for doc, text, raw, parts in held:
        mine = []
        for digest, a, b in parts:
            if len(docs[digest]) > 1:
                if not (mine and mine[-1][1] == a):
                    mine.append([a, a, []])
                mine[-1][1] = b
                mine[-1][2].append(min(docs[digest], key=order))
        for a, b, firsts in mine:
            white = b" \t\n\x0b\x0c\r"
            words = sum(raw[i] not in white and (i == 0 or raw[i - 1] in white) for i in range(a, b))
            point = lambda n: len(raw[:n].decode(errors="ignore")) + (0 < n < len(raw) and raw[n] & 0xC0 == 0x80)
            if words >= SEED_WORDS:
                digests = [digest for digest, x, y in parts if a <= x and y <= b]
                runs.append((doc, text, point(a), point(b), words, min(firsts, key=order), digests))
    asked = set()
    for doc, text, a, b, words, first, digests in runs:
        if words < MIN_WORDS:
            asked |= set(digests)
    spans = defaultdict(list)
    for doc, text, a, b, words, first, _ in runs:
        if words >= MIN_WORDS:
            spans[doc, text].append((a, b, words, first))
    near = {}
    for doc, text, raw, parts in held:
        point = lambda n: len(raw[:n].decode(errors="ignore")) + (0 < n < len(raw) and raw[n] & 0xC0 == 0x80)
        chunks_at = [(point(a), point(b)) for digest, a, b in parts if digest in asked and len(docs[digest]) > 1]
        words = [(m.start(), m.end()) for m in re.finditer("[^ \t-\r]+", text)]
        near[doc, text] = []
        for i in range(len(words) - MIN_WORDS + 1):
            part = words[i:i + MIN_WORDS]
            if any(x < b and y > a for a, b in chunks_at for x, y in part):
                h = " ".join(text[x:y] for x, y in part)
                near[doc, text].append((h, part[0][0], part[-1][1]))
                shared[h].add(doc)
    for at, found in near.items():
        spans[at] += [(a, b, MIN_WORDS, min(shared[h], key=order)) for h, a, b in found if len(shared[h]) > 1]
    out = set()
    for (doc, text), found in spans.items():
        merged = []
        for a, b, words, first in sorted(found, key=lambda s: s[:3]):
            if merged and a <= merged[-1][1]:
                last = merged[-1]
                merged[-1] = (last[0], max(b, last[1]), max(words, last[2]), min(first, last[3], key=order))
            else:
                merged.append((a, b, words, first))
        out |= {(doc, *m) for m in merged}
    return out


def test_planted_passages_and_short_lines(spark):
    """Passages of 51 words are found in both documents, common lines of 15 words are not."""
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))
    line, docs, planted = prose(15), [], set()
    for i in range(120):
        shared = prose(51)
        for d in (2 * i, 2 * i + 1):
            with_it = i % 2 == 0
            docs.append((d, f"{prose(rng.randint(20, 90))} {shared if with_it else line} {prose(rng.randint(20, 90))}"))
            planted |= {d} if with_it else set()
    got = {r.doc_id for r in repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got <= planted and len(got) >= 0.97 * len(planted)


def test_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op1_repeated_passages(spark, SF).collect()
    assert {(r.doc_id, r.start, r.end, r.n_words, r.first_doc_id) for r in got} == brute(rows) and len(got) > 20


RNG = random.Random(9)
FILL = [" ".join("".join(RNG.choices("abcdefghijklmnop", k=6)) for _ in range(80)) for _ in range(8)]
PASSAGE = " ".join("".join(RNG.choices("qrstuvwxyzé", k=6)) for _ in range(56))
ODD = [(1, f"{FILL[0]} {PASSAGE} {FILL[1]}"), (2, f"{PASSAGE} {FILL[2]}"), (3, f"{FILL[3]}"), (4, None), (5, ""),
       (None, f"{FILL[4]} {PASSAGE}"), (6, f"{FILL[5]} {FILL[5]}"), (7, FILL[6]), (7, FILL[6]), (8, "x" * 100_000), (9, "x" * 90_000),
       (1, f"{FILL[7]}")]


def test_odd_rows(spark):
    df = spark.createDataFrame([(d, t, 3, 4) for d, t in ODD], "doc_id bigint, text string, digest int, span int")
    got = repeated_passages(df).collect()
    assert {(r.doc_id, r.start, r.end, r.n_words, r.first_doc_id) for r in got} == brute(ODD)
    assert {r.doc_id for r in got} == {1, 2, None}     # own repetition, single words and short texts are no passages
    left = remove_repeats(df)
    assert left.columns == df.columns
    texts = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert len(texts) == len(ODD) and sum(PASSAGE[60:-60] in (t or "") for _, t in texts) == 1
    assert all(f in "".join(t or "" for _, t in texts) for f in FILL)
    assert repeated_passages(df.limit(0)).collect() == [] and remove_repeats(df.limit(0)).collect() == []


def test_every_planted_passage_is_found(spark):
    """Passages of 50 words, of short words too, other white space between the words in one copy."""
    rng = random.Random(12)
    docs = []
    for i in range(900):
        most = (1, 3, 4)[i % 3]
        prose = lambda n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, most))) for _ in range(n)]
        shared = prose(50)
        for d, blank in ((2 * i, " "), (2 * i + 1, " " if i % 10 else "\n ")):
            docs.append((d, " ".join([*prose(rng.randint(20, 90)), blank.join(shared), *prose(rng.randint(20, 90))])))
    got = {r.doc_id for r in repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()}
    assert len(got) == len(docs)

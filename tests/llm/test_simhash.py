import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from covista.llm import queries
from covista.llm.components import components
from covista.llm.simhash import fingerprint, keep_first, links, near_duplicates, spanning


def brute_fp(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(fps, distance=4):
    """Smallest index reachable, per index."""
    fps = np.array(fps, np.uint64)
    root, out = 0, np.full(len(fps), -1)
    for i in range(len(fps)):
        if out[i] < 0:
            front = [i]
            out[i] = i
            while front:
                near = np.flatnonzero((np.bitwise_count(fps ^ fps[front.pop()]) <= distance) & (out < 0))
                out[near] = i
                front += near.tolist()
    return out


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB É\t\n\x0b\x1c. ÀK", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text) == brute_fp(text)


def want(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    fps = [brute_fp(t) for _, t in rows]
    return sorted(((d, f"{f:016x}", rows[r][0]) for (d, _), f, r in zip(rows, fps, brute_roots(fps))), key=str)


def test_query_matches_brute_force(spark, sf="/root/testdata/sf0.01"):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op7_simhash(spark, sf).collect()), key=str)
    assert got == want(rows)
    assert len({c for _, _, c in got}) < len(got)


ODD = [(5, None), (4, ""), (9, " \t\n"), (7, "One"), (8, "one"), (None, "one"), (3, "alone text of more than four words"),
       (3, "alone text of more than four words"), (6, "É é a b c"), (2, "x " * 200_000), (1, "X " * 200_000 + "x")]


def odd(spark):
    return spark.createDataFrame([(d, t, 1, 2) for d, t in ODD], "doc_id bigint, text string, fp int, root int")


def test_odd_rows(spark):
    from covista.llm.simhash import as_hex
    got = near_duplicates(odd(spark)).select("doc_id", as_hex("fp"), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want(ODD)
    kept = keep_first(odd(spark))
    assert kept.columns == ["doc_id", "text", "fp", "root"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, 6, 7]
    assert near_duplicates(odd(spark).limit(0)).collect() == [] and keep_first(odd(spark).limit(0)).collect() == []


def close_values(n, seed):
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(0, 1 << 63, 8, dtype=np.uint64)]
    while len(out) < n:   # chains and clusters: each value flips up to 5 bits of an earlier one
        out.append(out[rng.integers(len(out))] ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(1, 6)))))
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("limit", [4096, 3])
def test_links_lose_no_connection(spark, limit):
    values = sorted(close_values(120, 5))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    got = components(links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), limit=limit)).collect()
    group = {r.node: r.root for r in got}
    label = brute_roots(values)
    mine = [group.get(s, s) for s in signed]
    assert len(set(zip(mine, label))) == len(set(mine)) == len(set(label))


def test_spanning_forest():
    values = np.array(close_values(200, 3), np.uint64)
    edges = spanning(values, 4)
    assert len(edges) == len(values) - len(set(brute_roots(values)))
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 180)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{j: 100 for j in range(100, 180)}}

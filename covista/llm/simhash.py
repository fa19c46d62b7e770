"""Op 7: near duplicates by SimHash fingerprints and pigeonhole blocks.

A document's words (ASCII letters in lower case) form shingles of four; each shingle is hashed by
XXH64 and a fingerprint bit is set where more than half of the hashes have it.  Fingerprints link when
they differ in at most ``distance`` bits.

Pigeonhole: 64 bits are split into ``PARTS`` = 7 parts; 4 differing bits touch at most 4 parts, so a
linked pair agrees in some 3 of the 7 parts.  Every distinct fingerprint (copies are merged first)
gets one key for each of the 35 choices of 3 parts; fingerprints with equal keys meet in one block of
27 or 28 fixed bits, which keeps chance meetings rare up to billions of documents.  Blocks are read in
key order by streaming tasks that verify Hamming distances and send on only a spanning forest of the
block's links, never its pairs.

Blocks of more than ``BLOCK_LIMIT`` fingerprints (many near copies of one text) take an exact way whose
cost is linear in their members: two fingerprints differ in at most 4 bits if and only if some value
lies within 2 bits of both, so each member is keyed by the 2,081 values within 2 bits of it and links
to the smallest member with the same key.

Components of the links are found by star contraction; documents join their fingerprint's component
through written tables, so a fingerprint held by a third of all documents can be split by the join.

Defined results: null and empty texts and texts of white space have fingerprint zero and link like any
other; a null id stays in the result and is never a component's id unless all ids are null; repeated
rows stay; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, map_batches, texts
from .components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
PARTS = 7
BLOCK_LIMIT = 4096
CHUNK = 1 << 16          # shingles counted at a time


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint; 0 where the text has no words."""
    # bytes.lower() and bytes.split() touch ASCII only: A-Z, and the space and tab to carriage return
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in
                          zip(starts[:n].tolist(), ends[shingle - 1:].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        part = hashes[i:i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in texts(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(fps, pa.int64())],
                                             names=["doc_id", "text_key", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, fp`` of every row (fp as a signed 64-bit integer, ``text_key`` a hash of the
    text), as a written table."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_key"),
                       F.col(text_col).alias("text"))
    return cut_lineage(map_batches(rows, _fingerprints(shingle), "doc_id bigint, text_key bigint, fp bigint"), "fingerprints")


def part_masks() -> list[int]:
    """For each choice of 3 parts the mask of their bits, as signed 64-bit integers."""
    edges = [64 * i // PARTS for i in range(PARTS + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(parts[i] for i in choice) for choice in combinations(range(PARTS), PARTS - DISTANCE)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _block_keys(distinct: DataFrame) -> DataFrame:
    """``choice, key, fp``: one row per fingerprint and choice of parts."""
    masks = F.array(*[F.lit(m).cast("bigint") for m in part_masks()])
    return (distinct.select("fp", F.posexplode(masks).alias("choice", "mask"))
                    .select(F.col("choice").cast("byte").alias("choice"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def spanning(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints within ``distance``, one vectorised scan each:
    a growing front takes every unseen fingerprint near one of its members."""
    left, out = np.sort(fps), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = _distances(left, at) <= distance
            if near.any():
                found = left[near]
                out += [(int(at), int(f)) for f in found]
                front += list(found)
                left = left[~near]
    return out


def _links(distance: int, limit: int):
    """Blocks in key order; a block that grows over ``limit`` sends its members on as ``hot``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def close(a, b, hot):
            if 1 < size <= limit:
                for x, y in spanning(np.concatenate(held).view(np.uint64), distance):
                    a.append(x)
                    b.append(y)
                    hot.append(False)

        def made(a, b, hot):
            signed = [pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (a, b)]
            return pa.RecordBatch.from_arrays([*signed, pa.array(hot, pa.bool_())], names=["a", "b", "hot"])

        for batch in batches:
            choice, key, fp = (batch.column(c).to_numpy() for c in ("choice", "key", "fp"))
            a, b, hot = [], [], []
            if len(fp):
                new = np.flatnonzero((np.diff(key) != 0) | (np.diff(choice) != 0)) + 1
                cuts = np.concatenate(([0], new, [len(fp)]))
                # blocks of one inside the batch need no look; only runs of two or more, and both edges, do
                look = np.flatnonzero(np.diff(cuts) > 1)
                look = np.unique(np.concatenate((look, [0, len(cuts) - 2])))
                for i in look.tolist():
                    start, end = cuts[i], cuts[i + 1]
                    at = (int(choice[start]), int(key[start]))
                    if at != now:
                        close(a, b, hot)
                        now, held, size = at, [], 0
                    size += end - start
                    if size <= limit:
                        held.append(fp[start:end])
                    else:
                        over = [*held, fp[start:end]]
                        held = []
                        for part in over:
                            unsigned = part.view(np.uint64).tolist()
                            a += unsigned
                            b += unsigned
                            hot += [True] * len(unsigned)
            if a:
                yield made(a, b, hot)
        a, b, hot = [], [], []
        close(a, b, hot)
        if a:
            yield made(a, b, hot)

    return run


def _ball(distance: int):
    """Every value within ``distance`` / 2 bits of each fingerprint, one key a row."""
    flips = [0] + [sum(1 << i for i in c) for r in range(1, distance // 2 + 1) for c in combinations(range(64), r)]
    flips = np.array(flips, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp in batch.column("fp").to_numpy().view(np.uint64):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flips), fp).view(np.int64)),
                                                  pa.array((fp ^ flips).view(np.int64))], names=["fp", "near"])

    return run


def links(distinct: DataFrame, distance: int = DISTANCE, limit: int = BLOCK_LIMIT) -> DataFrame:
    """``a, b``: links whose components are those of all pairs of fingerprints within ``distance``
    (4 at most, and even for blocks over ``limit``)."""
    if not 0 <= distance <= DISTANCE or distance % 2:
        raise ValueError(f"distance must be even and at most {DISTANCE}")
    keys = _block_keys(distinct).repartition("choice", "key").sortWithinPartitions("choice", "key")
    found = cut_lineage(keys.mapInArrow(_links(distance, limit), "a bigint, b bigint, hot boolean"), "links")
    near = found.filter(~F.col("hot")).select("a", "b")
    hot = found.filter("hot").select(F.col("a").alias("fp")).distinct()
    if hot.isEmpty():
        return near
    balls = cut_lineage(hot.mapInArrow(_ball(distance), "fp bigint, near bigint"), "balls")
    first = cut_lineage(balls.groupBy("near").agg(F.min("fp").alias("least"), F.max("fp").alias("most"))
                             .filter("least != most").select("near", "least"), "balls")
    linked = balls.join(first, "near").filter("fp != least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return near.unionByName(linked.distinct())


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, limit: int = BLOCK_LIMIT, **options) -> DataFrame:
    """``doc_id, text_key, fp, root, component_id`` of every row: ``component_id`` is the smallest id
    reachable over links, ``root`` a fingerprint that names the component."""
    rows = fingerprints(docs, **options)
    firsts = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    roots = cut_lineage(components(links(firsts.select("fp"), distance, limit)), "roots")
    rooted = (firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                    .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = cut_lineage(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    member = cut_lineage(rooted.join(least, "root").select("fp", "root", "component_id"), "members")
    return rows.join(member, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def as_hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without near duplicates: of every component one row stays, that of the smallest id (rows
    without an id last; of rows that repeat it, the smallest text hash, and one of equal rows)."""
    found = cut_lineage(near_duplicates(docs, id_col=id_col, text_col=text_col, **options), "near")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    kept = cut_lineage(found.groupBy("root").agg(F.min(order).alias("k"), ).select(
        F.col("k.doc_id").alias("__id"), F.col("k.text_key").alias("__key")).distinct(), "kept")

    def only(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return df.join(keys, F.col(id_col).cast("bigint").eqNullSafe(F.col("__id"))
                       & (F.xxhash64(text_col) == F.col("__key")), how)
    repeated = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).count().filter("count > 1")
    repeated = cut_lineage(repeated.join(kept, repeated["__id"].eqNullSafe(kept["__id"]) & (repeated["__key"] == kept["__key"]),
                                         "left_semi").drop("count"), "repeated")
    if repeated.isEmpty():   # the usual case: the join alone leaves one row a component
        return only(docs, kept, "left_semi")
    single = only(only(docs, kept, "left_semi"), repeated, "left_anti")
    return single.unionByName(only(docs, repeated, "left_semi").dropDuplicates([id_col, text_col]))

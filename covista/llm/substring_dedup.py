"""Op 1: repeated passages by content-defined chunking with a gear rolling hash.

A text's bytes are cut where the gear hash of the last ``WINDOW`` bytes has its top bits clear, so
borders depend on content only and move with it when text is inserted before it.  Chunks are
``MIN_CHUNK`` to ``MAX_CHUNK`` bytes, about ``MIN_CHUNK`` + 2^``BITS`` on average: small enough that a
passage of 50 words holds several whole ones.  Chunks are compared by 64-bit digests.

A digest that occurs in two or more documents is repeated.  Digests are aggregated to their smallest
and largest document and a count, combined before the shuffle, so a passage held by a third of all
documents is one row per task; the repeated digests are written and joined back to the chunks, both as
plain shuffles that the join can split.  Adjoining repeated chunks of a document are merged into runs.

A run of at least ``min_words`` words is a passage.  Shorter passages may hold no whole shared chunk, so
they are looked for exactly, whatever chunks they have: each stretch of ``min_words`` words is known by
its anchor, the least gear hash of ``ANCHOR`` bytes at the ends of its words (white space as one blank),
and equal stretches have equal anchors.  Wherever an anchor occurs that two documents have, the
stretches known by it are hashed, and stretches that two documents share are passages too; anchors that
all lie in runs of ``min_words`` words are left out.  A stretch that touches such a run counts only if two
documents have it at a chunk of a shorter run; else the ends of long runs are whole chunks.  Passages of a document
that overlap are reported as one.

Defined results: null and empty texts have no chunks; all rows without an id count as one document;
rows that repeat an id are one document for counting, and rows of one id with different texts keep
their own spans; repetition inside one document alone is not reported; an empty table gives an empty
table.  Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, map_batches, texts

WINDOW = 16
BITS = 4                 # a border every 2^4 bytes, after MIN_CHUNK bytes without one
MIN_CHUNK, MAX_CHUNK = 24, 256
MIN_WORDS, SEED_WORDS = 50, 0
ANCHOR = 32              # bytes of an anchor
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
GEAR64 = np.random.default_rng(20240301).integers(0, 1 << 64, 256, dtype=np.uint64)
NO_ID = -(1 << 63)
WORD = re.compile(r"[^ \t-\r]+")


def borders(data: np.ndarray) -> np.ndarray:
    """Positions after which the gear hash asks for a cut."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:   # h covers the last ``width`` bytes; double that
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h = longer
        width *= 2
    return np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1


def chunk_ends(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's bytes."""
    ends, last = [], 0
    for at in borders(data).tolist() if len(data) else []:
        if at - last >= MIN_CHUNK:
            while at - last > MAX_CHUNK:
                last += MAX_CHUNK
                ends.append(last)
            if at - last >= MIN_CHUNK:
                ends.append(at)
                last = at
    while len(data) - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


def chunks(text: str):
    """Arrays over the chunks of a text: digest, first and last code point, words that begin in it."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    ends = chunk_ends(data)
    starts = [0, *ends[:-1]]
    digests = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts, ends)), np.uint64, len(ends))
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~space
    begins[1:] &= space[:-1]
    words = np.concatenate(([0], np.cumsum(begins)))
    a, b = np.array(starts, np.int64), np.array(ends, np.int64)
    return digests.view(np.int64), points[a], points[b], words[b] - words[a]


def _chunk_rows(digest_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = batch.column("doc").to_numpy(), batch.column("text_key").to_numpy()
            out = []
            for doc, key, text in zip(docs, keys, texts(batch, "text")):
                if text:
                    digest, start, end, words = chunks(text)
                    if digest_only:
                        digest = np.unique(digest)
                        out.append((np.full(len(digest), doc), digest))
                    else:
                        out.append((np.full(len(digest), doc), digest, start << 32 | end, words << 32 | (int(key) & 0xFFFFFFFF)))
            if out:
                names = ["doc", "digest", "span", "words"]
                columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, names=names[:len(columns)])

    return run


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"),
                       F.hash(text_col).alias("text_key"), F.col(text_col).alias("text"))


def repeated_digests(rows: DataFrame) -> DataFrame:
    """``digest, first_doc, n_docs`` of the chunks found in two or more documents, as a written table."""
    seen = map_batches(rows, _chunk_rows(True), "doc bigint, digest bigint")
    return cut_lineage(seen.groupBy("digest").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last"),
                                                  F.count(F.lit(1)).alias("n_docs"))
                           .filter("first_doc < last").select("digest", "first_doc", "n_docs"), "digests")


def _hits(rows: DataFrame) -> DataFrame:
    """Every repeated chunk of every document, as a written table."""
    found = repeated_digests(rows)
    each = map_batches(rows, _chunk_rows(False), "doc bigint, digest bigint, span bigint, words bigint")
    hits = each.join(found, "digest")
    low = F.lit(0xFFFFFFFF)
    key = F.col("words").bitwiseAND(low)     # the text's hash as Spark computes it, without its sign
    hits = hits.select("doc", F.when(key >= F.lit(1 << 31), key - F.lit(1 << 32)).otherwise(key).cast("int").alias("text_key"),
                       F.shiftright("span", 32).alias("start"), F.col("span").bitwiseAND(low).alias("end"),
                       F.shiftright("words", 32).alias("words"), "digest", "first_doc", "n_docs").distinct()
    return cut_lineage(hits, "hits")


def _numbered(spans: DataFrame) -> DataFrame:
    """``spans`` with ``run``: spans of a text that meet or overlap have the same number."""
    by_text = Window.partitionBy("doc", "text_key").orderBy("start", "end")     # one document's spans
    so_far = F.max("end").over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", (F.col("start") > F.coalesce(so_far, F.lit(-1))).cast("int"))
    return spans.withColumn("run", F.sum("new").over(by_text.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def anchors(text: str, n: int) -> tuple[np.ndarray, ...]:
    """Arrays over the runs of stretches of ``n`` words with the same anchor: the anchor, the numbers of the
    first and last stretch, first and last code point."""
    data = np.frombuffer(text.encode(), np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    after = np.append(True, space[:-1])
    at = np.flatnonzero(~(space & after))              # bytes without repeated blanks
    line = np.where(space[at], np.uint8(32), data[at])
    begins, ends = np.flatnonzero(~space & after), np.flatnonzero(~space & np.append(space[1:], True))
    if len(begins) < n:
        return (np.zeros(0, np.int64),) * 5
    most = ANCHOR
    while most // 2 >= n:
        most //= 2
    h, width = GEAR64[line], 1
    while width < most:     # h covers the last ``width`` bytes; double that
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint64(width)
        h = longer
        width *= 2
    skip = most // 2        # so many words and one more hold the bytes of an anchor
    least, size = h[np.searchsorted(at, ends)][skip:], 1
    while size < n - skip:  # least covers the next ``size`` words
        step = min(size, n - skip - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(first[1:], len(least)) - 1
    points = np.cumsum((data & 0xC0) != 0x80)
    return least[first].view(np.int64), first, last, points[begins[first]] - 1, points[ends[last + n - 1]]


def _anchor_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, key, text in zip(batch.column("doc").to_numpy(), batch.column("text_key").to_numpy(), texts(batch, "text")):
                if text:
                    anchor, first, last, start, end = anchors(text, n)
                    out.append((np.full(len(anchor), doc), np.full(len(anchor), key), anchor, first << 32 | last, start << 32 | end))
            if out:
                names = ["doc", "text_key", "anchor", "numbers", "span"]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int32() if k == "text_key" else pa.int64())
                                                  for k, c in zip(names, zip(*out))], names=names)

    return run


def stretches(text: str, numbers: list[tuple[int, int]], short: list[tuple[int, int]], long: list[tuple[int, int]],
              n: int) -> Iterator[tuple[int, int, int, bool, bool]]:
    """``(hash, first and last code point, touches short, touches long)`` of the numbered stretches of ``n`` words;
    ``short`` and ``long`` are the chunks of shorter runs and the long runs."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    parts = [text[a:b].encode() for a, b in words]
    line = b" ".join(parts)
    ends = np.cumsum(np.array([len(p) + 1 for p in parts], np.int64)).tolist()
    touches = np.zeros((2, len(words)), bool)
    for row, spans in zip(touches, (short, long)):
        for start, end in spans:
            first = bisect_left(words, (start, 0))
            if first and words[first - 1][1] > start:
                first -= 1
            row[max(0, first - n + 1):bisect_left(words, (end, 0))] = True
    at_short, at_long = touches.tolist()
    for first, last in numbers:
        for i in range(first, last + 1):
            head = ends[i - 1] if i else 0
            yield xxhash.xxh3_64_intdigest(line[head:ends[i + n - 1] - 1]), words[i][0], words[i + n - 1][1], at_short[i], at_long[i]


def _stretch_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "text_key", "hash", "start", "end", "at_short", "at_long"]
        types = {"text_key": pa.int32(), "at_short": pa.bool_(), "at_long": pa.bool_()}
        for batch in batches:
            out = []
            for doc, key, text, numbers, short, long in zip(*(batch.column(c).to_pylist() for c in
                                                              ("doc", "text_key", "text", "numbers", "short", "long"))):
                spans = [[(x["start"], x["end"]) for x in xs or []] for xs in (short, long)]
                out += [(doc, key, h - (1 << 64) if h >> 63 else h, *rest)
                        for h, *rest in stretches(text, [(x >> 32, x & 0xFFFFFFFF) for x in numbers], *spans, n)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, types.get(k, pa.int64())) for k, c in zip(names, zip(*out))], names=names)

    return run


def _shared(found: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` that two or more documents have (``by_short``: at chunks of shorter runs), as a
    written table."""
    more = []
    if "at_short" in found.columns:
        at_short = F.when(F.col("at_short"), F.col("doc"))
        more = [F.coalesce(F.min(at_short) < F.max(at_short), F.lit(False)).alias("by_short")]
    return cut_lineage(found.groupBy(key).agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n_docs"), *more)
                            .filter("first_doc < last").drop("last"), "shared")


def _exact(rows: DataFrame, short: DataFrame, long: DataFrame, n: int) -> DataFrame:
    """``doc, text_key, start, end, n_words, first_doc, n_docs``: stretches of ``n`` words that documents
    share.  ``short`` are chunks of shorter runs, ``long`` the long runs."""
    def listed(spans: DataFrame, name: str) -> DataFrame:     # one document's spans
        return spans.groupBy("doc", "text_key").agg(F.collect_list(F.struct("start", "end")).alias(name))
    held = cut_lineage(map_batches(rows, _anchor_rows(n), "doc bigint, text_key int, anchor bigint, numbers bigint, span bigint"), "anchors")
    some = held.join(_shared(held, "anchor").select("anchor"), "anchor")
    runs = cut_lineage(listed(long, "long"), "long")
    inside = F.exists("long", lambda x: (x["start"] <= F.shiftright("span", 32)) & (F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)) <= x["end"]))
    some = cut_lineage(some.join(runs, ["doc", "text_key"], "left").withColumn("inside", F.coalesce(inside, F.lit(False)))
                           .drop("long", "span"), "some")
    asked = cut_lineage(some.filter(~F.col("inside")).select("anchor").distinct(), "asked")
    numbers = some.join(asked, "anchor", "left_semi").groupBy("doc", "text_key").agg(F.collect_set("numbers").alias("numbers"))
    numbers = numbers.join(listed(short, "short"), ["doc", "text_key"], "left").join(runs, ["doc", "text_key"], "left")
    near = rows.join(numbers.withColumnsRenamed({"doc": "_d", "text_key": "_k"}),
                     (F.col("doc") == F.col("_d")) & (F.col("text_key") == F.col("_k")))
    found = cut_lineage(map_batches(near.select("doc", "text_key", "text", "numbers", "short", "long"), _stretch_rows(n),
                                    "doc bigint, text_key int, hash bigint, start bigint, end bigint, at_short boolean, at_long boolean"), "stretches")
    return (found.join(_shared(found, "hash"), "hash").filter("not at_long or at_short and by_short")
                 .select("doc", "text_key", "start", "end", F.lit(n).cast("bigint").alias("n_words"), "first_doc", "n_docs"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, later_only: bool = False, seed_words: int = SEED_WORDS,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, start, end, n_words, first_doc_id, n_docs``: one row per passage of a document
    that other documents hold too.  ``n_words`` is a lower bound of its words, ``first_doc_id`` the
    smallest document that has a part of it, ``n_docs`` the most rows that share one.  With
    ``later_only`` only what an earlier document holds counts, so that removing the passages leaves
    their first occurrence."""
    rows = _documents(docs, id_col, text_col)
    hits = _hits(rows)
    chosen = cut_lineage(_numbered(hits.filter("first_doc < doc") if later_only else hits), "chosen")
    runs = cut_lineage(chosen.groupBy("doc", "text_key", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"),
        F.min("first_doc").alias("first_doc"), F.max("n_docs").alias("n_docs"))
        .filter(F.col("n_words") >= F.lit(min(seed_words, min_words))), "runs")
    short = runs.filter(F.col("n_words") < F.lit(min_words))
    asked = cut_lineage(chosen.join(short.select("doc", "text_key", "run"), ["doc", "text_key", "run"], "left_semi")
                              .select("digest").distinct(), "asked")
    chunks_of_short = hits.join(asked, "digest", "left_semi")
    long = runs.filter(F.col("n_words") >= F.lit(min_words)).drop("run")
    more = _exact(rows, chunks_of_short, long, min_words)
    if later_only:
        more = more.filter("first_doc < doc")
    found = _numbered(long.unionByName(more)).groupBy("doc", "text_key", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("n_words").alias("n_words"),
        F.min("first_doc").alias("first_doc"), F.max("n_docs").alias("n_docs"))

    def named(c):
        return F.when(F.col(c) != F.lit(NO_ID), F.col(c))
    return found.select(named("doc").alias("doc_id"), "text_key", "start", "end", "n_words",
                        named("first_doc").alias("first_doc_id"), "n_docs")


def _cut(columns: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(texts(batch, text_col), batch.column("__spans").to_pylist()):
                for s in sorted(spans, key=lambda s: -s["start"]):
                    text = text[:s["start"]] + text[s["end"]:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.schema.field(text_col).type) if c == text_col
                                              else batch.column(c) for c in columns], names=columns)

    return run


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every repeated passage cut from all documents but the first that holds it."""
    spans = cut_lineage(repeated_passages(docs, min_words, True, id_col=id_col, text_col=text_col), "passages")
    cuts = (spans.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
                 .agg(F.collect_list(F.struct("start", "end")).alias("__spans")))    # one document's passages
    joined = docs.join(cuts, F.col(id_col).cast("bigint").eqNullSafe(F.col("__id")) & (F.hash(text_col) == F.col("__key")), "left")
    same = joined.filter(F.col("__spans").isNull()).select(*docs.columns)
    return same.unionByName(map_batches(joined.filter(F.col("__spans").isNotNull()).select(*docs.columns, "__spans"),
                                        _cut(docs.columns, text_col), docs.schema))

"""Op 2: benchmark passages in documents by latent semantic retrieval.

The benchmark's items are TF-IDF vectors over their vocabulary; the inverse frequencies come from the
counts of those words in the whole corpus.  A distributed randomised SVD (Halko and others 2011: range
finder, power iterations, projection; every product with the matrix is a Spark job over the TF-IDF
rows that returns summed blocks) gives ``dims`` latent directions, and items and passages are compared
there.  An item that keeps less than ``KEPT`` of its energy in those directions, as most do when there
are many more items than directions, is compared by its whole sparse TF-IDF vector instead; the cosines
of the others are divided by the share of the norm they keep.  Very common words have no weight, unless an item hardly has others; a word outside the
benchmark's vocabulary only lengthens a passage's vector, by the median inverse frequency.  Documents
are cut into blocks of 16 words; the projected blocks are compared with all items in one product, and
the windows of 16, 32 and 64 words, and for longer items of twice the words until they hold the longest
one, are sums of blocks.  Window and item pairs with a cosine of at least
``min_cosine`` are candidates; each is decided by the longest common subsequence of words between the
item and the window's surroundings: ``strong`` of the item's words, or ``weak`` of them with the item's
answer found too.

A benchmark block of at most ``BLOCK_BYTES`` of text is broadcast with its vectors; a larger benchmark
is scanned block by block.  No documents are shuffled, collected or joined.

Defined results: null and empty items and texts match nothing; an item without an answer column has its
last sentence as answer; repeated items are each reported; a null id is reported as null; repeated rows
are each scanned; an empty table on either side gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, map_batches, texts

DIMS, OVERSAMPLE, POWER = 160, 16, 2
STRIDE = 16                          # words of a block; windows are 1, 2, 4 blocks, more for long items
COMMON, RARE_SHARE = 0.003, 0.4      # share of a very common word; least share of other words in an item
KEPT = 0.8                           # least share of an item's energy in the latent space
SLICE = 1024                         # blocks projected at a time
CELLS = 1 << 23                      # scores of blocks and items held at a time
MIN_COSINE = 0.35
STRONG, WEAK, ANSWER = 0.75, 0.65, 0.8
BLOCK_BYTES = 1 << 20
TERM_BLOCK = 1024                    # rows of a matrix block
BREAKS = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
SENTENCE = re.compile(r"[.!?\n]+")
FOUND = "doc_id bigint, item_id bigint, cosine double, lcs double, answer boolean, first_word bigint, n_words bigint"


def words_of(text: str) -> list[bytes]:
    """Words in lower case; ASCII punctuation separates."""
    return text.lower().encode().translate(BREAKS).split()


def answer_of(text: str) -> list[bytes]:
    """The last sentence of an item that has one besides, else nothing."""
    parts = [w for w in map(words_of, SENTENCE.split(text)) if w]
    return parts[-1] if len(parts) > 1 else []


def lcs(item: list[bytes], words: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows (Hyyrö 2004)."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in words:
        m = at.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


class Benchmark:
    """One block of items with its vocabulary; vectors are added by ``weigh`` and ``project``."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        self.words = [words_of(r[1] or "") for r in rows]
        self.answers = [words_of(r[2]) if r[2] is not None else answer_of(r[1] or "") for r in rows]
        self.term: dict[bytes, int] = {}
        for ws in self.words:
            for w in ws:
                self.term.setdefault(w, len(self.term))

    def terms(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.term.get, words, repeat(-1)), np.int32, len(words))

    def weigh(self, counts: np.ndarray, total: int) -> None:
        """Inverse frequencies; the last one stands for every word outside the vocabulary."""
        idf = np.log1p(total / (1.0 + counts))
        drop = counts > COMMON * total
        for words in self.words:
            at = self.terms(words)
            if len(at) and np.mean(~drop[at]) < RARE_SHARE:
                drop[at] = False
        self.idf = np.append(np.where(drop, 0.0, idf), np.median(idf) if len(idf) else 1.0)

    def vector(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at, n = np.unique(self.terms(words), return_counts=True)
        return at, n * self.idf[at]

    def project(self, directions: np.ndarray) -> None:
        """Latent vectors of terms and items, scaled so that products with an occurrence's vector sum to
        the cosine times the window's norm; items that keep too little have sparse vectors (``posted``,
        ``share`` from ``post`` on, by term) instead."""
        self.directions = (directions * self.idf[:-1, None]).astype(np.float32)   # of one occurrence
        self.latent = np.zeros((len(self.words), directions.shape[1]), np.float32)
        at, item, share = [], [], []
        for i, ws in enumerate(self.words):
            terms, x = self.vector(ws)
            energy = float(x @ x)
            if energy > 0:
                row = x @ directions[terms]
                kept = float(row @ row)
                if kept >= KEPT * energy:
                    self.latent[i] = row * (np.sqrt(energy) / kept)
                else:
                    terms, x = terms[x > 0], x[x > 0]
                    at.append(terms)
                    item.append(np.full(len(terms), i))
                    share.append(x * self.idf[terms] / np.sqrt(energy))
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        order = np.argsort(at, kind="stable")
        self.post = np.searchsorted(at[order], np.arange(len(self.term) + 1))
        self.posted = np.concatenate(item)[order].astype(np.int32) if item else np.zeros(0, np.int32)
        self.share = np.concatenate(share)[order].astype(np.float32) if share else np.zeros(0, np.float32)


def _counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        counts, total = np.zeros(len(bench.term) + 1, np.int64), 0
        for batch in batches:
            for text in texts(batch, "text"):
                terms = bench.terms(words_of(text))
                total += len(terms)
                counts += np.bincount(terms + 1, minlength=len(counts))
        counts[0] = total
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at - 1, pa.int64()), pa.array(counts[at], pa.int64())], names=["term", "n"])

    return run


def corpus_counts(docs: DataFrame, bench: Benchmark, shared) -> tuple[np.ndarray, int]:
    """Occurrences of the benchmark's words in all documents, and of all words."""
    sums = map_batches(docs.select("text"), _counts(shared), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    rows = sums.toArrow()        # at most one row per word of the benchmark block
    counts = np.zeros(len(bench.term) + 1, np.int64)
    counts[rows.column("term").to_numpy() + 1] = rows.column("n").to_numpy()
    return counts[1:], int(counts[0])


def _product(shared):
    """Summands of AᵀA·Q by blocks of terms: each task adds the rows it holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        out = np.zeros_like(q)
        for batch in batches:
            for at, x in zip(batch.column("terms").to_pylist(), batch.column("weights").to_pylist()):
                at, x = np.array(at, np.int64), np.array(x)
                out[at] += x[:, None] * (x @ q[at])
        for b in range(0, len(q), TERM_BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([out[b:b + TERM_BLOCK].tobytes()], pa.binary())],
                                             names=["first", "block"])

    return run


def _add(group: pa.Table) -> pa.Table:
    """Sum of the tasks' summands of one block, one at a time."""
    total = 0.0
    for block in group.column("block"):
        total = total + np.frombuffer(block.as_buffer(), np.float64)
    return pa.table({"first": pa.array([group.column("first")[0].as_py()], pa.int64()), "block": pa.array([total.tobytes()], pa.binary())})


def gram_product(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """AᵀA·Q of the sparse matrix whose rows are ``rows`` (``terms``, ``weights``)."""
    shared = rows.sparkSession.sparkContext.broadcast(q)     # terms of a benchmark block x directions
    parts = rows.mapInArrow(_product(shared), "first bigint, block binary")
    sums = parts.groupBy("first").applyInArrow(_add, "first bigint, block binary").toArrow()
    out = np.zeros_like(q)
    for first, block in zip(sums.column("first").to_pylist(), sums.column("block").to_pylist()):
        part = np.frombuffer(block, np.float64).reshape(-1, q.shape[1])
        out[first:first + len(part)] = part
    return out


def randomised_svd(rows: DataFrame, n_terms: int, dims: int = DIMS, oversample: int = OVERSAMPLE, power: int = POWER,
                   seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of A and their right singular vectors (n_terms x dims)."""
    width = min(n_terms, dims + oversample)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_terms, width)))[0]
    for _ in range(1 + power):
        q = np.linalg.qr(gram_product(rows, q))[0]
    values, turn = np.linalg.eigh(q.T @ gram_product(rows, q))
    order = np.argsort(-values)[:dims]
    return np.sqrt(np.maximum(values[order], 0)), q @ turn[:, order]


def _tfidf(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for batch in batches:
            vectors = [bench.vector(words_of(t)) for t in texts(batch, "text")]
            scaled = [(at, x / np.linalg.norm(x)) if len(x) else (at, x) for at, x in vectors]
            yield pa.RecordBatch.from_arrays([pa.array([at.tolist() for at, _ in scaled], pa.list_(pa.int32())),
                                              pa.array([x.tolist() for _, x in scaled], pa.list_(pa.float64()))],
                                             names=["terms", "weights"])

    return run


def sparse_scores(bench: Benchmark, terms: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """Exact products of ``n`` blocks (of the occurrences ``terms``) with the items that are posted."""
    size = (bench.post[1:] - bench.post[:-1])[terms]
    at = np.repeat(bench.post[terms] - np.cumsum(size) + size, size) + np.arange(size.sum())
    items = len(bench.latent)
    return np.bincount(np.repeat(block, size) * items + bench.posted[at], bench.share[at], n * items).reshape(n, items)


def block_scores(bench: Benchmark, terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Products of blocks (``terms`` cut at ``starts``) with all items."""
    out = np.zeros((len(starts), len(bench.latent)), np.float32)
    bounds = np.append(starts, len(terms))
    weighted = np.append(bench.idf[:-1] > 0, False)[terms]      # term -1 takes the last entry
    for a in range(0, len(starts), SLICE):
        edge = bounds[a:a + SLICE + 1]
        keep = np.flatnonzero(weighted[edge[0]:edge[-1]])
        if len(keep):
            block = np.searchsorted(edge, keep + edge[0], side="right") - 1
            first = np.flatnonzero(np.diff(block, prepend=-1))
            held = terms[edge[0]:edge[-1]][keep]
            if bench.latent.any():
                out[a + block[first]] = np.add.reduceat(bench.directions[held], first, axis=0) @ bench.latent.T
            if len(bench.posted):
                out[a:a + len(edge) - 1] += sparse_scores(bench, held, block, len(edge) - 1)
    return out


def pieces(bench: Benchmark, docs: list[np.ndarray]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Lots of ``(document, first word, terms)`` whose scores fit ``CELLS``; the pieces of a long document
    overlap by the widest window."""
    wide = widths(bench)[-1]
    most = max(CELLS // max(1, len(bench.latent)), 2 * wide)     # blocks of a lot
    lot, blocks = [], 0
    for d, terms in enumerate(docs):
        for first in range(0, max(1, len(terms) - wide * STRIDE), (most - wide) * STRIDE):
            part = terms[first:first + most * STRIDE]
            n = -(-len(part) // STRIDE)
            if lot and blocks + n > most:
                yield lot
                lot, blocks = [], 0
            lot.append((d, first, part))
            blocks += n
    if lot:
        yield lot


def widths(bench: Benchmark) -> list[int]:
    """Blocks of the windows: up to 4, and on until a window holds the longest item."""
    out = [1, 2, 4]
    while out[-1] * STRIDE < max(map(len, bench.words), default=0):
        out.append(2 * out[-1])
    return out


def candidates(bench: Benchmark, docs: list[np.ndarray], min_cosine: float) -> list[dict[int, list[tuple[float, int, int]]]]:
    """Per document and item the windows (cosine, first word, length) that reach the cosine, best first."""
    out: list[dict[int, list[tuple[float, int, int]]]] = [{} for _ in docs]
    for lot in pieces(bench, docs):
        size = np.array([len(t) for _, _, t in lot], np.int64)
        blocks = -(-size // STRIDE)
        owner = np.repeat(np.arange(len(lot)), blocks)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)     # block number in its piece
        base = np.cumsum(size) - size
        terms = np.concatenate([t for _, _, t in lot])
        starts = base[owner] + place * STRIDE
        score = block_scores(bench, terms, starts)
        energy = np.add.reduceat(bench.idf[terms] ** 2, starts) if len(starts) else np.zeros(0)
        items = np.arange(len(bench.words))
        for width in widths(bench):
            if width > 4:       # only items that a window of half the width does not hold
                long = np.array([len(bench.words[j]) > width // 2 * STRIDE for j in items], bool)
                items, score = items[long], score[:, long]
            if width > 1:       # the sum with the half that follows in the same piece
                half = width // 2
                more = np.flatnonzero(owner[:-half] == owner[half:]) if len(owner) > half else np.zeros(0, np.int64)
                grown, heat = score.copy(), energy.copy()
                grown[more] += score[more + half]
                heat[more] += energy[more + half]
                score, energy = grown, heat
            bar = (min_cosine * np.sqrt(np.maximum(energy, 1e-12))).astype(np.float32)
            for i, k in zip(*(x.tolist() for x in np.nonzero(score >= bar[:, None]))):
                d, before, part = lot[owner[i]]
                first = int(place[i]) * STRIDE
                n = min(width * STRIDE, len(part) - first)
                out[d].setdefault(int(items[k]), []).append((min(1.0, float(score[i, k] / bar[i] * min_cosine)), before + first, n))
    for found in out:
        for windows in found.values():
            windows.sort(key=lambda c: (-c[0], c[1], c[2]))
    return out


def matches(bench: Benchmark, docs: list[str], min_cosine: float, strong: float, weak: float):
    """``(document, item, cosine, lcs, answer, first word, words)`` of the items found in the texts."""
    words = [words_of(t) for t in docs]
    for d, by_item in enumerate(candidates(bench, [bench.terms(w) for w in words], min_cosine)):
        for j, found in sorted(by_item.items()):
            item, answer, seen = bench.words[j], bench.answers[j], []
            for cosine, first, n in found:
                start, end = max(0, first - len(item)), first + n + len(item)
                if any(s <= first and first + n <= e for s, e in seen):
                    continue                          # these words were compared already
                seen.append((start, end))
                near = words[d][start:end]
                share = lcs(item, near) / len(item)
                answered = bool(answer) and lcs(answer, near) >= ANSWER * len(answer)
                if share >= strong or share >= weak and answered:
                    yield d, j, cosine, share, answered, first, n
                    break


def _scan(shared, min_cosine: float, strong: float, weak: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = [(ids[d], bench.ids[j], *rest) for d, j, *rest in
                   matches(bench, texts(batch, "text"), min_cosine, strong, weak)]
            if out:
                types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                                 names=["doc_id", "item_id", "cosine", "lcs", "answer", "first_word", "n_words"])

    return run


def fit(docs: DataFrame, items: DataFrame, dims: int = DIMS) -> Benchmark:
    """Vectors of one benchmark block (``item_id, text, answer``; at most ``BLOCK_BYTES`` of text)."""
    sc = docs.sparkSession.sparkContext
    bench = Benchmark([tuple(r) for r in items.select("item_id", "text", "answer").collect()])
    if not bench.term:
        return bench
    bench.weigh(*corpus_counts(docs, bench, sc.broadcast(bench)))
    rows = cut_lineage(items.select("text").mapInArrow(_tfidf(sc.broadcast(bench)), "terms array<int>, weights array<double>"), "tfidf")
    bench.project(randomised_svd(rows, len(bench.term), dims)[1])
    return bench


def contaminated(docs: DataFrame, benchmark: DataFrame, min_cosine: float = MIN_COSINE, strong: float = STRONG,
                 weak: float = WEAK, dims: int = DIMS, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 answer_col: str | None = None) -> DataFrame:
    """One row per document and benchmark item found in it."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text"),
                             (F.col(answer_col) if answer_col else F.lit(None)).cast("string").alias("answer"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = spark.createDataFrame([], FOUND)
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        bench = fit(rows, part, dims)
        if bench.term:
            shared = spark.sparkContext.broadcast(bench)
            out = out.unionByName(map_batches(rows, _scan(shared, min_cosine, strong, weak), FOUND))
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows in which an item is found; they are told by id and text."""
    keyed = docs.select(F.xxhash64(id_col, text_col).alias("doc_id"), F.col(text_col).alias("text"))
    bad = cut_lineage(contaminated(keyed, benchmark, **options).select(F.col("doc_id").alias("__key")).distinct(), "contaminated")
    return docs.join(bad, F.xxhash64(id_col, text_col) == F.col("__key"), "left_anti")

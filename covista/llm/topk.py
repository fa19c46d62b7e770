"""Op 8: exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer weights by term (its component numbers).  Rows are numbered and
dealt by a hash of their number into candidate blocks of about ``block_rows`` rows; each block is
inverted into postings: per term, places in the block and weights.  Query rows are dealt into query
blocks in the same way.  Every query block meets every candidate block (a stated query set against all
rows, in blocks) in one cell of a grid: a row of the grid holds up to ``GROUP`` query blocks, a column up
to ``STREAM`` candidate blocks, so a candidate block is copied once a grid row and a query block once a
column, not once a pair.  A cell holds its query blocks and lets its candidate blocks pass.  A pair is
scored term by term: each query weight scatters the term's weighted postings into a dense score array,
from which the k best are taken by partition selection and merged into the query's best so far.  Per
query the cells' lists are merged by a ranked window.  Nothing is broadcast.

Defined results: rows whose vector is null or holds a null or non-finite component, or whose id is
null, take no part; an empty vector scores 0; a missing component counts as 0; rows that repeat an id
are rows of their own, as queries and as candidates, and only a query's own row is left out; sums are
64-bit; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, map_batches, shuffle_partitions

BLOCK_ROWS = 2048     # candidates a block: 16 KB of scores per query
QUERY_ROWS = 1024     # queries a block: 16 MB of scores per block pair
GROUP = 16            # query blocks of a cell, held: about 16 MB at 64 terms
STREAM = 64           # candidate blocks of a cell, one at a time
FIELDS = ["rows", "ids", "terms", "starts", "places", "weights", "width"]
BLOCK = "block int, rows binary, ids binary, terms binary, starts binary, places binary, weights binary, width string"


def weights(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``row, vec_id, w``: integer weights floor(scale * component) of the rows that take part, numbered."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & ~bad)
                   .select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("vec_id"),
                           F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("bigint")).alias("w")))


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block of the task: its ids in order and its postings sorted by term."""
    held, now = [], None

    def block():
        rows = pa.Table.from_batches(held).sort_by([("vec_id", "ascending"), ("row", "ascending")])
        numbers, ids = rows.column("row").to_numpy(), rows.column("vec_id").to_numpy()
        lists = rows.column("w").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.repeat(np.arange(len(ids), dtype=np.int32), size)
        ends = np.cumsum(size)
        term = (np.arange(len(flat)) - np.repeat(ends - size, size)).astype(np.int32)
        live = np.flatnonzero(flat)
        live = live[np.argsort(term[live], kind="stable")]
        terms, starts = np.unique(term[live], return_index=True)
        weights = flat[live]
        if len(weights):   # the narrowest integers that hold them
            weights = weights.astype(np.result_type(np.min_scalar_type(weights.min()), np.min_scalar_type(weights.max())))
            weights = weights if weights.dtype.kind == "i" else flat[live]
        parts = (numbers.astype(np.int64), ids.astype(np.int64), terms.astype(np.int32), np.append(starts, len(live)).astype(np.int32),
                 place[live].astype(np.int32 if len(ids) > 1 << 15 else np.int16), weights)
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in parts],
             pa.array([f"{parts[4].dtype.str} {weights.dtype.str}"])], names=["block", *FIELDS])

    for batch in batches:
        numbers = batch.column("block").to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(numbers)) + 1, [len(numbers)])) if len(numbers) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if numbers[a] != now:
                if held:
                    yield block()
                held, now = [], int(numbers[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield block()


def blocks(rows: DataFrame, n: int) -> DataFrame:
    """Rows dealt into ``n`` blocks by a hash of their number, one output row a block."""
    dealt = (rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))
                 .repartition(n, "block").sortWithinPartitions("block"))
    return cut_lineage(map_batches(dealt, _invert, BLOCK), "blocks")


def _arrays(row: dict):
    place, weight = row["width"].split()
    kinds = (np.int64, np.int64, np.int32, np.int32, np.dtype(place), np.dtype(weight))
    return [np.frombuffer(row[f], kind) for f, kind in zip(FIELDS, kinds)]


def score_blocks(queries, candidates) -> np.ndarray:
    """Dense scores (queries x candidates), accumulated term by term."""
    _, q_ids, q_terms, q_starts, q_places, q_weights = queries
    _, c_ids, c_terms, c_starts, c_places, c_weights = candidates
    scores = np.zeros((len(q_ids), len(c_ids)), np.int64)
    _, q_at, c_at = np.intersect1d(q_terms, c_terms, assume_unique=True, return_indices=True)
    for i, j in zip(q_at, c_at):
        places = c_places[c_starts[j]:c_starts[j + 1]]
        postings = c_weights[c_starts[j]:c_starts[j + 1]].astype(np.int64)
        for k in range(q_starts[i], q_starts[i + 1]):
            scores[q_places[k], places] += int(q_weights[k]) * postings
    return scores


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller place, found by partition selection."""
    if len(scores) <= k:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > edge)
    return np.concatenate((above, np.flatnonzero(scores == edge)[:k - len(above)]))


class Queries:
    """A query block with the best k candidates seen so far of each of its queries."""

    def __init__(self, arrays, k: int):
        self.arrays, self.k = arrays, k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(arrays[0])    # scores, ids

    def meet(self, candidates) -> None:
        scores = score_blocks(self.arrays, candidates)
        order = np.argsort(candidates[0])
        at = np.searchsorted(candidates[0][order], self.arrays[0])
        for i, number in enumerate(self.arrays[0]):
            got = best(scores[i], self.k + 1)   # one more, as the query's own row may be among them
            if at[i] < len(order) and candidates[0][order[at[i]]] == number:
                got = got[got != order[at[i]]]
            s = np.concatenate((self.found[i][0], scores[i, got]))
            ids = np.concatenate((self.found[i][1], candidates[1][got]))
            top = np.lexsort((ids, -s))[:self.k]
            self.found[i] = s[top], ids[top]

    def batch(self) -> pa.RecordBatch:
        n = [len(s) for s, _ in self.found]
        columns = [np.repeat(self.arrays[0], n), np.repeat(self.arrays[1], n),
                   *[np.concatenate([f[j] for f in self.found]) for j in (1, 0)]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "query_id", "vec_id", "score"])


def _score(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["across"], row["down"]) != now:
                    yield from (q.batch() for q in held)
                    now, held = (row["across"], row["down"]), []
                if row["candidate"]:
                    arrays = _arrays(row)
                    for q in held:
                        q.meet(arrays)
                else:
                    held.append(Queries(_arrays(row), k))
        yield from (q.batch() for q in held)

    return run


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id",
               vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of every query row
    (``is_query`` over ``vec_id``) with all other rows, ties to the smaller id."""
    rows = cut_lineage(weights(vectors, id_col, vector_col, scale), "weights")
    picked = rows.filter(is_query)
    n_rows, n_queries = rows.count(), picked.count()
    n_blocks, n_query_blocks = max(1, -(-n_rows // block_rows)), max(1, -(-n_queries // query_rows))
    c, q = blocks(rows, n_blocks), blocks(picked, n_query_blocks)
    down = -(-n_query_blocks // GROUP)
    across = min(n_blocks, max(-(-n_blocks // STREAM), -(-shuffle_partitions(vectors.sparkSession) // down)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = (q.select(F.lit(False).alias("candidate"), F.floor(F.col("block") / GROUP).cast("int").alias("down"),
                      every(across).alias("across"), "block", *FIELDS)
              .unionByName(c.select(F.lit(True).alias("candidate"), every(down).alias("down"),
                                    (F.col("block") % across).alias("across"), "block", *FIELDS)))
    dealt = (cells.repartition(down * across, "down", "across")
                  .sortWithinPartitions("down", "across", "candidate", "block"))
    found = map_batches(dealt, _score(k), "row bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
                 .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))

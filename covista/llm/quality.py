"""Op 4: quality score of documents by logistic regression over hashed word n-grams, trained with FTRL.

A text is cut into words and punctuation runs; unigrams, bigrams and trigrams of them are hashed into
2^18 buckets.  Words in capitals add an n-gram of their shape, and an n-gram that repeats one word is
also counted under one shared bucket, so that both carry over to unseen words.  Feature values are
square roots of counts scaled to unit length.

Training: a sample of labelled rows bounded by ``train_rows`` (a hash decides, the same rows at every
run) from the rows whose id is not held out.  They are dealt to tasks of about ``shard_rows`` rows, each
runs FTRL over its rows, and the shards' weights are averaged by bucket (parameter mixing).  The model has at most
2^18 weights, which bounds the broadcast.  Scoring is one pass over whole texts: a sparse dot product.

Defined results: null and empty texts score by the bias alone; rows without a usable label do not
train; a label that differs between rows of one id counts as the smaller; with no training rows, or an
empty table, every score is 0.5; repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, held_out, kept, map_batches, texts
from .ftrl import Ftrl, sigmoid

BITS = 18
SIZE = 1 << BITS
BIAS, REPEAT2, REPEAT3 = 0, 1, 2      # buckets of their own; n-grams hash to the others
TRAIN_ROWS = 12_000                   # expected number of labelled rows that train
SHARD_ROWS = 3000                     # expected training rows of a task
EPOCHS = 3
CUT = 0.3                             # a score from here on is predicted 1
PIECE = re.compile(r"\w+|[^\w\s]+")
CACHE = 400_000


class Hashes(dict):
    """Hash of a word, with a mark for its shape; forgotten when too many are held."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = xxhash.xxh32_intdigest(word.lower() + ("\x00U" if len(word) > 1 and word.isupper() else ""))
        self[word] = h
        return h


_UPPER = xxhash.xxh32_intdigest("\x00U")


def _bucket(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return 3 + ((h >> np.uint64(40)) % np.uint64(SIZE - 3)).astype(np.int64)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and values of a text."""
    words = PIECE.findall(text)
    h = np.fromiter(map(kept("word hashes", Hashes).__getitem__, words), np.uint64, len(words))
    grams = [_bucket(h)]
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    if upper:
        grams.append(np.repeat(_bucket(np.array([_UPPER], np.uint64)), upper))
    same = h[1:] == h[:-1]
    two = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    grams += [_bucket(two), np.full(int(same.sum()), REPEAT2)]
    if len(h) > 2:
        grams += [_bucket(two[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[2:]),
                  np.full(int((same[1:] & same[:-1]).sum()), REPEAT3)]
    at, count = np.unique(np.concatenate(grams), return_counts=True)
    value = np.sqrt(count)
    norm = np.sqrt(count.sum())
    return np.append(at, BIAS), np.append(value / norm if norm else value, 1.0)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, train_rows: int, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id, text, label`` of a hashed sample of about ``train_rows`` labelled rows that are not
    held out."""
    known = (labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
                   .groupBy(F.col(id_col).cast("bigint").alias("__id")).agg(F.min(label).cast("int").alias("__label")))
    share = min(1.0, train_rows / max(1, known.count()))
    picked = known.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    return (docs.join(picked, F.col(id_col).cast("bigint") == F.col("__id"))
                .select(F.col("__id").alias("doc_id"), F.col(text_col).alias("text"), F.col("__label").alias("label")))


def _train(epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += [(*features(t), y) for t, y in zip(texts(batch, "text"), batch.column("label").to_pylist())]
        if rows:
            w = Ftrl(SIZE).fit(rows, epochs).weights()
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64()),
                                              pa.array(np.full(len(at), len(rows)), pa.int64())], names=["bucket", "w", "rows"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array([BIAS], pa.int64()), pa.array([0.0]), pa.array([0], pa.int64())],
                                             names=["bucket", "w", "rows"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS,
          shard_rows: int = SHARD_ROWS, epochs: int = EPOCHS, **columns) -> np.ndarray:
    """The model: one weight per bucket, the mean of the shards' weights."""
    rows = cut_lineage(training_rows(docs, labels, label, train_rows, **columns), "training")
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.repartition(shards, F.xxhash64("doc_id")).sortWithinPartitions("doc_id", "text")
    parts = map_batches(dealt, _train(epochs), "bucket bigint, w double, rows bigint")
    mean = parts.groupBy("bucket").agg(F.sum("w").alias("w"))
    model = np.zeros(SIZE)
    got = mean.toArrow()                 # at most 2^18 rows
    model[got.column("bucket").to_numpy()] = got.column("w").to_numpy() / shards
    return model


def _score(model, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            scores = []
            for text in texts(batch, text_col):
                at, x = features(text)
                scores.append(float(sigmoid(w[at] @ x)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "__text"),
                                              pa.array(scores, pa.float64())],
                                             names=[*(c for c in batch.schema.names if c != "__text"), "__score"])

    return run


def score(docs: DataFrame, model: np.ndarray, out: str = "score", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``out``: the probability of label 1."""
    from pyspark.sql.types import DoubleType, StructType
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields]).add("__score", DoubleType())
    return (map_batches(docs, _score(shared, id_col, text_col), schema)
            .withColumnRenamed("__score", out))


def quality(docs: DataFrame, labels: DataFrame, cut: float = CUT, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = train(docs, labels, **options)
    return (score(docs.select("doc_id", "text"), model, "score")
            .select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= F.lit(cut)).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT, **options) -> DataFrame:
    """``docs`` without the rows predicted 0."""
    scored = score(docs, train(docs, labels, **options), "__quality")
    return scored.filter(F.col("__quality") >= F.lit(cut)).drop("__quality")

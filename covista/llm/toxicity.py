"""Op 3: toxicity categories by a classifier chain of linear models.

The categories are predicted one after the other.  Each has a logistic regression over the words of a
text and their stems (first letters), and over the probabilities of the categories before it.  While
training, those probabilities are out-of-fold: every training row is scored by a model that did not see
it, as it will be when the chain meets new texts; full models, trained on all training rows, score the
corpus.

Training rows are a hashed sample of about ``train_rows`` labelled rows that are not held out.  For
each category one job trains the models of all folds and the full one in parallel, a task each; their
sparse weights (at most ``folds`` + 1 times 2^18) are the only thing that reaches the driver.  Scoring
is one pass over whole texts: strong regularisation leaves few weights, and a word's weighted features
are remembered, so a document is a union over its distinct words.

Defined results: null and empty texts have the bias and the chain's features only; rows without a
usable label do not train; labels that differ between rows of one id count as the larger; without
training rows every probability is 0.5; repeated rows are scored each; an empty table gives an empty
table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import cut_lineage, held_out, map_batches, texts
from .ftrl import Ftrl, sigmoid

SIZE = 1 << 18
CHAIN = 32               # the first buckets belong to the bias and the chain
STEMS = (4, 5)
TRAIN_ROWS = 16_000        # expected number of labelled rows that train
FOLDS = 3
EPOCHS = 4
RATE = {"alpha": 1.0, "l1": 5.0}
CUT = 0.15
WORD = re.compile(r"[^\W\d_]+")
CACHE = 400_000


def word_features(word: str) -> list[int]:
    names = [word, *(word[:n] + "-" for n in STEMS if len(word) >= n)]
    return [CHAIN + xxhash.xxh32_intdigest(x) % (SIZE - CHAIN) for x in names]


def features(text: str) -> np.ndarray:
    """Distinct buckets of a text's words and stems; each has the value 1."""
    return np.unique(np.array([b for w in set(WORD.findall(text.lower())) for b in word_features(w)], np.int64))


def chain_features(before: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Bias and the log-odds of the earlier categories, within bounds."""
    p = np.clip(np.array(before, float), 1e-4, 1 - 1e-4)
    return np.arange(1 + len(p)), np.concatenate(([1.0], np.log(p / (1 - p)) / 4))


class Scorer:
    """A sparse model over texts that remembers the weighted features of words."""

    def __init__(self, at: np.ndarray, w: np.ndarray):
        self.chain = np.zeros(CHAIN)
        low = at < CHAIN
        self.chain[at[low]] = w[low]
        self.weight = dict(zip(at[~low].tolist(), w[~low].tolist()))
        self.words: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        if word not in self.words:
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[word] = tuple(b for b in word_features(word) if b in self.weight)
        return self.words[word]

    def probability(self, words: set[str], before: list[float]) -> float:
        found = set()
        for w in words:
            got = self.words.get(w)
            got = self.word(w) if got is None else got
            if got:
                found.update(got)
        at, x = chain_features(before)
        return float(sigmoid(sum(self.weight[b] for b in sorted(found)) + self.chain[at] @ x))


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], train_rows: int, folds: int,
                  id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, fold, y`` (one 0/1 label per category) of the sampled rows, as a written table."""
    names = list(categories)
    known = labels.select(F.col(id_col).cast("bigint").alias("__id"), *[c.cast("int").alias(n) for n, c in categories.items()])
    known = (known.filter(F.col("__id").isNotNull() & ~held_out(F.col("__id")))
                  .groupBy("__id").agg(*[F.max(n).alias(n) for n in names])
                  .filter(" and ".join(f"`{n}` in (0, 1)" for n in names)))
    share = min(1.0, train_rows / max(1, known.count()))
    draw = F.pmod(F.xxhash64("__id"), F.lit(1 << 30))
    picked = known.filter(draw < F.lit(int(share * (1 << 30)))).select(
        "__id", F.array(*names).alias("__y"), F.pmod(F.xxhash64("__id", F.lit("fold")), F.lit(folds)).cast("int").alias("__fold"))
    return cut_lineage(docs.join(picked, F.col(id_col).cast("bigint") == F.col("__id")).select(
        F.col("__id").alias("doc_id"), F.col(text_col).alias("text"), F.col("__fold").alias("fold"), F.col("__y").alias("y"),
        F.array().cast("array<double>").alias("before")), "training")


def _fit(category: int, epochs: int, rate: dict):
    def run(group: pa.Table) -> pa.Table:   # a bounded sample: about train_rows rows
        group, rows = group.sort_by([("doc_id", "ascending"), ("text", "ascending")]), []
        for text, y, before in zip(*(group.column(c).to_pylist() for c in ("text", "y", "before"))):
            at, x = chain_features(before)
            words = features(text or "")
            rows.append((np.concatenate((at, words)), np.concatenate((x, np.ones(len(words)))), y[category]))
        w = Ftrl(SIZE, **rate).fit(rows, epochs).weights()
        at = np.flatnonzero(w)
        return pa.table({"task": pa.array(np.full(len(at), group.column("task")[0].as_py()), pa.int32()),
                         "bucket": pa.array(at, pa.int64()), "w": pa.array(w[at], pa.float64())})

    return run


def fit_category(rows: DataFrame, category: int, folds: int, epochs: int, rate: dict) -> dict[int, tuple]:
    """Weights by task: task ``k`` < folds leaves fold k out, task ``folds`` takes all rows."""
    tasks = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda t: t != F.col("fold")))
    dealt = rows.select("doc_id", "text", "y", "before", tasks.alias("task"))
    by_task = dealt.groupBy("task").applyInArrow(_fit(category, epochs, rate), "task int, bucket bigint, w double")
    got = by_task.toArrow()     # at most (folds + 1) x 2^18 rows
    task, at, w = (got.column(c).to_numpy() for c in ("task", "bucket", "w"))
    return {k: (at[task == k], w[task == k]) for k in range(folds + 1)}


def _out_of_fold(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = {k: Scorer(*m) for k, m in models.value.items()}
        for batch in batches:
            before = [[*b, scorers[f].probability(set(WORD.findall(t.lower())), b)] for t, f, b in
                      zip(texts(batch, "text"), batch.column("fold").to_pylist(), batch.column("before").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "text", "fold", "y")),
                                              pa.array(before, pa.list_(pa.float64()))],
                                             names=["doc_id", "text", "fold", "y", "before"])

    return run


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], train_rows: int = TRAIN_ROWS,
                folds: int = FOLDS, epochs: int = EPOCHS, rate: dict | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> list[tuple]:
    """One sparse model ``(buckets, weights)`` per category, in the order of the chain."""
    rows = training_rows(docs, labels, categories, train_rows, folds, id_col, text_col)
    chain = []
    for c in range(len(categories)):
        models = fit_category(rows, c, folds, epochs, rate or RATE)
        chain.append(models[folds])
        if c + 1 < len(categories):
            shared = rows.sparkSession.sparkContext.broadcast(models)
            rows = cut_lineage(map_batches(rows, _out_of_fold(shared), rows.schema), "chain")
    return chain


def _predict(chain, n: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(*m) for m in chain.value]
        for batch in batches:
            out = []
            for text in texts(batch, text_col):
                words, p = set(WORD.findall(text.lower())), []
                for s in scorers:
                    p.append(s.probability(words, p))
                out.append(p)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([p[i] for p in out], pa.float64()) for i in range(n))],
                                             names=[*batch.schema.names, *(f"__p{i}" for i in range(n))])

    return run


def predict(docs: DataFrame, chain: list[tuple], names: list[str], text_col: str = "text") -> DataFrame:
    """``docs`` with one probability column per category."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    schema = StructType([*docs.schema.fields])
    for i in range(len(names)):
        schema = schema.add(f"__p{i}", DoubleType())
    out = map_batches(docs, _predict(shared, len(names), text_col), schema)
    for i, name in enumerate(names):
        out = out.withColumnRenamed(f"__p{i}", name)
    return out


def toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, **options) -> DataFrame:
    """``doc_id`` and one probability ``p_<category>`` per category, of every document.  By default the
    categories are those of the labels table: ``junk`` (quality 0), then ``toxic``."""
    categories = categories or {"junk": F.lit(1) - F.col("quality"), "toxic": F.col("toxic")}
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    chain = train_chain(docs, labels, categories, **options)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return predict(rows, chain, [f"p_{c}" for c in categories]).drop("text")

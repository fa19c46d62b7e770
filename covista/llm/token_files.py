"""Op 9: token ids of documents in files of Simple-8b blocks.

Writing: documents are range-partitioned and sorted by id; each task encodes its documents with a
public tokenizer, appends the end id to each, and packs whole documents into blocks.  A file row is
one block: shard, ids before the block in the shard, the documents and their lengths, and the packed
words with their sub-block offsets.  Spark's committer publishes the files, so a lost executor costs
only its open task.  Reading: blocks are decoded independently; a document's place in the whole
sequence is its shard's base (one row per shard) plus its place in the shard.

Defined results: a null text is empty; an empty text is the end id alone; a null id sorts first;
rows that repeat an id stay, ordered by text; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b, word_cuts
from .common import kept, map_batches, scratch_path, shuffle_partitions

END_ID = 1
BLOCK_IDS = 1 << 18      # a block is closed after this many ids; a longer document is one block
CACHE_WORDS = 1_200_000  # words remembered by a Python worker, in two halves
LINE_WORDS = 64          # new words encoded as one text
PUNCTUATION = ".,|!*$#%&"
DOTTED = "\u0130"        # the capital I with a dot
BLOCKS = "shard int, ids_before bigint, doc_ids array<bigint>, lens array<bigint>, payload binary"


def _cuts(data: np.ndarray, ends: np.ndarray, flags: np.ndarray) -> None:
    flags[:-1] = (data == word_cuts.SPACE) | (data == word_cuts.LINE_FEED)
    flags[word_cuts.marks_after_letters(data)] = True


class WordIds:
    """Ids of words by the tokenizer, as little-endian bytes, remembered across tasks of a worker.

    Texts are cut at spaces, line feeds and marks behind letters: this vocabulary's pattern drops white
    space and no match spans it, nor a letter and a mark behind it, so a text's ids are those of its words
    in order.  A plain word is one match of the
    pattern; it is looked up in lower case and without trailing punctuation, which the pattern
    separates from letters.  The new plain words of a batch are encoded as lines of text and cut after each
    id that ends a word.  The library's own threads stay off: a task has one core.

    Words are remembered in two halves: when the newer is full it becomes the older, and the older is
    forgotten but for the words that were met again.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _met(self, word: str) -> bool:
        """Whether either half holds the word; the newer one holds it then."""
        if word in self.known:
            return True
        ids = self.older.get(word)
        if ids is None:
            return False
        self.known[word] = ids
        return True

    def _each(self, words: list[str]) -> None:
        for word, got in zip(words, self.tokenizer.encode_batch(words, add_special_tokens=False)):
            self.known[word] = np.array(got.ids, "<u4").tobytes()

    def _plain(self, words: list[str]) -> None:
        lines = [words[i:i + LINE_WORDS] for i in range(0, len(words), LINE_WORDS)]
        found = self.tokenizer.encode_batch_fast([" ".join(line) for line in lines], add_special_tokens=False)
        for line, got in zip(lines, found):
            ids = np.array(got.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(line):
                self._each(line)
                continue
            at, data = 0, ids.tobytes()
            for word, end in zip(line, (4 * cuts).tolist()):
                self.known[word] = data[at:end]
                at = end

    def _learn(self, words: set[str]) -> None:
        """Words that the newer half does not hold."""
        known, older = self.known, self.older
        derived, plain, other = [], set(), set()
        for word in words:
            ids = older.get(word)
            if ids is not None:
                known[word] = ids
                continue
            core = word if word.isalpha() else word.rstrip(PUNCTUATION)
            # composed letters whose lower case is one letter; that of a dotted capital I is two
            if not core.isalpha() or not core.isascii() and (max(core) >= "\u0180" or DOTTED in core):
                other.add(word)
                continue
            low = core.lower()
            if low == word:
                plain.add(word)
                continue
            if not self._met(low):
                plain.add(low)
            tail = word[len(core):]
            if tail and not self._met(tail):
                other.add(tail)
            derived.append((word, low, tail))
        if plain:
            self._plain(list(plain))
        if other:
            self._each(list(other))
        for word, low, tail in derived:
            known[word] = known[low] + known[tail]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text."""
        if len(self.known) >= CACHE_WORDS // 2:
            self.older, self.known = self.known, {"": b""}
        found, firsts = word_cuts.segments(texts, _cuts)
        words = pc.utf8_ltrim(found.dictionary, " \n").to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, words))
        gaps = [i for i, got in enumerate(ids) if got is None]
        if gaps:
            self._learn({words[i] for i in gaps})
            for i in gaps:
                ids[i] = self.known[words[i]]
        return word_cuts.texts_of(ids, found, firsts)


def word_ids(path: str) -> WordIds:
    return kept(("words", path), lambda: WordIds(path))


def _pack(tokenizer: str, end_id: int, block_ids: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()
        words, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        docs, lens, held, size, before = [], [], [], 0, 0

        def block():
            ids = np.frombuffer(b"".join(held), "<u4").astype(np.uint64)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([before], pa.int64()),
                 pa.array([docs], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())),
                 pa.array([simple8b.encode(ids)], pa.binary())],
                names=["shard", "ids_before", "doc_ids", "lens", "payload"])

        for batch in word_cuts.joined(batches):
            for doc, ids in zip(batch.column(id_col).to_pylist(), words.encode(batch.column(text_col))):
                ids += end
                docs.append(doc)
                lens.append(len(ids) // 4)
                held.append(ids)
                size += lens[-1]
                if size >= block_ids:
                    yield block()
                    before += size
                    docs, lens, held, size = [], [], [], 0
        if docs:
            yield block()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID,
                      block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token files of ``docs`` to the folder ``path``, in ascending id order."""
    n = shuffle_partitions(docs.sparkSession)
    rows = (docs.select(F.col(id_col).cast("bigint").alias(id_col), text_col)
                .repartitionByRange(n, id_col).sortWithinPartitions(id_col, text_col))
    map_batches(rows, _pack(tokenizer, end_id, block_ids, id_col, text_col), BLOCKS).write.parquet(path)


def _unpack(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = simple8b.decode(row["payload"]).astype("<u4")
                ends = np.cumsum(np.array(row["lens"], np.int64))
                starts = ends - row["lens"]
                places = starts + row["ids_before"]
                if digest:
                    last = pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32),
                                                    pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * len(ends), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                     pa.array(places, pa.int64()), pa.array(row["lens"], pa.int64()), last],
                    names=["shard", "doc_id", "place", "n_tokens", "value"])

    return run


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Documents of token files: ``doc_id, start, n_tokens`` and ``ids``, or with ``digest`` the
    unsigned crc32 of the ids as little-endian 32-bit integers (``ids_crc32``)."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    value = "bigint" if digest else "array<bigint>"
    docs = map_batches(blocks, _unpack(digest), f"shard int, doc_id bigint, place bigint, n_tokens bigint, value {value}")
    # one row per shard: bounded by the number of partitions that wrote the files
    sizes = blocks.groupBy("shard").agg(F.sum(F.aggregate("lens", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return docs.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens",
        F.col("value").alias("ids_crc32" if digest else "ids"))


def token_ids(docs: DataFrame, tokenizer: str, path: str | None = None, digest: bool = False, **options) -> DataFrame:
    """Write ``docs`` as token files and read them back."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, **options)
    return read_token_files(docs.sparkSession, path, digest)

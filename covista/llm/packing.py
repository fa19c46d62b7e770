"""Op 12: best-fit packing of documents into training sequences.

Documents are encoded with a public tokenizer, get an end id, and only those longer than a sequence are
cut: into whole sequences behind a first piece that holds the rest.  The pieces are a written table, so
a lost executor repeats one task and no number changes.  A whole piece is a sequence of its own.  The
others, at most one a document, are dealt by a hash of their number into shards of about ``SHARD_PIECES`` pieces, and each
shard is packed by best fit decreasing: pieces from the longest to the shortest, each into the open bin
that it fills best, found by a segment tree over the remaining capacities.  A shard leaves at most
about one bin open, of thousands, and one shard packs as a single machine would.

Memory of a task is one shard: its pieces are shorter than a sequence, so ``SHARD_PIECES`` of 1,024 ids
are 64 MB.  Ids travel as little-endian unsigned 32-bit integers, as the consumer reads them.

Defined results: a null text is empty; an empty text is the end id alone; null and repeated document
ids stay, row by row; ties in length go by the pieces' number; extra columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_cuts
from .common import cut_lineage, kept, map_batches

END_ID = 2
LENGTH = 1024                 # tokens of a sequence
SHARD_PIECES = 1 << 14
CACHE_WORDS = 1_000_000       # words remembered by a Python worker, in two halves
LINE_WORDS = 64               # new words encoded as one text
SPACE, FEED = "Ġ", "Ċ"   # how the vocabulary writes a space and a line feed
PIECES = "key bigint, doc_id bigint, piece int, start bigint, ids binary"
PACKED = "doc_id bigint, piece int, start bigint, ids binary, sequence_id bigint, offset bigint"


def _cuts(data: np.ndarray, ends: np.ndarray, flags: np.ndarray) -> None:
    at = np.flatnonzero((data == word_cuts.SPACE) | (data == word_cuts.LINE_FEED))
    at = word_cuts.before_words(data, ends, at)
    flags[at] = True
    flags[at[data[at] == word_cuts.LINE_FEED] + 1] = True
    flags[word_cuts.marks_after_letters(data)] = True


class ByteLevelIds:
    """Ids of texts by a byte-level BPE tokenizer, as little-endian bytes.

    The vocabulary's pattern starts a match at white space right before anything else, and looks at
    nothing before it; a line feed there is a match of its own, and a run of letters ends a match.  So a
    text's ids are those of its parts between such places, and a part's ids are remembered across the
    tasks of a worker.  New parts are encoded as lines: those that begin with a space are cut at the
    ids that begin with it, the others at the line feeds between them.  Texts that hold a special token are
    encoded whole.

    Parts are remembered in two halves: when the newer is full it becomes the older, and the older is
    forgotten but for the parts that were met again.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.begins = np.array([t.startswith(SPACE) for t in tokens])
        self.feeds = np.array([t == FEED for t in tokens])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, parts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(got.ids, "<u4").tobytes() for got in found]

    def _learn(self, parts: Iterable[str]) -> None:
        """Parts that the newer half does not hold."""
        spaced, others, alone = [], [], []
        for part in parts:
            ids = self.older.get(part)
            if ids is not None:
                self.known[part] = ids
                continue
            word = part[1:] if part[0] == " " else part
            if word.split() != [word]:
                alone.append(part)
            elif word is part:
                others.append(word)
            else:
                spaced.append(word)
        self._encode_lines(spaced)
        self._encode_others(others)
        self.known.update(zip(alone, self._ids(alone)))

    def _encode_lines(self, words: list[str]) -> None:
        """Words behind a space."""
        lines = [words[i:i + LINE_WORDS] for i in range(0, len(words), LINE_WORDS)]
        for line, data in zip(lines, self._ids([" " + " ".join(line) for line in lines])):
            cuts = np.flatnonzero(self.begins[np.frombuffer(data, "<u4")])
            if len(cuts) != len(line):
                parts = [" " + w for w in line]
                self.known.update(zip(parts, self._ids(parts)))
                continue
            at = (4 * cuts).tolist() + [len(data)]
            for word, a, b in zip(line, at, at[1:]):
                self.known[" " + word] = data[a:b]

    def _encode_others(self, words: list[str]) -> None:
        """Words without white space, at the beginning of a text, of a line or behind another part."""
        lines = [words[i:i + LINE_WORDS] for i in range(0, len(words), LINE_WORDS)]
        for line, data in zip(lines, self._ids(["\n".join(line) for line in lines])):
            cuts = np.flatnonzero(self.feeds[np.frombuffer(data, "<u4")])
            if len(cuts) != len(line) - 1:
                self.known.update(zip(line, self._ids(line)))
                continue
            at = [-4, *(4 * cuts).tolist(), len(data)]
            for word, a, b in zip(line, at, at[1:]):
                self.known[word] = data[a + 4:b]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text."""
        if len(self.known) >= CACHE_WORDS // 2:
            self.older, self.known = self.known, {}
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        whole = np.zeros(len(column), bool)
        for token in self.special:
            whole |= pc.fill_null(pc.match_substring(column, token), False).to_numpy(zero_copy_only=False)
        alone = np.flatnonzero(whole).tolist()
        found, firsts = word_cuts.segments(pc.if_else(pa.array(whole), "", column) if alone else column, _cuts)
        parts = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, parts))
        gaps = [i for i, got in enumerate(ids) if got is None]
        if gaps:
            self._learn([parts[i] for i in gaps])
            for i in gaps:
                ids[i] = self.known[parts[i]]
        out = word_cuts.texts_of(ids, found, firsts)
        for i, got in zip(alone, self._ids([column[i].as_py() for i in alone])):
            out[i] = got
        return out


def cut_at(n: int, length: int) -> list[int]:
    """Borders of the pieces of ``n`` ids: only the first may be shorter than ``length``."""
    if n <= length:
        return [0, n]
    return [0, *range(n % length or length, n + 1, length)]


def _pieces(tokenizer: str, end_id: int, length: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        coder = kept(("bytes", tokenizer), lambda: ByteLevelIds(tokenizer))
        end, key = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 33
        for batch in word_cuts.joined(batches):
            docs, numbers, starts, cuts = [], [], [], []
            for doc, ids in zip(batch.column(id_col).to_pylist(), coder.encode(batch.column(text_col))):
                ids += end
                at = cut_at(len(ids) // 4, length)
                for i, (a, b) in enumerate(zip(at, at[1:])):
                    docs.append(doc)
                    numbers.append(i)
                    starts.append(a)
                    cuts.append(ids[4 * a:4 * b])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(key, key + len(docs)), pa.int64()), pa.array(docs, pa.int64()),
                 pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(cuts, pa.binary())],
                names=["key", "doc_id", "piece", "start", "ids"])
            key += len(docs)

    return run


class Capacities:
    """Open bins by remaining capacity, and a segment tree that counts them: a node holds the number of
    open bins of its range of capacities."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()     # capacities 0 to length
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(self.size)]

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def add(self, capacity: int, number: int) -> None:
        self.bins[capacity].append(number)
        self._change(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Take the open bin of the smallest capacity of at least ``need``: (capacity, bin)."""
        node, count = need + self.size, self.count
        if not count[node]:
            # up until a range to the right holds an open bin, then down to its smallest
            while node & 1 or not count[node + 1]:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._change(capacity, -1)
        return capacity, self.bins[capacity].pop()


def best_fit(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; the lengths must be falling and at most ``length``."""
    open_bins, n = Capacities(length), 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, need in enumerate(lengths.tolist()):
        found = open_bins.take(need)
        if found is None:
            capacity, number, n = length, n, n + 1
        else:
            capacity, number = found
        bins[i], offsets[i] = number, length - capacity
        if capacity > need:
            open_bins.add(capacity - need, number)
    return bins, offsets


def _pack(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def shard():
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = rows.column("key").to_numpy()
            lengths = pc.binary_length(rows.column("ids")).to_numpy().astype(np.int64) // 4
            order = np.lexsort((keys, -lengths))
            bins, offsets = best_fit(lengths[order], length)
            by_bin = np.lexsort((offsets, bins))
            rows = rows.take(pa.array(order[by_bin])).select(["doc_id", "piece", "start", "ids"])
            out = (rows.append_column("sequence_id", pa.array((now << 32) + bins[by_bin], pa.int64()))
                       .append_column("offset", pa.array(offsets[by_bin], pa.int64())))
            yield from out.to_batches(max_chunksize=2048)

        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(numbers)) + 1, [len(numbers)])) if len(numbers) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if numbers[a] != now:
                    if held:
                        yield from shard()
                    held, now = [], int(numbers[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from shard()

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, length: int = LENGTH,
         shard_pieces: int = SHARD_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``PACKED``: every piece with its ids (little-endian unsigned 32-bit integers), its sequence and its
    place there."""
    rows = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias(text_col))
    pieces = cut_lineage(map_batches(rows, _pieces(tokenizer, end_id, length, id_col, text_col), PIECES), "pieces")
    whole = F.octet_length("ids") == F.lit(4 * length)
    short = pieces.filter(~whole)
    n = max(1, -(-short.count() // shard_pieces))
    dealt = (short.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int"))
                  .repartition(n, "shard").sortWithinPartitions("shard"))
    packed = map_batches(dealt, _pack(length), PACKED)
    alone = pieces.filter(whole).select("doc_id", "piece", "start", "ids", (F.lit(-1) - F.col("key")).alias("sequence_id"),
                                        F.lit(0).cast("bigint").alias("offset"))
    return alone.unionByName(packed)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids``: the packed sequences, a row each of at most one sequence's ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return (packed.groupBy("sequence_id").agg(parts.alias("parts"))
                  .select("sequence_id", F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "").alias("ids"),
                          F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))
                  .withColumn("ids", F.unhex("ids")))


def report(packed: DataFrame) -> DataFrame:
    """Pieces with the length and unsigned crc32 of their ids in place of these."""
    return packed.select("doc_id", "piece", "start", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("length"),
                         F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")

"""Op 10: SentencePiece encoding and decoding by Aho-Corasick and Viterbi.

An Aho-Corasick automaton over a model's pieces is run once over the text; at every position its state
and output links give all pieces that end there, which relax the best score of that position from the
positions where they start.  The best segmentation, the one with the largest sum of piece scores (then
the longer last piece), is read back from the end.  A character that is no piece is an edge of its own
below every piece score, spelled in byte pieces.

Pieces hold the space mark at their front only, so no piece reaches over the end of a word: a text is
segmented word by word, which gives the segmentation of the whole, and a worker remembers words.  A
model with other pieces is segmented whole.  For a model of merge type the scores are merge ranks; the
result is their best sum, which need not be the order of merges, and decodes to the same text.

Defined results: null and empty texts have no ids and decode to the empty text; the space mark in a
text decodes as a space, as the model cannot tell them apart; control and unknown pieces are never
produced; an id outside the model raises; repeated rows are encoded each; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructType

from .common import kept, map_batches, texts

MARK = "▁"          # fixed value: the space mark
UNUSED = -1e8            # scores below this mark pieces that merges never make
CACHE = 800_000
WORD = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")


class Codec:
    """Encoder and decoder of one model file, with the words remembered as packed ids."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_id, self.spelled, pieces = {}, [b""] * n, {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.spelled[i] = bytes([int(piece[3:-1], 16)])
                self.bytes_id[self.spelled[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.spelled[i] = piece.encode()
                pieces[piece] = (i, model.get_score(i))
        if len(self.bytes_id) < 256:
            raise ValueError("the model has no byte pieces to spell unknown characters")
        self.build(ahocorasick, pieces)
        self.known: dict[str, bytes] = {"": b""}

    def build(self, ahocorasick, pieces: dict[str, tuple[int, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in pieces.items():
            self.automaton.add_word(piece, (i, len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.below = min((s for _, s in pieces.values() if s > UNUSED), default=0.0) - 10.0
        self.by_word = all(MARK not in p.lstrip(MARK) and "\n" not in p for p in pieces)

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation of a normalised text."""
        n = len(text)
        best, back = [0.0] + [float("-inf")] * n, [None] * (n + 1)
        single, below, at = self.single, self.below, 0
        for last, (i, length, score) in self.automaton.iter(text) if n else ():
            while at < last:                     # characters that are no piece, up to here
                at += 1
                if text[at - 1] not in single and best[at - 1] + below > best[at]:
                    best[at], back[at] = best[at - 1] + below, (-1, 1)
            end = last + 1
            value = best[end - length] + score
            if value > best[end] or value == best[end] and length > back[end][1]:
                best[end], back[end] = value, (i, length)
        while at < n:
            at += 1
            if text[at - 1] not in single and best[at - 1] + below > best[at]:
                best[at], back[at] = best[at - 1] + below, (-1, 1)
        ids, at = [], n
        while at:
            i, length = back[at]
            if i >= 0:
                ids.append(i)
            else:
                ids += [self.bytes_id[b] for b in reversed(text[at - 1].encode())]
            at -= length
        return ids[::-1]

    def words(self, text: str) -> list[str]:
        """The parts of a text that are segmented on their own, in normalised form."""
        if not text:
            return []
        line = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return [line]
        if MARK + MARK in line:
            return WORD.findall(line)
        return line.replace(MARK, " " + MARK).replace("\n", " \n ").split(" ")

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words, known = self.words(text), self.known
        got = list(map(known.get, words))
        if None in got:
            for j, (w, ids) in enumerate(zip(words, got)):
                if ids is None:
                    ids = known.get(w)
                    if ids is None:
                        if len(known) >= CACHE:
                            known.clear()
                            known[""] = b""
                        ids = np.array(self.segment(w), "<u4").tobytes()
                        known[w] = ids
                    got[j] = ids
        return b"".join(got)

    def decode(self, ids) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids)).decode(errors="replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def codec(path: str) -> Codec:
    return kept(("pieces", path), lambda: Codec(path))


def _encode(path: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [np.frombuffer(c.encode(t), "<u4").astype(np.int32) for t in texts(batch, text_col)]
            offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
            packed = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, packed], names=[*batch.schema.names, "__ids"])

    return run


def encode(docs: DataFrame, model: str, out: str = "ids", text_col: str = "text") -> DataFrame:
    """``docs`` with the ids of each text in the array column ``out``."""
    schema = StructType([*docs.schema.fields]).add("__ids", ArrayType(IntegerType()))
    return map_batches(docs, _encode(model, text_col), schema).withColumnRenamed("__ids", out)


def _decode(path: str, ids_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            out = [c.decode(i or ()) for i in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "__text"])

    return run


def decode(coded: DataFrame, model: str, out: str = "decoded", ids_col: str = "ids") -> DataFrame:
    """``coded`` with the text of each id array in the column ``out``."""
    schema = StructType([*coded.schema.fields]).add("__text", "string")
    return map_batches(coded, _decode(model, ids_col), schema).withColumnRenamed("__text", out)


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n, crc, same = [], [], []
            for text in texts(batch, "text"):
                ids = c.encode(text)
                n.append(len(ids) // 4)
                crc.append(zlib.crc32(ids))
                same.append(c.decode(np.frombuffer(ids, "<u4").tolist()) == text.replace(MARK, " "))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()),
                                              pa.array(same, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return run


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document the number of ids, the unsigned crc32 of the ids as little-endian 32-bit integers,
    and whether they decode to the text again."""
    schema = StructType().add("doc_id", LongType()).add("n_ids", LongType()).add("ids_crc32", LongType()).add("round_trip", BooleanType())
    return map_batches(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text"), _digest(model), schema)

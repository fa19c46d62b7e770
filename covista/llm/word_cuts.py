"""Texts cut into segments that a tokenizer may encode one by one, and their ids put together again.

The cuts are found on the bytes of a whole batch, and each different segment of the batch is looked up
once.  A cut is made only where no match of the vocabulary's pattern can lie on both sides and no match
looks back over it; what is not cut stays in one segment, so an odd text costs time and never an id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 2 << 20    # of the texts looked up together
SPACE, LINE_FEED = 32, 10

_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
# marks behind a letter that begin a segment; without | as special tokens hold one
_MARK = np.array([chr(b) in ".,!*$#%&" for b in range(256)])
# characters of U+00C0 to U+017F that are no letters or whose lower case ends with a combining mark
_NOT_LETTERS = np.array([int.from_bytes(c.encode()) for c in "×÷İ"])
_WHITE = [chr(c).encode() for c in range(0x3001) if chr(c).isspace()]
_WHITE_LEAD = np.isin(np.arange(256), [w[0] for w in _WHITE])
_WHITE_CODES = np.array([int.from_bytes(w.ljust(3, b"\0")) for w in _WHITE])
_WHITE_WIDTH = np.array([0xFF0000, 0xFFFF00, 0xFFFFFF])


def marks_after_letters(data: np.ndarray) -> np.ndarray:
    """Places of marks right behind a letter up to U+017F: a run of letters always ends a match."""
    at = np.flatnonzero(_MARK[data])
    at = at[at > 1]
    last, lead = data[at - 1], data[at - 2]
    pair = (lead.astype(np.int64) << 8) | last
    composed = (lead >= 0xC3) & (lead <= 0xC5) & (last >= 0x80) & ~np.isin(pair, _NOT_LETTERS)
    return at[_LETTER[last] | composed]


def before_words(data: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Those of the places ``at`` that are followed by a character other than white space in their text."""
    over = np.zeros(len(data) + 1, bool)
    over[ends] = True
    at = at[~over[at + 1]]
    unsure = _WHITE_LEAD[data[at + 1]]
    maybe = at[unsure]
    code = np.zeros(len(maybe), np.int64)
    for i in (1, 2, 3):
        code = (code << 8) | data[np.minimum(maybe + i, len(data) - 1)]
    white = np.zeros(len(maybe), bool)
    for width in _WHITE_WIDTH:
        white |= np.isin(code & width, _WHITE_CODES)
    return np.concatenate((at[~unsure], maybe[~white]))


def segments(texts: Iterable[str] | pa.Array, cuts: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The segments of all texts, and the number of each text's first one with the end behind.
    ``cuts(data, ends, flags)`` flags the bytes that begin a segment within a text."""
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    flags = np.zeros(len(data) + 1, bool)
    cuts(data, ends[1:], flags)
    flags[ends] = True
    flags[-1] = False
    starts = np.flatnonzero(flags)
    borders = np.append(starts, len(data)).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(data)))
    return found.dictionary_encode(), np.searchsorted(starts, ends)


def texts_of(ids: list[bytes], found: pa.DictionaryArray, firsts: np.ndarray) -> list[bytes]:
    """The ids of each text from those of each different segment."""
    spread = pa.array(ids, pa.large_binary()).take(found.indices)
    if not len(spread):
        return [b""] * (len(firsts) - 1)
    at = np.frombuffer(spread.buffers()[1], np.int64)[firsts].tolist()
    data = memoryview(spread.buffers()[2] or b"")
    return [bytes(data[a:b]) for a, b in zip(at, at[1:])]


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at least ``BATCH_BYTES``: more texts have fewer different words each."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BATCH_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)

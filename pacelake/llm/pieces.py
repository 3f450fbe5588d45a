"""Cut whole batches of text into the pieces that byte-level BPE merges within.

The split pattern tells apart four classes of characters, so the cuts follow from where the class
changes and can be found for many texts at once. Tests hold the result against the pattern itself.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa

LETTER, NUMBER, SPACE, OTHER = range(4)
SPACE_CHAR, APOSTROPHE = ord(" "), ord("'")

# The endings that the pattern splits off after an apostrophe.
SHORT_ENDINGS = ("s", "t", "m", "d")
LONG_ENDINGS = ("re", "ve", "ll")


class Pieces(NamedTuple):
    vocabulary: pa.Array
    """The distinct pieces, as binary."""
    index: np.ndarray
    """For each piece in order its place in ``vocabulary``."""
    starts: np.ndarray
    """For each text its first piece, and at the end the number of pieces."""


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        major = unicodedata.category(char)[0]
        if major == "L":
            kinds[point] = LETTER
        elif major == "N":
            kinds[point] = NUMBER
        elif char.isspace() and not 0x1C <= point <= 0x1F:
            kinds[point] = SPACE
    return kinds


def _contractions(points: np.ndarray, kinds: np.ndarray, run: np.ndarray, first: np.ndarray, cut: np.ndarray) -> None:
    """Move the cut behind an apostrophe to behind its ending."""
    marks = np.flatnonzero(points[:-1] == APOSTROPHE)
    marks = marks[cut[marks] & run[marks] & (kinds[marks + 1] == LETTER) & ~first[marks + 1]]
    after = points[marks + 1]
    beyond = points[np.minimum(marks + 2, len(points) - 1)]
    inside = (marks + 2 < len(points)) & ~first[np.minimum(marks + 2, len(points) - 1)]
    length = np.zeros(len(marks), dtype=np.int64)
    for ending in SHORT_ENDINGS:
        length[after == ord(ending)] = 2
    for ending in LONG_ENDINGS:
        length[(after == ord(ending[0])) & (beyond == ord(ending[1])) & inside] = 3
    marks, length = marks[length > 0], length[length > 0]
    cut[marks + 1] = False
    ends = marks + length
    cut[ends[ends < len(points)]] = True


def cut_pieces(texts: list[str]) -> Pieces:
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(points)
    text_starts = np.concatenate(([0], np.cumsum(lengths)))
    if not n:
        return Pieces(pa.array([], pa.large_binary()), np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64))
    kinds = classes()[points]
    first = np.zeros(n + 1, dtype=bool)
    first[text_starts] = True
    run = np.empty(n, dtype=bool)
    run[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=run[1:])
    run |= first[:-1]
    cut = run.copy()
    # The last white space before a word stands alone, or goes with the word if it is a blank.
    space = kinds == SPACE
    last = space & np.concatenate((run[1:], [True])) & ~first[1:]
    cut |= last
    blank = np.flatnonzero(last & (points == SPACE_CHAR))
    cut[blank + 1] = False
    if n > 1:
        _contractions(points, kinds, run, first[:-1], cut)
    begins = np.flatnonzero(cut)
    widths = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    byte_at = np.concatenate(([0], np.cumsum(widths, dtype=np.int64)))
    offsets = np.append(byte_at[begins], byte_at[-1])
    data = joined.encode("utf-8", "surrogatepass")
    pieces = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = pieces.dictionary_encode()
    before = np.concatenate(([0], np.cumsum(cut, dtype=np.int64)))
    return Pieces(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), before[text_starts])


def gather(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``flat[offsets[i]:offsets[i + 1]]`` of all i in ``index``, and where each begins."""
    sizes = (offsets[1:] - offsets[:-1])[index]
    begins = np.concatenate(([0], np.cumsum(sizes)))
    shift = np.repeat(offsets[index] - begins[:-1], sizes)
    return flat[np.arange(begins[-1]) + shift], begins

"""Best-fit packing of documents into sequences of a fixed number of tokens.

Bulk-synchronous best fit, longest first. Documents are range-sorted by length, so each has a rank
among those of its length, and open sequences are sorted by the gap they have left. A round places
all documents of one length at once: a sweep goes from the gap that just holds them to the next
larger ones, the document of rank r gets the r-th place of the sweep, the gaps are updated, and the
next length follows. Documents of one length are interchangeable, and so are sequences that were
filled alike; a round therefore moves runs of equal documents and runs of equal gaps, of which there
are only as many as lengths, whatever the size of the corpus. Spark counts and ranks the documents;
the rounds see a table of at most ``capacity`` counts; Spark then looks up every document's place
by length and rank.

Null text counts as empty; an empty document still has its end token. Repeated rows are packed
each. Null ids are packed like others. A very long text is encoded by one task and cut into pieces there.
Columns named ``piece``, ``start``, ``length``, ``ids``, ``sequence_id`` or ``offset`` are replaced by the results;
others pass through, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from pacelake.llm.common import Recent, free_names, slices
from pacelake.llm.pieces import cut_pieces, gather
from pacelake.operators.ordering import running_sum
from pacelake.session import staged

KNOWN_PIECES = 200_000
"""Encoded pieces of one generation; a worker remembers two generations at most, some 200 bytes a piece."""

SLICE_CHARS = 1_500_000
"""Text that a task encodes at once."""


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable
    and no blank, else the next one from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = (byte for byte in range(256) if byte not in plain)
    return {byte: chr(byte) for byte in plain} | {byte: chr(256 + n) for n, byte in enumerate(others)}


class Encoder:
    """A public byte-level tokenizer whose merges see each distinct piece of text once.

    As in the library, the strings of its added tokens become their ids and part the text around them.
    """

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        self.model = tokenizer.model
        added = {token.content: number for number, token in tokenizer.get_added_tokens_decoder().items()}
        if any(x.lstrip or x.rstrip or x.single_word or x.normalized for x in tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("only added tokens that stand for exactly their own string are known")
        self.added = added
        longest = sorted(added, key=len, reverse=True)
        self.apart = re.compile("|".join(map(re.escape, longest))) if added else None
        self.characters = byte_characters()
        self.known = Recent(KNOWN_PIECES)

    def _encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The packed ids of each piece."""
        tokenize, characters = self.model.tokenize, self.characters
        return {
            piece: array("I", [token.id for token in tokenize(piece.decode("latin-1").translate(characters))]).tobytes()
            for piece in pieces
        }

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin."""
        parts, behind, tokens, firsts = [], [], [], []
        for text in texts:
            firsts.append(len(parts))
            end = 0
            for found in self.apart.finditer(text) if self.apart else ():
                parts.append(text[end : found.start()])
                behind.append(len(parts))
                tokens.append(self.added[found.group()])
                end = found.end()
            parts.append(text[end:] if end else text)
        ids, begins = self._encode_plain(parts)
        firsts = np.array([*firsts, len(parts)], dtype=np.int64)
        behind = np.array(behind, dtype=np.int64)
        ids = np.insert(ids, begins[behind], np.array(tokens, dtype=ids.dtype))
        return ids, begins[firsts] + np.searchsorted(behind, firsts, side="right")

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = cut_pieces(texts)
        vocabulary = pieces.vocabulary.to_pylist()
        found, unknown = self.known.find_all(vocabulary)
        new = self._encode_pieces(unknown)
        self.known.keep_all(new)
        found |= new
        packed = [found[piece] for piece in vocabulary]
        flat = np.frombuffer(b"".join(packed), dtype=np.uint32)
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed], dtype=np.int64)))
        ids, begins = gather(flat, offsets, pieces.index)
        return ids, begins[pieces.starts]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, text_col: str, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Encode, end each document with ``end_id``, and cut what is longer than ``capacity``.

    Only the first piece of a document may be shorter. Replaces ``text_col`` by ``piece``, ``start``,
    ``length`` and ``ids`` (packed little-endian unsigned 32-bit integers).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        for batch in batches:
            texts = [x or "" for x in batch.column(text_col).to_pylist()]
            for a, b in slices(map(len, texts), SLICE_CHARS):
                ids, begins = coder.encode(texts[a:b])
                sizes = np.diff(begins) + 1
                # One end token behind the ids of each document.
                ended = np.insert(ids, begins[1:], end_id).astype("<u4")
                counts = -(-sizes // capacity)
                row = np.repeat(np.arange(b - a), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                head = sizes - (counts - 1) * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                offsets = np.concatenate(([0], np.cumsum(length))) * 4  # pieces follow each other
                binary = pa.Array.from_buffers(
                    pa.large_binary(), len(row), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ended)]
                ).cast(pa.binary())
                columns = {name: batch.column(name).slice(a, b - a).take(pa.array(row)) for name in names}
                yield pa.RecordBatch.from_pydict(columns | {
                    "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()), "ids": binary,
                })

    added = T.StructType().add("piece", "integer").add("start", "long").add("length", "long").add("ids", "binary")
    docs = docs.drop(*[name for name in added.names if name != text_col])
    kept = [field for field in docs.schema.fields if field.name != text_col]
    names = [field.name for field in kept]
    return docs.mapInArrow(run, T.StructType([*kept, *added.fields]))


class Gaps(NamedTuple):
    """A run of open sequences that were filled alike."""

    gap: int
    first: int
    count: int


class Places(NamedTuple):
    """Documents of ``length`` from rank ``rank`` on go to the sequences from ``first`` on, ``each``
    to a sequence, the first at ``offset``."""

    length: int
    rank: int
    first: int
    each: int
    offset: int


def plan(counts: dict[int, int], capacity: int) -> list[Places]:
    """The rounds, longest documents first; ``counts`` has the number of documents by length."""
    gaps: list[Gaps] = []
    placed: list[Places] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, Gaps(max(length, 1), -1, 0))
            run = gaps.pop(at) if at < len(gaps) else None
            if run is None:
                each = capacity // max(length, 1)
                run = Gaps(capacity, opened, -(-left // each))
                opened += run.count
            each = run.gap // max(length, 1)
            taken = min(left, run.count * each)
            placed.append(Places(length, rank, run.first, each, capacity - run.gap))
            full, rest = divmod(taken, each)
            filled = [(run.gap - each * length, full), (run.gap - rest * length, int(rest > 0))]
            filled.append((run.gap, run.count - full - int(rest > 0)))
            first = run.first
            for gap, count in filled:
                if count and gap:
                    insort(gaps, Gaps(gap, first, count))
                first += count
            rank, left = rank + taken, left - taken
    return placed


def pack_best_fit(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset``; lengths are 1 to ``capacity``.

    Rows come back from a table in the shared folder, so ``pieces`` is computed once.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    (row,) = free_names(pieces, "_row")
    numbered = staged(pieces.withColumn(row, F.monotonically_increasing_id()))
    narrow = numbered.select(F.col(row).alias("_row"), F.col(length_col).cast("long").alias("length"))
    ranked = running_sum(narrow, ["length"], ["_row"], F.lit(1).cast("long"), "_rank", max_group_rows=0)
    counts = {r[0]: r[1] for r in numbered.groupBy(length_col).count().collect()}  # at most ``capacity`` rows
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("lengths must be between 1 and the capacity")
    places = np.array(plan(counts, capacity), dtype=np.int64).reshape(-1, len(Places._fields))
    if len(places):
        places = places[np.lexsort((places[:, 1], places[:, 0]))]
    shared = spark.sparkContext.broadcast(places)
    span = 1 << 48

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, firsts, each, offsets = shared.value.T
        keys = lengths * span + ranks
        for batch in batches:
            length = batch.column(1).to_numpy(zero_copy_only=False)
            rank = batch.column(2).to_numpy(zero_copy_only=False) - 1
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            nth = rank - ranks[at]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(firsts[at] + nth // each[at]), pa.array(offsets[at] + nth % each[at] * length),
            ], ["_row", "sequence_id", "offset"])

    found = ranked.select("_row", "length", "_rank").mapInArrow(place, "_row long, sequence_id long, offset long")
    return numbered.join(found.withColumnRenamed("_row", row), row).drop(row)

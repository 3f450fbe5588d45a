"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

Every piece of text becomes token-position rows, one a byte at first. A recursive query joins
neighbouring rows with the merge table and contracts each piece's leftmost pair of least rank, until
no piece has a pair left. Decoding joins the vocabulary and aggregates in order.

Pieces are merged once per slice of text however often they occur, and a worker remembers those
of its recent slices, up to a bound. Nothing is shuffled, so a lost executor only costs its own tasks.

Null text counts as empty, empty text gives no ids, repeated rows are each encoded. Other columns
pass through; ``ids`` and ``bytes`` replace columns of those names.
"""

from __future__ import annotations

import base64
import functools
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacelake.llm.common import Recent, slices
from pacelake.llm.pieces import cut_pieces, gather

KNOWN_PIECES = 130_000
"""Merged pieces of one generation; a worker remembers two generations at most, some 200 bytes a piece."""

ROUND_ROWS = 500_000
"""States of one recursive query at most: a piece of n bytes has up to n * n / 2. Places stay below 2^21 so."""

NO_TOKEN = 2**32 - 1
"""Follows a piece's last token; no pair with it merges."""

LONG_PIECE = 128
"""Longer pieces, in bytes, are contracted query by query, all occurrences of a pair at once,
so that a run of a million letters needs neither a million rounds nor all its earlier states."""

SLICE_CHARS = 1_500_000
SLICE_TOKENS = 300_000
"""What a task encodes or decodes at once; a task may run both steps side by side."""

CONTRACT = """
WITH RECURSIVE step(w, p, q, pair, i) AS (
    SELECT w, p, q, pair, 0 FROM pieces
    UNION ALL
    SELECT * FROM (
        WITH least AS (
            SELECT s.w, min((m.merged::BIGINT << 42) | (s.p::BIGINT << 21) | s.q) AS b
            FROM step s JOIN merges m ON m.pair = s.pair GROUP BY s.w
        ), best AS (
            SELECT l.w, b >> 42 AS m, ((b >> 21) & 2097151)::INT AS h, t.p AS g, t.q, t.pair & 4294967295 AS n
            FROM least l JOIN step t ON t.p = (b & 2097151)::INT
        )
        SELECT s.w, s.p, CASE WHEN s.p = h THEN b.q ELSE s.q END,
            CASE WHEN s.p = h THEN (m << 32) | n WHEN s.q = h THEN (s.pair & -4294967296) | m ELSE s.pair END, s.i + 1
        FROM step s JOIN best b USING (w) WHERE s.p <> g
    )
)
SELECT s.w, (s.pair >> 32)::INT AS t FROM step s JOIN (SELECT w, max(i) AS i FROM step GROUP BY w) USING (w, i) ORDER BY s.p
"""
"""A row is a token of piece ``w`` at byte ``p`` of all pieces together: the next token's place ``q``, and ``pair``, both
tokens in one number. The least of merged rank, place and next place is a piece's next merge, in one number too."""

CONTRACT_LONG = """
WITH paired AS (
    SELECT s.p, s.t, m.merged AS m
    FROM (SELECT p, t, lead(t) OVER (ORDER BY p) AS n FROM long_piece) s
    LEFT JOIN merges m ON m.pair = (s.t::BIGINT << 32) | s.n
), marked AS (
    SELECT *, m = (SELECT min(m) FROM paired) AS hit FROM paired
), runs AS (
    SELECT *, row_number() OVER (ORDER BY p) - sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (ORDER BY p) AS run
    FROM marked
), cut AS (
    SELECT p, t, m, coalesce(hit AND row_number() OVER (PARTITION BY run, hit ORDER BY p) % 2 = 1, false) AS c FROM runs
)
SELECT p, CASE WHEN c THEN m ELSE t END AS t
FROM (SELECT *, coalesce(lag(c) OVER (ORDER BY p), false) AS gone FROM cut) WHERE NOT gone
"""

DECODE = """
SELECT d, string_agg(chars, '' ORDER BY p) AS chars FROM tokens JOIN vocabulary USING (t) GROUP BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank, one pair a line, the bytes in base 64."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Coder:
    """One worker's database with the merge table and the vocabulary."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.known = Recent(KNOWN_PIECES)
        self.db = duckdb.connect(config={
            "threads": 1, "memory_limit": "200MB", "temp_directory": tempfile.gettempdir() + "/bpe-spill",
        })
        self._keep("vocabulary", pa.table({
            "t": pa.array(list(self.ranks.values()), pa.int32()),
            # One character a byte: single tokens need not be valid UTF-8.
            "chars": pa.array([token.decode("latin-1") for token in self.ranks]),
        }))

    @functools.cached_property
    def merges(self) -> int:
        """Fills the merge table when it is first needed; the number of its rows."""
        splits = [
            (self.ranks[token[:i]], self.ranks[token[i:]], rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        ]
        left, right, merged = ([split[k] for split in splits] for k in range(3))
        self._keep("merges", pa.table({
            "pair": (np.array(left, dtype=np.int64) << 32) | np.array(right, dtype=np.int64), "merged": pa.array(merged, pa.int32()),
        }))
        return len(splits)

    def _keep(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _contract(self, pieces: list[bytes]) -> list[bytes]:
        assert self.merges >= 0
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        tokens = self.bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)].astype(np.int64)
        following = np.append(tokens[1:], NO_TOKEN)
        following[np.cumsum(lengths) - 1] = NO_TOKEN
        places = np.arange(len(tokens), dtype=np.int32)
        self.db.register("pieces", pa.table({
            "w": np.repeat(np.arange(len(pieces), dtype=np.int32), lengths),
            "p": places, "q": places + 1, "pair": (tokens << 32) | following,
        }))
        rows = self.db.sql(CONTRACT).to_arrow_table()
        self.db.unregister("pieces")
        ids = rows["t"].to_numpy().astype("<i4")
        ends = np.cumsum(np.bincount(rows["w"].to_numpy(), minlength=len(pieces)))
        return [ids[a:b].tobytes() for a, b in zip(np.concatenate(([0], ends[:-1])), ends, strict=True)]

    def _contract_long(self, piece: bytes) -> bytes:
        assert self.merges >= 0
        tokens = self.bytes[np.frombuffer(piece, dtype=np.uint8)]
        self._keep("long_piece", pa.table({"p": np.arange(len(tokens), dtype=np.int64), "t": tokens}))
        count = len(tokens)
        while True:
            self._keep("long_piece", self.db.sql(CONTRACT_LONG).to_arrow_table())
            left = self.db.sql("SELECT count(*) FROM long_piece").fetchall()[0][0]
            if left == count:
                break
            count = left
        ids = self.db.sql("SELECT t FROM long_piece ORDER BY p").to_arrow_table()
        return ids["t"].to_numpy().astype("<i4").tobytes()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, packed."""
        found, unknown = self.known.find_all(pieces)
        short = []
        for piece in unknown:
            if piece in self.ranks:
                found[piece] = np.int32(self.ranks[piece]).astype("<i4").tobytes()
            elif len(piece) > LONG_PIECE:
                found[piece] = self._contract_long(piece)
            else:
                short.append(piece)
        for a, b in slices([len(piece) ** 2 // 2 for piece in short], ROUND_ROWS):
            part = short[a:b]
            merged = dict(zip(part, self._contract(part), strict=True))
            found |= merged
            self.known.keep_all(merged)
        return [found[piece] for piece in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = cut_pieces(texts)
        packed = self.merge(pieces.vocabulary.to_pylist())
        flat = np.frombuffer(b"".join(packed), dtype="<i4")
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed], dtype=np.int64)))
        ids, begins = gather(flat, offsets, pieces.index)
        cuts = begins[pieces.starts]
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, packed: list[bytes]) -> list[bytes]:
        counts = np.array([len(x) // 4 for x in packed], dtype=np.int64)
        tokens = np.frombuffer(b"".join(packed), dtype="<i4")
        self.db.register("tokens", pa.table({
            "d": np.repeat(np.arange(len(packed), dtype=np.int32), counts),
            "p": np.arange(len(tokens), dtype=np.int64),
            "t": tokens,
        }))
        rows = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("tokens")
        out = [b""] * len(packed)
        for doc, chars in zip(rows["d"].to_pylist(), rows["chars"].to_pylist(), strict=True):
            out[doc] = chars.encode("latin-1")
        return out


@functools.cache
def coder(path: str) -> Coder:
    return Coder(path)


def _with_binary(df: DataFrame, name: str) -> T.StructType:
    kept = [field for field in df.schema.fields if field.name != name]
    return T.StructType([*kept, T.StructField(name, T.BinaryType())])


def encode(docs: DataFrame, text_col: str, ranks_path: str) -> DataFrame:
    """Replace ``text_col`` by ``ids``: little-endian unsigned 32-bit integers, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(text_col)
            sizes = [len(x) if x is not None else 0 for x in text.to_pylist()]
            for a, b in slices(sizes, SLICE_CHARS):
                part = batch.slice(a, b - a)
                texts = [x or "" for x in part.column(text_col).to_pylist()]
                columns = {name: part.column(name) for name in names}
                yield pa.RecordBatch.from_pydict(columns | {"ids": pa.array(coder(ranks_path).encode(texts), pa.binary())})

    docs = docs if text_col == "ids" else docs.drop("ids")
    names = [name for name in docs.columns if name != text_col]
    return docs.mapInArrow(run, _with_binary(docs.drop(text_col), "ids"))


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """Add ``bytes``, the bytes that ``ids`` stand for; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [x or b"" for x in batch.column("ids").to_pylist()]
            for a, b in slices([len(x) // 4 for x in packed], SLICE_TOKENS):
                part = batch.slice(a, b - a)
                columns = {name: part.column(name) for name in names}
                yield pa.RecordBatch.from_pydict(columns | {"bytes": pa.array(coder(ranks_path).decode(packed[a:b]), pa.binary())})

    tokens = tokens.drop("bytes")
    names = tokens.columns
    return tokens.mapInArrow(run, _with_binary(tokens, "bytes"))


def n_tokens(ids: str = "ids"):
    return (F.octet_length(ids) / 4).cast("long")

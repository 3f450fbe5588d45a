"""SimHash near-dedup with a pigeonring filter.

Fingerprints of 64 bits are linked if at most two bits differ. They are cut into a ring of three
segments, so the budget of a chain of n segments is 2n/3 bits: some segment starts a chain whose
first segment is equal, whose first two differ in at most one bit and whose three in at most two.
An equal first segment and one bit in the second leave one half of the second equal, so a
fingerprint is filed under (segment, half of the next): six keys of about 32 bits. Only fingerprints
that share a key meet; the chain is checked before the full distance.

Equal fingerprints are one node, so copies never form pairs. A key's fingerprints are compared in
one task up to ``max_bucket``, which gives a spanning forest instead of all links. Those of larger
keys get an exact way without pairs: two fingerprints are within two bits if and only if they share
a third within one bit of both, so each is filed under itself and its 64 neighbours, and each such
key, which can hold 65 fingerprints at most, links them to its least. Components come from
alternating star contraction.

Null or empty text, or one without words, has fingerprint zero and is linked like any other. A text
with fewer words than a shingle is one shingle. Repeated rows get the same component. A null id
never names a component; a component of null ids only has a null one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacelake.session import cut_lineage, staged

MAX_BITS = 2
SEGMENTS = ((42, 22), (21, 21), (0, 21))
"""Lowest bit and width of the ring's segments."""

MAX_BUCKET = 4096
"""Fingerprints under one key that one task compares; more take the exact way without pairs."""

HASH_SEED = 42
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle_words: int) -> int:
    """Bit i is set if more than half of the shingles' hashes have it set."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    n = max(1, len(words) - shingle_words + 1)
    first = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    last = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in zip(first, last, strict=True)), np.uint64, n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        block = hashes[at : at + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str, shingle_words: int) -> DataFrame:
    """Replace ``text_col`` by ``fingerprint``, a signed long with the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = (fingerprint(text.as_py(), shingle_words) for text in batch.column(text_col))
            bits = np.fromiter(marks, np.uint64, batch.num_rows).view(np.int64)
            columns = {name: batch.column(name) for name in names}
            yield pa.RecordBatch.from_pydict(columns | {"fingerprint": pa.array(bits)})

    docs = docs.drop(*["fingerprint"] if text_col != "fingerprint" else [])
    names = [name for name in docs.columns if name != text_col]
    return docs.mapInArrow(run, docs.drop(text_col).withColumn("fingerprint", F.lit(0).cast("long")).schema)


def _keys(bits: np.ndarray) -> np.ndarray:
    """The six keys of each fingerprint, in six rows."""
    keys = []
    for start in range(len(SEGMENTS)):
        low, width = SEGMENTS[start]
        next_low, next_width = SEGMENTS[(start + 1) % len(SEGMENTS)]
        segment = (bits >> np.uint64(low)) & np.uint64((1 << width) - 1)
        lower = next_width // 2
        for half, (at, size) in enumerate(((next_low, lower), (next_low + lower, next_width - lower))):
            part = (bits >> np.uint64(at)) & np.uint64((1 << size) - 1)
            keys.append((np.uint64(start * 2 + half) << np.uint64(40)) | (segment << np.uint64(size)) | part)
    return np.array(keys)


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = batch.column(0).to_numpy(zero_copy_only=False)
        keys = _keys(bits.view(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.T.reshape(-1).view(np.int64)), pa.array(np.repeat(bits, len(keys)))], ["key", "bits"]
        )


def _forest(key: int, bits: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that connect all of one key's fingerprints that the chain from this key allows."""
    start = (key >> 40) // 2
    low, width = SEGMENTS[(start + 1) % len(SEGMENTS)]
    second = np.uint64(((1 << width) - 1) << low)
    rest = bits
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            differ = rest ^ here
            near = np.flatnonzero(np.bitwise_count(differ & second) <= 1)  # budget of the chain of two
            near = near[np.bitwise_count(differ[near]) <= MAX_BITS]
            if len(near):
                found = rest[near]
                yield from ((int(here), int(other)) for other in found)
                queue.extend(found)
                rest = np.delete(rest, near)


def _link(max_bucket: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key. ``b`` is null for a fingerprint under a key that is too full."""

        def close(key: int, parts: list[np.ndarray], full: bool) -> tuple[list[int], list[int | None]]:
            bits = np.concatenate(parts).view(np.uint64)
            if full or len(bits) > max_bucket:
                return bits.view(np.int64).tolist(), [None] * len(bits)
            pairs = np.array(list(_forest(key, bits)), dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pairs[:, 0].tolist(), pairs[:, 1].tolist()

        def rows(key: int, parts: list[np.ndarray], full: bool) -> Iterator[pa.RecordBatch]:
            a, b = close(key, parts, full)
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        key, parts, full = None, [], False
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            bits = batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            bounds = np.concatenate(([0], cuts, [len(keys)]))
            wide = np.flatnonzero(np.diff(bounds) > 1)
            edge = {0, len(bounds) - 2}
            for g in sorted(edge | set(wide.tolist())) if len(keys) else []:
                here, part = int(keys[bounds[g]]), bits[bounds[g] : bounds[g + 1]]
                if here != key:
                    if key is not None and (full or sum(map(len, parts)) > 1):
                        yield from rows(key, parts, full)
                    key, parts, full = here, [], False
                parts.append(part)
                if sum(map(len, parts)) > max_bucket:
                    yield from rows(key, parts, True)
                    parts, full = [np.empty(0, np.int64)], True
        if key is not None and (full or sum(map(len, parts)) > 1):
            yield from rows(key, parts, full)

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.array([0, *(1 << bit for bit in range(64))], dtype=np.uint64)
    for batch in batches:
        bits = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(bits), 10_000):
            part = bits[at : at + 10_000]
            keys = part.view(np.uint64)[:, None] ^ flips
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(part, len(flips)))], ["key", "bits"]
            )


def links(nodes: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Pairs (a, b) of fingerprints that connect what is within two bits; ``nodes`` has distinct ones."""
    filed = nodes.mapInArrow(_file, "key long, bits long")
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut_lineage(
        filed.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(_link(max_bucket), "a long, b long")
    )
    near = found.filter("b IS NOT NULL")
    full = found.filter("b IS NULL").select("a").distinct()
    spread = full.mapInArrow(_neighbours, "key long, bits long")
    stars = spread.withColumn("least", F.min("bits").over(Window.partitionBy("key"))).filter("least < bits")
    return near.unionByName(stars.select(F.col("least").alias("a"), F.col("bits").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node it is connected with, for every node of ``edges`` (a, b)."""
    edges = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        # Large star: every larger neighbour moves to the least one.
        large = both.filter("b > a").join(least, "a").select(F.col("root").alias("a"), "b").filter("a < b").distinct()
        large = cut_lineage(large)
        # Small star: a node and its smaller neighbours move to the least one.
        root = large.groupBy("b").agg(F.min("a").alias("root"))
        moved = large.join(root, "b").select(F.col("root").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        edges = cut_lineage(moved.filter("a < b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def simhash_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 3,
    max_bucket: int = MAX_BUCKET,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each document: ``id_col``, the columns ``keep``, ``fingerprint`` (signed long),
    ``component`` (its least fingerprint) and ``component_id`` (its least id)."""
    marked = staged(fingerprints(docs.select(id_col, *keep, text_col), text_col, shingle_words))
    nodes = cut_lineage(marked.groupBy("fingerprint").agg(F.min(id_col).alias("least_id")))
    roots = components(links(nodes.select("fingerprint"), max_bucket))
    named = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = named.join(least, "root").select("fingerprint", F.col("root").alias("component"), "component_id")
    return marked.join(cut_lineage(classes), "fingerprint").select(id_col, *keep, "fingerprint", "component", "component_id")

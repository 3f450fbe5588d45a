"""Substring dedup: words covered by a passage that an earlier document also has are removed.

A passage is a window of ``window`` consecutive words. Suffix automata of reference shards find them: an
automaton holds the shard's reference texts with the least document of every substring, documents
are streamed through it, and where the matching statistic reaches the window length the state of
exactly that length tells the earliest document.

Sending every document past every shard would be quadratic, so shards are cut by content. Each window
has an anchor, the least hash among its runs of ``ANCHOR_WORDS`` words, which equal windows share; a
shard holds the texts of some anchors and only meets the stretches of documents with these.

1. Count for each anchor the least and the greatest document; those in one document only cannot
   belong to a repeated window. The others are noted in a bit map of fixed size, which is broadcast.
   If it fills up it lets more pass, never less.
2. Every stretch of windows with the same, noted anchor becomes an occurrence; its text is kept once for
   each batch, with the least document, so a passage in a third of all documents is combined before
   the shuffle.
3. Texts meet by anchor. If all stretches of an anchor have one text, every window of it is in the same documents
   and the text's least one is the answer. Other anchors are packed into shards of at most ``SHARD_WORDS`` words, each shard
   becomes an automaton, and its texts are streamed through it. An anchor with more text than that is
   compared window by window in an aggregation instead, whose groups hold one passage: equal windows are
   combined before the shuffle. One task streams the texts of an anchor, in pieces of at most that size.
4. Occurrences join the findings of their text, and documents join their removed windows.

Windows are judged on the input. A null id counts as greater than every other: such a document loses what
others have and takes nothing from anyone. Rows with equal ids take nothing from each other. Null text counts as
empty and stays null; text shorter than a window stays as it is. A very long text is cut into stretches by one
task. Columns ``n_words`` and ``n_removed`` are replaced by the results; others pass through, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacelake.llm.common import free_names, slices
from pacelake.session import staged

WINDOW = 13
ANCHOR_WORDS = 5
FILTER_BITS = 1 << 27
"""Size of the bit map, 16 MB, whatever the corpus."""
SHARD_WORDS = 50_000
SINGLES = 4_096
"""Findings of anchors with one text that go out together."""
LAST = (1 << 63) - 1
"""Stands for a null id."""

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mark(text: str | None) -> int:
    """Tells apart rows that share an id."""
    return xxhash.xxh64_intdigest((text or "").encode()) - (1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


_BYTES = _mixed(_mixed(np.arange(1, 257, dtype=np.uint64) * _ODD))
_BYTES[32] = 0
_POWERS = np.multiply.accumulate(np.full(4096, _ODD))
HASHED_WORDS = 1 << 15
"""Words whose bytes are hashed at once."""


def _word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word of ``data``, whose words are one blank apart; equal words have equal ones."""
    out = np.empty(len(begins), dtype=np.uint64)
    for a in range(0, len(begins), HASHED_WORDS):
        first, last = begins[a : a + HASHED_WORDS], ends[a : a + HASHED_WORDS]
        sizes = last - first + 1  # with the blank behind, which counts as zero
        sizes[-1] -= 1
        at = np.arange(first[0], last[-1]) - np.repeat(first, sizes)
        weighted = _BYTES[data[first[0] : last[-1]]] * _POWERS[at & (len(_POWERS) - 1)]
        out[a : a + HASHED_WORDS] = np.add.reduceat(weighted, first - first[0])
    return _mixed(out)


def _first_least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the first of the least among each ``width`` neighbours is; spans double until two cover the width."""
    lowest, where, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        lower = lowest[step:] < lowest[:-step]
        where = np.where(lower, where[step:], where[:-step])
        lowest = np.where(lower, lowest[step:], lowest[:-step])
        span += step
    return where


class Stretches:
    """The words of several texts, and their stretches of windows with one anchor."""

    def __init__(self, texts: list[str | None], window: int):
        encoded = [text.encode() if text else b"" for text in texts]
        raw = np.frombuffer(b" ".join(encoded), dtype=np.uint8)
        white = (raw == 32) | ((raw >= 9) & (raw <= 13))
        behind_white = np.concatenate(([True], white[:-1]))[: len(raw)]
        opens = ~white & behind_white
        upto = np.cumsum(np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded)) + 1)[:-1]
        words = np.flatnonzero(opens)
        n = len(words)
        self.begins = np.concatenate(([0], np.searchsorted(words, upto), [n])) if texts else np.zeros(1, np.int64)
        # All words in a row, one blank apart.
        data = np.where(white, np.uint8(32), raw)[~(white & behind_white)]
        blanks = np.flatnonzero(data == 32)
        self.word_begins = np.concatenate(([0], blanks + 1))[:n]
        self.word_ends = np.append(blanks, len(data))[:n]
        self.data = data.tobytes()
        k = min(ANCHOR_WORDS, window)
        self.doc = self.first = self.windows = np.empty(0, np.int64)
        self.anchor = np.empty(0, np.uint64)
        if n < window:
            return
        hashes = _word_hashes(data, self.word_begins, self.word_ends)
        runs = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            runs = _mixed(runs + hashes[j : n - k + 1 + j])
        starts = np.arange(n - window + 1)
        doc = np.repeat(np.arange(len(texts)), np.diff(self.begins))[: len(starts)]
        inside = starts + window <= self.begins[doc + 1]
        least = _first_least(runs, window - k + 1)
        starts, doc, least = starts[inside], doc[inside], least[inside]
        if not len(starts):
            return
        new = np.concatenate(([True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)))
        at = np.flatnonzero(new)
        self.doc, self.first, self.anchor = doc[at], starts[at], runs[least[at]]
        self.windows = np.diff(np.append(at, len(starts)))

    def texts_of(self, first: np.ndarray, behind: np.ndarray) -> list[bytes]:
        """Words ``first`` to ``behind``, one blank apart."""
        data = self.data
        return [data[a:b] for a, b in zip(self.word_begins[first].tolist(), self.word_ends[behind - 1].tolist(), strict=True)]


def _anchor_ranges(window: int, id_at: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(id_at).fill_null(LAST).to_numpy(zero_copy_only=False)
            texts = batch.column(text_at).to_pylist()
            for a, b in slices(len(x or "") for x in texts):
                found = Stretches(texts[a:b], window)
                owners = ids[a:b][found.doc]
                order = np.lexsort((owners, found.anchor))
                anchors, owners = found.anchor[order], owners[order]
                begins = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1]))) if len(order) else order
                ends = np.append(begins[1:], len(order)) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors[begins].view(np.int64)), pa.array(owners[begins]), pa.array(owners[ends] if len(order) else owners)],
                    ["anchor", "low", "high"],
                )

    return run


def _filter(docs: DataFrame, window: int, bits: int) -> np.ndarray:
    """The bit map of anchors that occur in several documents."""
    ranges = docs.mapInArrow(_anchor_ranges(window, 0, 1), "anchor long, low long, high long")
    shared = ranges.groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high")
    slot = F.pmod("anchor", F.lit(bits))
    bit = F.expr("shiftleft(1L, cast(slot % 64 as int))")
    rows = shared.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    found = rows.toArrow()  # at most one row for 64 bits
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _occurrences(window: int, shared, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with ``doc`` are occurrences, those with ``text`` distinct texts of this slice."""
        noted = shared.value
        for batch in batches:
            ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            for a, b in slices(len(x or "") for x in texts):
                found = Stretches(texts[a:b], window)
                slots = np.mod(found.anchor.view(np.int64), bits).astype(np.uint64)
                hit = (noted[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) > 0
                doc, first, anchor = found.doc[hit], found.first[hit], found.anchor[hit].view(np.int64)
                ends = first + found.windows[hit] + window - 1
                kept = found.texts_of(first, ends)
                keys = np.fromiter(map(xxhash.xxh64_intdigest, kept), dtype=np.uint64, count=len(kept)).view(np.int64)
                owners = ids[a:b][doc]
                marks = np.fromiter(map(_mark, texts[a:b]), dtype=np.int64, count=b - a)[doc]
                order = np.lexsort((owners, keys, anchor))
                same = (anchor[order][1:] == anchor[order][:-1]) & (keys[order][1:] == keys[order][:-1])
                one = order[np.concatenate(([True], ~same))] if len(order) else order
                none = pa.nulls(len(doc), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(keys), pa.array(owners), pa.array(marks), pa.array((first - found.begins[doc]).astype(np.int32)), none], _OCCURRENCE.names
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[one]), pa.array(keys[one]), pa.array(owners[one]), pa.nulls(len(one), pa.int64()), pa.nulls(len(one), pa.int32()), pa.array([kept[i].decode() for i in one.tolist()], pa.string())], _OCCURRENCE.names
                )

    return run


_OCCURRENCE = (
    T.StructType().add("anchor", "long").add("key", "long").add("doc", "long").add("mark", "long").add("first", "integer").add("text", "string")
)


class Automaton:
    """Suffix automaton of several texts; each state knows the least document of its substrings."""

    def __init__(self) -> None:
        self.onward: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.least = [LAST + 1]

    def _state(self, length: int, onward: dict[str, int], link: int) -> int:
        self.onward.append(onward)
        self.length.append(length)
        self.link.append(link)
        self.least.append(LAST + 1)
        return len(self.link) - 1

    def _split(self, state: int, word: str, target: int) -> int:
        """A copy of ``target`` for the substrings that end behind ``state``."""
        copy = self._state(self.length[state] + 1, dict(self.onward[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.onward[state].get(word) == target:
            self.onward[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: list[str], doc: int) -> None:
        onward, link, length, least = self.onward, self.link, self.length, self.least
        last = 0
        for word in words:
            target = onward[last].get(word)
            if target is not None:
                last = target if length[target] == length[last] + 1 else self._split(last, word, target)
            else:
                state = self._state(length[last] + 1, {}, 0)
                while last >= 0 and word not in onward[last]:
                    onward[last][word] = state
                    last = link[last]
                if last >= 0:
                    target = onward[last][word]
                    link[state] = target if length[target] == length[last] + 1 else self._split(last, word, target)
                last = state
            if doc < least[last]:
                least[last] = doc

    def finish(self) -> None:
        """A substring ends wherever a longer one does that it is a suffix of."""
        link, least = self.link, self.least
        for state in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            parent = link[state]
            if least[state] < least[parent]:
                least[parent] = least[state]

    def earliest(self, words: list[str], window: int) -> list[int]:
        """Stream ``words``: for each window the least document that has it."""
        onward, link, length, least = self.onward, self.link, self.length, self.least
        state = matched = 0
        out = []
        for n, word in enumerate(words, 1):
            while state and word not in onward[state]:
                state = link[state]
                matched = length[state]
            if word in onward[state]:
                state = onward[state][word]
                matched += 1
            while length[link[state]] >= window if state else False:
                state = link[state]
                matched = length[state]
            if n >= window:
                out.append(least[state] if matched >= window else LAST)
        return out


def _search(window: int, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor and key. ``earliest`` is null where an anchor has too much text."""

        def answer(shard: dict[tuple[int, int], tuple[str, int]]) -> pa.RecordBatch:
            automaton = Automaton()
            split = {key: text.split(" ") for key, (text, _) in shard.items()}
            for key, words in split.items():
                automaton.add(words, shard[key][1])
            automaton.finish()
            found = [automaton.earliest(words, window) for words in split.values()]
            return pa.RecordBatch.from_pydict({
                "anchor": pa.array([key[0] for key in shard], pa.int64()), "key": pa.array([key[1] for key in shard], pa.int64()),
                "earliest": pa.array(found, pa.list_(pa.int64())), "text": pa.nulls(len(shard), pa.string()), "doc": pa.nulls(len(shard), pa.int64()),
            })

        def overflow(group: dict[tuple[int, int], tuple[str, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "anchor": pa.array([key[0] for key in group], pa.int64()), "key": pa.array([key[1] for key in group], pa.int64()),
                "earliest": pa.nulls(len(group), pa.list_(pa.int64())), "text": pa.array([text for text, _ in group.values()]),
                "doc": pa.array([doc for _, doc in group.values()], pa.int64()),
            })

        def alone(texts: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
            """Anchors with one text: each of its windows is in just the documents that have the text."""
            sizes = [n for *_, n in texts]
            earliest = np.repeat(np.array([doc for _, _, doc, _ in texts], dtype=np.int64), sizes)
            return pa.RecordBatch.from_pydict({
                "anchor": pa.array([anchor for anchor, *_ in texts], pa.int64()), "key": pa.array([key for _, key, *_ in texts], pa.int64()),
                "earliest": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(earliest)),
                "text": pa.nulls(len(texts), pa.string()), "doc": pa.nulls(len(texts), pa.int64()),
            })

        single: list[tuple[int, int, int, int]] = []
        shard: dict[tuple[int, int], tuple[str, int]] = {}
        group: dict[tuple[int, int], tuple[str, int]] = {}
        shard_size = group_size = 0
        here, wide = None, False
        for batch in batches:
            for anchor, key, doc, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if anchor != here:
                    if wide and group:
                        yield overflow(group)
                    elif len(group) == 1:
                        ((owner, only), (_, least)), = group.items()
                        single.append((owner, only, least, group_size - window + 1))
                        if len(single) >= SINGLES:
                            yield alone(single)
                            single = []
                    elif group:
                        if shard_size + group_size > shard_words and shard:
                            yield answer(shard)
                            shard, shard_size = {}, 0
                        shard |= group
                        shard_size += group_size
                    here, wide, group, group_size = anchor, False, {}, 0
                known = group.get((anchor, key))
                if known:
                    group[anchor, key] = (text, min(doc, known[1]))
                    continue
                group[anchor, key] = (text, doc)
                group_size += text.count(" ") + 1
                if group_size > shard_words:
                    wide, group_size = True, 0
                    yield overflow(group)
                    group = {}
        if wide and group:
            yield overflow(group)
        elif group:
            shard |= group
        if shard:
            yield answer(shard)
        if single:
            yield alone(single)

    return run


_FINDING = "anchor long, key long, earliest array<long>, text string, doc long"


def _by_window(rows: DataFrame, window: int) -> DataFrame:
    """The findings of texts whose anchor has too much text for an automaton, by aggregation."""
    words = rows.groupBy("anchor", "key", "text").agg(F.min("doc").alias("doc")).withColumn("words", F.split("text", " "))
    starts = F.sequence(F.lit(1), F.size("words") - (window - 1))
    each = words.select("anchor", "key", "doc", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, window), " "))).alias("nth", "passage"))
    least = each.groupBy("passage").agg(F.min("doc").alias("least"))
    found = each.join(least, "passage").groupBy("anchor", "key").agg(F.sort_array(F.collect_list(F.struct("nth", "least"))).alias("w"))
    return found.select("anchor", "key", F.col("w.least").alias("earliest"))


def removed_windows(docs: DataFrame, window: int = WINDOW, bits: int = FILTER_BITS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc``, ``mark`` and ``starts``, the first words of the windows to remove; ``docs`` has an id and a text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_filter(docs, window, bits))
    rows = docs.mapInArrow(_occurrences(window, shared, bits), _OCCURRENCE)
    rows = staged(rows, compression="zstd")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = rows.filter("text IS NOT NULL").select("anchor", "key", "doc", "text")
    met = texts.repartition(partitions, "anchor").sortWithinPartitions("anchor", "key")
    found = staged(met.mapInArrow(_search(window, shard_words), _FINDING))
    findings = found.filter("earliest IS NOT NULL").select("anchor", "key", "earliest")
    wide = found.filter("earliest IS NULL")
    if wide.limit(1).count():
        findings = findings.unionByName(_by_window(wide, window))
    places = rows.filter("text IS NULL").select("anchor", "key", "doc", "mark", "first")
    starts = F.filter(F.transform("earliest", lambda least, i: F.when(least < F.col("doc"), F.col("first") + i)), lambda x: x.isNotNull())
    hits = places.join(findings, ["anchor", "key"]).select("doc", "mark", starts.alias("starts")).filter("size(starts) > 0")
    return hits.groupBy("doc", "mark").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def _cut(text: str, starts: list[int] | None, window: int, normalise: bool) -> tuple[str, int, int]:
    """The text without the covered words, its number of words, and how many were removed."""
    data = text.encode()
    words = data.split()
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    if starts:
        at = np.unique(np.array(starts))
        covered[at] += 1
        np.subtract.at(covered, at + window, 1)
    gone = np.cumsum(covered)[: len(words)] > 0
    n = int(gone.sum())
    if normalise:
        return b" ".join(word for word, out in zip(words, gone.tolist(), strict=True) if not out).decode(), len(words), n
    if not n:
        return text, len(words), 0
    out, place, copied = [], 0, 0
    for word, drop in zip(words, gone.tolist(), strict=True):
        begin = data.index(word, place)
        place = begin + len(word)
        if drop:
            out.append(data[copied:begin])
            # The white space behind a removed word goes with it.
            copied = _behind(data, place)
    out.append(data[copied:])
    return b"".join(out).decode(), len(words), n


def _behind(data: bytes, at: int) -> int:
    while at < len(data) and data[at] in b" \t\n\r\x0b\x0c":
        at += 1
    return at


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    normalise: bool = False,
    bits: int = FILTER_BITS,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``docs`` with the repeated passages cut from ``text_col``, and ``n_words`` and ``n_removed``.

    With ``normalise`` the kept words are joined by one blank; else what stays is left as it is.
    """
    removed = removed_windows(docs.select(F.col(id_col).cast("long"), F.col(text_col)), window, bits, shard_words)
    docs = docs.drop("n_words", "n_removed")
    names = docs.columns
    packed_col, doc_col, mark_col, starts_col = free_names(docs, "_packed", "_doc", "_mark", "_starts")
    packed_fields = [T.StructField(packed_col, T.BinaryType()) if f.name == text_col else f for f in docs.schema.fields]
    packed_schema = T.StructType([*packed_fields, T.StructField(doc_col, T.LongType()), T.StructField(mark_col, T.LongType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts travel compressed."""
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            columns = {name: batch.column(name) for name in names if name != text_col}
            columns[packed_col] = pa.array([None if x is None else press.compress(x.encode()) for x in texts], pa.binary())
            columns[doc_col] = batch.column(id_col).cast(pa.int64()).fill_null(LAST)
            columns[mark_col] = pa.array([_mark(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_pydict({field.name: columns[field.name] for field in packed_schema.fields})

    joined = docs.mapInArrow(pack, packed_schema).join(
        removed.select(F.col("doc").alias(doc_col), F.col("mark").alias(mark_col), F.col("starts").alias(starts_col)), [doc_col, mark_col], "left"
    ).select(*[f.name for f in packed_fields], starts_col)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            packed = [x.as_py() for x in batch.column(packed_col)]
            starts = batch.column(starts_col)
            size = max(1, len(packed) // 16)
            for a in range(0, len(packed), size):
                rows = [
                    (None, 0, 0) if x is None else _cut(open_.decompress(x).decode(), starts[a + n].as_py(), window, normalise)
                    for n, x in enumerate(packed[a : a + size])
                ]
                columns = {name: batch.column(name).slice(a, size) for name in names if name != text_col}
                columns[text_col] = pa.array([row[0] for row in rows], pa.string())
                columns["n_words"] = pa.array([row[1] for row in rows], pa.int64())
                columns["n_removed"] = pa.array([row[2] for row in rows], pa.int64())
                yield pa.RecordBatch.from_pydict({name: columns[name] for name in [*names, "n_words", "n_removed"]})

    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(unpack, schema)


ORACLE_SQL = f"""
WITH t AS (
    SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents
), w AS (
    SELECT k, doc_id, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS passage
    FROM (SELECT k, doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM t)
), f AS (
    SELECT passage, min(doc_id) AS first_doc FROM w GROUP BY passage
), gone AS (
    SELECT DISTINCT k, i + j AS n FROM w JOIN f USING (passage), (SELECT unnest(range({WINDOW})) AS j)
    WHERE first_doc < doc_id OR (doc_id IS NULL AND first_doc IS NOT NULL)
), each AS (
    SELECT k, unnest(range(1, len(words) + 1)) AS n, unnest(words) AS word FROM t
), kept AS (
    SELECT k, string_agg(word, ' ' ORDER BY n) AS text, count(*) AS n_kept FROM each ANTI JOIN gone USING (k, n) GROUP BY k
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (k)
"""

"""Source divergence audit: how far each source's use of words is from the other sources of its language.

Terms are runs of ASCII letters and other non-ASCII characters, only A-Z lower-cased. A language keeps the
terms that at least ``MIN_DOCS`` of its documents hold. A group (language, source) gives each kept term the
share p = 1 + floor(SCALE * (count + 1) / (N + V)), N its count of kept terms, V their number; two shares
differ by f = floor((p - q)^2 / q).

How the pairs of sources are summed without a row for each pair and term:

1. Tasks count terms by group before anything is shuffled. One row a kept term is written, with its counts by source.
2. Kept terms are numbered from the most frequent on. ``bitmaps`` stores, for every (group, count), the set of
   term ids as 64-bit words, empty words left out. Terms of like frequency share words, so rare terms, which
   are most, have few counts a word.
3. Two groups' words of one place are ANDed: the population count of each AND is the number of terms with that
   pair of counts, the joint cell, and is multiplied by f. Cells in which a group has count zero are what
   the other group's level and all V terms have beyond the joint cells, so they follow by complement:
   sum of f = sum over both > 0 of cell * (f(a,b) - f(0,b) - f(a,0) + f(0,0))
   + sum over b of level(b) * f(0,b) + sum over a of level(a) * f(a,0) + (V - |A| - |B|) * f(0,0).

All arithmetic is on whole numbers. Sums stay below 2^63, as a group's shares add up to SCALE + V at most.
A word's rows are at most 64 a source, so a task holds little. What is sized by the number of sources is the
result itself: a row for each ordered pair of one language.

Null text, language and source read as ''. Empty texts have no terms but their group occurs. Repeated rows are
documents of their own. A very long text is counted like any other; a task holds it and its terms. An empty table gives
no rows. Columns beyond the three are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacelake.session import is_small, staged

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200

HELD_TERMS = 400_000
"""Counts by (group, term) that a task holds before it hands them on."""

WORD_BITS = 64
CELLS = 1_000_000
"""ANDs that a task does at once."""

LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
"""UTF-8 bytes of terms as they count, every other byte a blank."""


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (uses, docs) in held.items():
            if uses:
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.repeat(lang, len(uses)), "source": pa.repeat(source, len(uses)),
                    "term": pa.array(list(uses), pa.binary()).cast(pa.string()),
                    "uses": pa.array(uses.values(), pa.int64()),
                    "docs": pa.array([docs[term] for term in uses], pa.int64()),
                })
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            uses, docs = held.setdefault((lang, source), (Counter(), Counter()))
            terms = text.translate(LETTERS).split()
            size -= len(uses)
            uses.update(terms)
            docs.update(set(terms))
            size += len(uses)
            if size > HELD_TERMS:
                yield from flushed()
                size = 0
    yield from flushed()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, uses, of): each kept term with its uses in the language and ``of`` (source, uses)."""
    counted = docs.select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    ).mapInArrow(_counted, "lang string, source string, term string, uses bigint, docs bigint")
    # One exchange serves both groupings.
    by_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("uses").alias("uses"), F.sum("docs").alias("docs")
    )
    terms = by_source.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("uses").alias("uses"), F.collect_list(F.struct("source", "uses")).alias("of")
    )
    return terms.filter(F.col("docs") >= min_docs).drop("docs")


def numbered(terms: DataFrame) -> DataFrame:
    """``id`` for each term, near ones of like frequency; ids have gaps."""
    order = ["lang", F.desc("uses"), "term"]
    return terms.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())


def share(uses: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (uses + 1) / (total + terms)); 1 where nothing is kept."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (uses + 1).cast("decimal(19,0)")
    return F.when(terms == 0, F.lit(1).cast("bigint")).otherwise(
        1 + F.call_function("div", whole, (total + terms).cast("decimal(19,0)"))
    )


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def group_totals(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, total, kept, lang_total, terms, p0) for every group that occurs.

    ``total`` sums a group's uses, ``kept`` counts the terms that it has, ``p0`` is its share of a term without uses.
    """
    languages = terms.groupBy("lang").agg(F.sum("uses").alias("lang_total"), F.count("*").alias("terms"))
    sums = terms.select("lang", F.explode("of").alias("one")).groupBy("lang", F.col("one.source").alias("source")).agg(
        F.sum("one.uses").alias("total"), F.count("*").alias("kept")
    )
    occurring = docs.select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")
    ).distinct()
    groups = occurring.join(sums, ["lang", "source"], "left").join(languages, "lang", "left")
    groups = groups.fillna(0, ["total", "kept", "lang_total", "terms"])
    return groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("terms")))


def bitmaps(ids: DataFrame) -> DataFrame:
    """(lang, source, uses, word, bits): for each group and count the term ids, 64 a word."""
    rows = ids.select("lang", "id", F.explode("of").alias("one"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("id", F.lit(WORD_BITS)).cast("int"))
    word = F.call_function("shiftright", F.col("id"), F.lit(6))
    return rows.groupBy("lang", F.col("one.source").alias("source"), F.col("one.uses").alias("uses"), word.alias("word")).agg(
        F.bit_or(bit).alias("bits")
    )


def _gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _joint(bits: np.ndarray, p: np.ndarray, p0: np.ndarray, of: np.ndarray, into: dict, names: list) -> None:
    """Add the joint cells of one word's rows, each times its f, to the sums of ordered pairs."""
    step = max(1, CELLS // len(bits))
    for begin in range(0, len(bits), step):
        cells = np.bitwise_count(bits[begin : begin + step, None] & bits[None, :])
        a, b = np.nonzero(cells)
        n = cells[a, b].astype(np.int64)
        a += begin
        other = of[a] != of[b]
        a, b, n = a[other], b[other], n[other]
        value = n * (_gaps(p[a], p[b]) - _gaps(p0[a], p[b]) - _gaps(p[a], p0[b]) + _gaps(p0[a], p0[b]))
        pairs, place = np.unique(of[a] * len(names) + of[b], return_inverse=True)
        sums = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(sums, place, value)
        for pair, total in zip(pairs.tolist(), sums.tolist(), strict=True):
            key = names[pair // len(names)], names[pair % len(names)]
            into[key] = into.get(key, 0) + total


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair sums over the words of a task; rows come sorted by language and word."""
    sums: dict[str, dict] = {}
    rest = None

    def add(rows: pa.RecordBatch) -> None:
        coded = rows.column("source").dictionary_encode()
        bits, p, p0 = (rows.column(name).to_numpy() for name in ("bits", "p", "p0"))
        lang = rows.column("lang")[0].as_py()
        of = coded.indices.to_numpy().astype(np.int64)
        _joint(bits.view(np.uint64), p, p0, of, sums.setdefault(lang, {}), coded.dictionary.to_pylist())

    def out() -> Iterator[pa.RecordBatch]:
        for lang, pairs in sums.items():
            yield pa.RecordBatch.from_pydict({
                "lang": pa.repeat(lang, len(pairs)), "source": pa.array([a for a, _ in pairs], pa.string()),
                "item": pa.array([b for _, b in pairs], pa.string()), "value": pa.array(pairs.values(), pa.int64()),
            })
        sums.clear()

    for batch in batches:
        rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        words, langs = rows.column("word").to_numpy(), rows.column("lang").dictionary_encode().indices.to_numpy()
        cuts = np.flatnonzero((words[1:] != words[:-1]) | (langs[1:] != langs[:-1])) + 1
        begin = 0
        for end in cuts.tolist():
            add(rows.slice(begin, end - begin))
            begin = end
        rest = rows.slice(begin) if begin < rows.num_rows else None
        if sum(map(len, sums.values())) > HELD_TERMS:
            yield from out()
    if rest is not None:
        add(rest)
    yield from out()


def pair_sums(bitmap: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): f summed over all kept terms, for each ordered pair of sources of a language."""
    groups = F.broadcast(groups) if is_small(groups) else groups
    p = share(F.col("uses"), F.col("total"), F.col("terms")).alias("p")
    rows = bitmap.join(groups, ["lang", "source"]).select("lang", "source", "uses", "word", "bits", p, "p0")
    joint = rows.select("lang", "source", "word", "bits", "p", "p0").repartition("lang", "word").sortWithinPartitions(
        "lang", "word"
    ).mapInArrow(_summed, "lang string, source string, item string, value bigint")
    levels = rows.groupBy("lang", "source", "uses", "p", "p0").agg(F.sum(F.bit_count("bits")).alias("level"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("other_p0"))
    met = levels.join(other, "lang").filter("source <> other")
    mine = met.select(
        "lang", "source", F.col("other").alias("item"), (F.col("level") * gap(F.col("p"), F.col("other_p0"))).alias("value")
    )
    theirs = met.select(
        "lang", F.col("other").alias("source"), F.col("source").alias("item"),
        (F.col("level") * gap(F.col("other_p0"), F.col("p"))).alias("value"),
    )
    beyond = groups.join(
        groups.select("lang", F.col("source").alias("item"), F.col("kept").alias("item_kept"), F.col("p0").alias("q0")), "lang"
    ).filter("source <> item").select(
        "lang", "source", "item",
        ((F.col("terms") - F.col("kept") - F.col("item_kept")) * gap(F.col("p0"), F.col("q0"))).alias("value"),
    )
    parts = joint.unionByName(mine).unionByName(theirs).unionByName(beyond)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def leading_terms(terms: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """The ``top`` terms of each group that it uses more than its language does, with rank."""
    groups = F.broadcast(groups) if is_small(groups) else groups
    rows = terms.select("lang", "term", F.col("uses").alias("lang_uses"), F.explode("of").alias("one")).select(
        "lang", "term", "lang_uses", F.col("one.source").alias("source"), F.col("one.uses").alias("uses")
    )
    found = rows.join(groups, ["lang", "source"]).withColumns({
        "p": share(F.col("uses"), F.col("total"), F.col("terms")),
        "q": share(F.col("lang_uses"), F.col("lang_total"), F.col("terms")),
    }).filter("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` for the other sources, part ``term`` for leading terms."""
    terms = staged(kept_terms(docs, min_docs))
    groups = staged(group_totals(docs, terms))
    pairs = pair_sums(staged(bitmaps(numbered(terms))), groups)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    led = leading_terms(terms, groups, top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(
        led.withColumn("part", F.lit("term")).select(*columns)
    )


ORACLE_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), used AS (
    SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
    SELECT lang, term, count(*) AS uses FROM used GROUP BY lang, term HAVING count(DISTINCT doc) >= 3
), langs AS (
    SELECT lang, sum(uses)::HUGEINT AS n, count(*) AS v FROM kept GROUP BY lang
), counts AS (
    SELECT lang, source, term, count(*) AS uses FROM used SEMI JOIN kept USING (lang, term) GROUP BY ALL
), grps AS (
    SELECT g.lang, g.source, coalesce(sum(c.uses), 0)::HUGEINT AS n
    FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN counts c USING (lang, source) GROUP BY ALL
), p AS (
    SELECT g.lang, g.source, k.term, coalesce(c.uses, 0) AS uses,
        1 + (1000000000::HUGEINT * (coalesce(c.uses, 0) + 1)) // (g.n + l.v) AS p,
        1 + (1000000000::HUGEINT * (k.uses + 1)) // (l.n + l.v) AS q
    FROM grps g JOIN langs l USING (lang) JOIN kept k USING (lang)
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
    FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
    WHERE x.term IS NULL OR y.term IS NOT NULL
    GROUP BY ALL
), found AS (
    SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE uses > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
) WHERE part = 'pair' OR rank <= 200
"""

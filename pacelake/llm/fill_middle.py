"""Fill-in-middle: a text is cut at two places and rewritten so that its middle comes last.

A text is a sequence of units, code points unless a pattern says otherwise. Its units are the links of the lowest
lane of an indexable skip list; a link of each express lane above spans ``FAN`` links of the lane below. Every link
carries two widths, in units and in code points. The place of a cut is known as a rank among units; descending
from the top lane, links are followed while the units passed do not exceed the rank, and the code points passed
on the way are the offset to cut at, exactly.

Ranks, the choice of the form and whether a document stays plain come from a hash of seed and document id, so a
repeated run or a retried task gives the same rows. Every row is rewritten for itself, nothing is shuffled.

A null text counts as empty; empty texts and texts with a mark in them stay plain, with null widths. A null id hashes
as the empty string. Repeated rows give equal rows. A very long text takes memory for its lowest lane, one byte a code
point. An empty table gives no rows. Other columns pass through; ``n``, ``form``, ``prefix_chars``,
``middle_chars`` and ``output`` replace columns of those names, ``restored`` is added by ``restore``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacelake.llm.common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20
"""Percentages: documents from the first on stay plain, below the second of the others the suffix comes first."""

FAN = 16
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


class SkipList:
    """``points``: the code points of each unit, in order."""

    def __init__(self, points: np.ndarray):
        self.units = len(points)
        self.lanes = [(np.ones(len(points), dtype=np.uint8), points)]
        while len(self.lanes[-1][0]) > FAN:
            begins = np.arange(0, len(self.lanes[-1][0]), FAN)
            self.lanes.append(tuple(np.add.reduceat(widths, begins, dtype=np.int64) for widths in self.lanes[-1]))

    def offset(self, rank: int) -> int:
        """Code points before the unit of that rank, counted from 0."""
        passed = points = link = 0
        for lane in reversed(self.lanes):
            link *= FAN
            for units, width in zip(*(widths[link : link + FAN].tolist() for widths in lane), strict=True):
                if passed + units > rank:
                    break
                passed, points, link = passed + units, points + width, link + 1
        return points


def unit_points(text: str, unit: re.Pattern | None) -> np.ndarray:
    """Code points of each unit. A unit is a match with what stands unmatched before it; what follows the last
    match belongs to the last unit, and a text without a match is one unit."""
    if unit is None:
        return np.ones(len(text), dtype=np.uint8)
    ends = [match.end() for match in unit.finditer(text) if match.end() > match.start()]
    ends = [*ends[:-1], len(text)] if text else []
    return np.diff(np.array([0, *ends], dtype=np.int64))


def rewrite(text: str, hashes: tuple[int, int, int, int], unit: re.Pattern | None = None) -> tuple:
    """(units, form, code points of prefix, of middle, output)."""
    chain = SkipList(unit_points(text, unit))
    n = chain.units
    h1, h2, h3, h4 = hashes
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= PLAIN_FROM:
        return n, "plain", None, None, text
    a, b = sorted(chain.offset(h % (n + 1)) for h in (h1, h2))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST_BELOW:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def hashes_of(doc_id: Column, seed: int) -> Column:
    """Four unsigned numbers from the first 32 hex digits of the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)))


def fill_in_middle(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = 1, unit: str | None = None) -> DataFrame:
    """Replace ``text_col`` by ``output``; add ``n`` units, ``form``, and the code points of prefix and middle."""
    pattern = re.compile(unit) if unit else None
    others = [name for name in docs.columns if name != text_col and name not in ADDED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in slices(map(len, texts)):
                hashes = batch.column(2).slice(a, b - a).to_pylist()
                rows = [rewrite(text, h, pattern) for text, h in zip(texts[a:b], hashes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True))],
                    names=["kept", *ADDED],
                )

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    kept = F.struct(F.lit(0).alias(text_col), *(F.col(f"`{name}`") for name in others)).alias("kept")
    given = docs.select(kept, F.col(f"`{text_col}`").alias("text"), hashes_of(F.col(f"`{id_col}`"), seed).alias("hashes"))
    long, string = T.LongType(), T.StringType()
    schema = T.StructType([
        given.schema["kept"], *(T.StructField(name, kind) for name, kind in zip(ADDED, (long, string, long, long, string), strict=True)),
    ])
    rewritten = given.mapInArrow(run, schema)
    return rewritten.select(*(F.col(f"kept.`{name}`") for name in others), *ADDED)


def restore(docs: DataFrame) -> DataFrame:
    """Add ``restored``, the text that ``output`` was made of, from ``output`` and ``form`` alone.

    Texts without a mark are cut at the marks' first places: a mark cannot begin inside another one.
    """
    output, mark = F.col("output"), len(PREFIX)
    psm = F.col("form") == "psm"
    at_second = F.position(F.when(psm, F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), output)
    at_middle = F.position(F.lit(MIDDLE), output)
    first = output.substr(F.lit(mark + 1), at_second - mark - 1)
    second = output.substr(at_second + mark, at_middle - at_second - mark)
    middle = output.substr(at_middle + mark, F.length(output))
    rebuilt = F.when(psm, F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))
    return docs.withColumn("restored", F.when(F.col("form") == "plain", output).otherwise(rebuilt))


ORACLE_SQL = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
        sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex
    FROM documents
), h AS (
    SELECT *, ('0x' || hex[1:8])::BIGINT AS h1, ('0x' || hex[9:16])::BIGINT AS h2,
        ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4
    FROM d
), cut AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
            THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM h
), parts AS (
    SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM cut
)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""

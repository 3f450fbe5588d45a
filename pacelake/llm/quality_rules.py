"""Quality rules: statistics of each text, and lines that too many documents of a host share.

Lines are normalised (lower case, digits as one zero, white space as one blank) and hashed. For each
host and hash the distinct documents are counted; lines above the host's limit are removed, and a
document that keeps too few of its words is rejected, as is one that fails the rules on its own text.

DataFrame functions only. Texts are read once: what the second step needs, a hash and a word count
for each line, goes to a table in the shared folder. Counts are combined before the shuffle, so a
line or host with a third of all rows costs no more than others; frequent lines alone are joined.

Each row is a document of its own, also if it repeats another. Null text counts as empty. A null
host is one host. Null ids pass through. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacelake.llm.common import words_of
from pacelake.session import staged

MIN_WORDS = 10
WINDOW_WORDS = 5
MAX_REPEATED_PERCENT = 20
SYMBOLS = "[#*$%&|<>]"

MIN_DOCS = 30
"""A line of a host is frequent if more documents than this have it ..."""
HOST_SHARE = 0.01
"""... and more than this share of the host's documents."""
MIN_KEPT_SHARE = 0.5
"""Least share of its words that a document has to keep."""


def _repeated_words(df: DataFrame, words: str) -> DataFrame:
    """Add ``n_repeat_words``: words covered by windows that occur at least twice in the text."""
    w = WINDOW_WORDS
    hashes = F.when(
        F.size(words) >= w,
        F.transform(F.sequence(F.lit(0), F.size(words) - w), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(w)])),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_h", hashes)
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    pairs = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_s", F.when(twice, F.sort_array(pairs)))
    # Equal hashes are neighbours now.
    same = F.filter("_s", lambda x, j: F.coalesce(F.get("_s", j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_s", j + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("_p", F.sort_array(F.transform(same, lambda x: x["i"])))
    # A window covers its words up to the next such window.
    covered = F.transform("_p", lambda p, j: F.least(F.lit(w), F.coalesce(F.get("_p", j + 1) - p, F.lit(w))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_h", "_s", "_p")


def text_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """Add the statistics that the rules on a text alone need, and ``base_failed``."""
    text = F.coalesce(text_col, F.lit(""))
    df = docs.withColumn("_t", text).withColumn("_words", words_of(F.col("_t")))
    df = df.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    df = _repeated_words(df, "_words")
    n = F.size("_words").cast("long")
    df = df.withColumns({
        "n_words": n,
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("_t", "_words", "_lines")


def normalised_lines(text: Column) -> Column:
    """The text's lines that have a word, lower-case, digits as 0, white space as one blank."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.filter(F.transform(F.split(plain, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def _line_marks(text: Column) -> Column:
    blanks = lambda line: F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return F.transform(
        normalised_lines(text), lambda line: F.struct(F.xxhash64(line).alias("h"), (blanks(line) + 1).alias("words"))
    )


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    host_share: float = HOST_SHARE,
    min_kept_share: float = MIN_KEPT_SHARE,
) -> DataFrame:
    """``id_col``, the statistics, ``removed_lines`` (hashes of the lines to remove), ``kept_words`` and ``kept``."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.col(text_col).alias("_text"))
    rows = text_statistics(rows, "_text").withColumn("_marks", _line_marks(F.coalesce("_text", F.lit(""))))
    rows = staged(rows.drop("_text").withColumn("_row", F.monotonically_increasing_id()))
    hosts = rows.groupBy("_host").agg(F.count("*").alias("_docs"))
    limits = hosts.select(F.col("_host").alias("_of"), F.greatest(F.lit(min_docs), F.floor(F.col("_docs") * host_share)).alias("_limit"))
    lines = rows.select("_host", F.explode(F.array_distinct("_marks.h")).alias("_h"))
    counted = lines.groupBy("_host", "_h").agg(F.count("*").alias("_with")).filter(F.col("_with") > min_docs)
    frequent = counted.join(limits, F.col("_host").eqNullSafe(F.col("_of"))).filter("_with > _limit")
    frequent = frequent.select(F.col("_host").alias("_of"), F.col("_h").alias("_line"))
    marks = rows.select("_row", "_host", F.explode("_marks").alias("_m")).select("_row", "_host", "_m.h", "_m.words")
    marks = marks.groupBy("_row", "_host", "h").agg(F.sum("words").alias("words"))
    hits = marks.join(frequent, F.col("_host").eqNullSafe(F.col("_of")) & (F.col("h") == F.col("_line")))
    lost = hits.groupBy(F.col("_row").alias("_hit")).agg(
        F.sum("words").alias("_lost"), F.sort_array(F.collect_list("h")).alias("removed_lines")
    )
    out = rows.join(lost, F.col("_row") == F.col("_hit"), "left")
    kept_words = F.col("n_words") - F.coalesce("_lost", F.lit(0))
    out = out.withColumn("kept_words", kept_words.cast("long"))
    kept = ~F.col("base_failed") & (F.col("kept_words") >= min_kept_share * F.col("n_words"))
    return out.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce("removed_lines", F.array().cast("array<bigint>")).alias("removed_lines"), "kept_words", kept.alias("kept"),
    )


def without_lines(text: Column, removed: Column) -> Column:
    """``text`` without the lines whose normalised form is among ``removed``; blank lines stay."""
    def stays(line: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " "))
        return ~F.array_contains(removed, F.xxhash64(plain)) | (plain == "")

    return F.array_join(F.filter(F.split(text, "\n"), stays), "\n")


ORACLE_SQL = f"""
WITH t AS (
    SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT k, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
        length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols
    FROM t
), win AS (
    SELECT k, i, list_slice(words, i, i + {WINDOW_WORDS - 1}) AS win
    FROM (SELECT k, words, unnest(range(1, len(words) - {WINDOW_WORDS - 2})) AS i FROM w)
), again AS (
    SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS n FROM win) WHERE n > 1
), cover AS (
    SELECT k, sum(least({WINDOW_WORDS}, coalesce(nxt - i, {WINDOW_WORDS}))) AS n
    FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM again) GROUP BY k
), s AS (
    SELECT t.k, doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words
    FROM t JOIN w USING (k) LEFT JOIN cover USING (k)
), l AS (
    SELECT k, source, trim(line) AS line FROM (
        SELECT k, source, unnest(string_split(regexp_replace(regexp_replace(lower(text), '[0-9]+', '0', 'g'),
            '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), chr(10))) AS line FROM t
    ) WHERE trim(line) <> ''
), often AS (
    SELECT source, line FROM (SELECT source, line, count(DISTINCT k) AS n FROM l GROUP BY source, line)
    JOIN (SELECT source AS host, count(*) AS docs FROM t GROUP BY source) ON source IS NOT DISTINCT FROM host
    WHERE n > greatest({MIN_DOCS}, floor(docs * {HOST_SHARE}))
), lost AS (
    SELECT k, sum(len(string_split(l.line, ' '))) AS n FROM l JOIN often ON l.line = often.line
        AND l.source IS NOT DISTINCT FROM often.source GROUP BY k
), r AS (
    SELECT s.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
        n_words - coalesce(lost.n, 0) AS kept_words FROM s LEFT JOIN lost USING (k)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
    CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, CAST(kept_words AS BIGINT) AS kept_words,
    NOT base_failed AND kept_words >= {MIN_KEPT_SHARE} * n_words AS kept
FROM r
"""

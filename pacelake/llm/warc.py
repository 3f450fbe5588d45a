"""WARC archives: write one record per page, read them back with boundary-chain verification.

Writing: a page whose payload another page with a smaller id also has becomes a revisit record that
refers to it; all others are response records. Records go out through Spark's text writer with the
record separator as line end, so any file system that Spark knows will do, and every partition
is an archive of its own.

Reading: Spark's text reader cuts the archives at every magic string, also at those inside a payload,
and splits large archives between tasks. Each task reads a candidate record's header and so knows how
far it reaches; sizes of the splits before give its offset. That makes a table of candidate offsets
and successors, a few dozen bytes a record. Pointer jumping from offset 0 doubles the reach each round
and keeps only records that the chain from the start of their file meets, so magic inside a payload
is rejected. A payload that lies in one stretch is digested where it is read; only payloads that
contain magic are put together again, in a second read that keeps their stretches alone. That read finds
them by the SHA-1 of their bytes, as the first one noted it, so it may split the archives otherwise; a
stretch that it does not find is an error.

Null html counts as empty, a null url gives no target, pages with a null id are written last and come
back with a null id. Equal rows are separate records; of those with the least id one is the
response. A very long payload is one row and has to fit one task. Bytes that belong to no chain are ignored.
Other columns of ``pages``, whatever their names, are left out. An empty table gives no records.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pacelake.session import cut_lineage, is_small, scratch_dir, staged

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = "none"

# The digits that conv() writes in base 32, and those of RFC 4648.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: each five hexadecimal digits are four of base 32."""
    digest = F.sha1(payload)
    parts = [
        F.lpad(F.conv(F.substring(digest, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)
    ]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit(NO_ID)), F.lit(">"))


def _header_value(text: Column) -> Column:
    """A url as it may stand in a header: nothing but printable ASCII."""
    return F.regexp_replace(text, r"[^\x21-\x7E]", "%20")


def records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """``page_id`` and ``record``, without the magic in front and the separator behind."""
    pages = pages.select(
        "page_id", F.coalesce("html", F.lit("")).alias("html"), F.col("url").alias("url"),
    )
    noted = pages.select("page_id", payload_digest(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("size"))
    noted = noted.filter(F.col("size") >= min_revisit_bytes)
    # One row for each payload that several pages have; groupBy combines before the shuffle.
    groups = noted.groupBy("digest", "size").agg(F.min("page_id").alias("first_id"), F.count("*").alias("pages"))
    shared = cut_lineage(groups.filter("pages > 1").select("digest", "first_id"))
    if is_small(shared):
        shared = F.broadcast(shared)
    known = pages.withColumn("digest", payload_digest(F.col("html").cast("binary"))).withColumn(
        "size", F.octet_length("html")
    )
    known = known.join(shared, "digest", "left")
    again = (F.col("size") >= min_revisit_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    known = known.withColumn("again", F.coalesce(again, F.lit(False)))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"), F.lit(END),
    )
    body = F.when(F.col("again"), F.lit("")).otherwise(F.col("html"))
    length = F.octet_length(http) + F.octet_length(body)
    target = F.when(F.col("url").isNull(), F.lit("")).otherwise(
        F.concat(F.lit("WARC-Target-URI: "), _header_value(F.col("url")), F.lit("\r\n"))
    )
    refers = F.when(
        F.col("again"),
        F.concat(
            F.lit("WARC-Refers-To: "), _record_id(F.col("first_id")), F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\n")
        ),
    ).otherwise(F.lit(""))
    header = F.concat(
        F.lit("WARC-Type: "), F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("page_id")), F.lit(f"\r\nWARC-Date: {DATE}\r\n"), target, refers,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit(END),
    )
    return known.select("page_id", F.concat(header, http, body).alias("record"))


def write_archives(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 0) -> str:
    """Write the archives to a folder and return its name; by default a new one in the shared folder."""
    path = path or f"{scratch_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    out = records(pages, min_revisit_bytes).select(F.concat(F.lit(MAGIC), "record"))
    out.write.option("lineSep", END).text(path)
    return path


def _stretches(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two magic strings, with its place in the order of its split."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        # A key for the archive's name, which would be most of each row.
        F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"), F.col("value").cast("binary").alias("raw"),
    )


def _content() -> Column:
    """What a stretch is known by in any read: the SHA-1 of its bytes."""
    return F.unhex(F.sha1("raw"))


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def _number(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{1,18}$"), text.cast("long"))


def _with_parts(rows: DataFrame) -> DataFrame:
    """Add header, sizes and payload of the record whose bytes behind the magic are in ``raw``.

    ``digest`` is null unless the whole block is there.
    """
    rows = rows.withColumn("header", F.substring_index(F.col("raw").cast("string"), END, 1))
    rows = rows.withColumn("head_bytes", F.octet_length("header") + len(END))
    rows = rows.withColumn("block_bytes", _number(_field(F.col("header"), "Content-Length")))
    rows = rows.withColumn("claimed", F.col("head_bytes") + F.col("block_bytes") + len(END))
    block = F.expr("substring(raw, head_bytes + 1, cast(block_bytes as int))")
    rows = rows.withColumn("body", F.when(F.col("claimed") <= F.octet_length("raw"), block))
    rows = rows.withColumn("http", F.substring_index(F.col("body").cast("string"), END, 1))
    payload = F.expr(f"substring(body, octet_length(http) + {len(END) + 1})")
    rows = rows.withColumn("digest", payload_digest(payload)).withColumn("payload_bytes", F.octet_length(payload).cast("long"))
    rows = rows.withColumn("bytes", F.octet_length("raw").cast("long"))
    return rows.drop("raw", "head_bytes", "block_bytes", "body")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row for each magic string: ``file``, ``offset``, the ``next`` offset that its header claims, and
    what its header and, if it lies in one stretch, its payload say."""
    noted = staged(_with_parts(_stretches(spark, path).withColumn("content", _content())))
    # The text reader drops the magic behind each stretch; a stretch belongs to the magic before it.
    width = F.col("bytes") + len(MAGIC)
    blocks = noted.groupBy("file", "block").agg(F.sum(width).alias("total"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    upto = Window.partitionBy("file", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = noted.withColumn("end", F.sum(width).over(upto)).join(blocks, ["file", "block"])
    rows = rows.withColumn("offset", F.col("before") + F.col("end") - width - len(MAGIC))
    rows = rows.withColumn("next", F.col("offset") + len(MAGIC) + F.col("claimed"))
    return rows.filter("offset >= 0").drop("before", "end", "claimed")


def reachable(chains: DataFrame) -> DataFrame:
    """The (file, offset) that the chains from offset 0 meet; ``chains`` has file, offset, next.

    Records that follow each other without a gap are one run, unless a jump leads into it. Pointer
    jumping then goes over runs: after n rounds the first 2**n runs of each file's chain are found.
    """
    in_file = Window.partitionBy("file").orderBy("offset")
    rows = chains.filter("next > offset").select("file", "offset", "next")
    rows = rows.withColumn("after", F.lead("offset").over(in_file)).withColumn("before", F.lag("next").over(in_file))
    rows = cut_lineage(rows)
    straight = F.col("next").eqNullSafe(F.col("after"))
    entered = rows.filter(~straight).select("file", F.col("next").alias("offset"), F.lit(True).alias("entered")).distinct()
    rows = rows.join(entered, ["file", "offset"], "left")
    opens = ~F.col("before").eqNullSafe(F.col("offset")) | F.col("entered").isNotNull()
    rows = cut_lineage(rows.withColumn("run", F.sum(opens.cast("long")).over(in_file)).select("file", "offset", "next", "run"))
    jumps = rows.groupBy("file", "run").agg(F.min("offset").alias("entry"), F.max("next").alias("exit"))
    jumps = cut_lineage(jumps)
    runs = jumps.select("file", "run", "entry")
    jumps = jumps.select("file", "entry", "exit")
    found = jumps.filter("entry = 0").select("file", "entry")
    known = found.count()
    while True:
        reached = found.join(jumps, ["file", "entry"]).select("file", F.col("exit").alias("entry"))
        found = found.unionByName(reached.join(runs, ["file", "entry"], "left_semi")).distinct()
        found = cut_lineage(found)
        count = found.count()
        if count == known:
            break
        known = count
        onward = jumps.select("file", F.col("entry").alias("exit"), F.col("exit").alias("beyond"))
        jumps = cut_lineage(jumps.join(onward, ["file", "exit"]).select("file", "entry", F.col("beyond").alias("exit")))
    met = runs.join(found, ["file", "entry"], "left_semi").select("file", "run")
    return rows.join(met, ["file", "run"], "left_semi").select("file", "offset")


def _mended(spark: SparkSession, path: str, every: DataFrame, torn: DataFrame) -> DataFrame:
    """The torn records, put together from the stretches that the magic inside them made."""
    starts = torn.select("file", "offset", F.col("offset").alias("start"), F.col("next").alias("stop"))
    upto = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A stretch lies in the last torn record that starts at or before it, if that reaches so far.
    owned = every.select("file", "content", "offset").join(starts, ["file", "offset"], "left")
    owned = owned.withColumn("start", F.last("start", ignorenulls=True).over(upto))
    owned = owned.withColumn("stop", F.last("stop", ignorenulls=True).over(upto)).filter("offset < stop")
    owned = cut_lineage(owned)
    wanted = owned.select("content").distinct()
    read = _stretches(spark, path).select(_content().alias("content"), "raw")
    read = read.join(F.broadcast(wanted) if is_small(wanted) else wanted, "content", "left_semi")
    read = read.groupBy("content").agg(F.min("raw").alias("raw"))
    lost = F.raise_error(F.concat(F.lit("archive changed while it was read, at offset "), F.col("offset").cast("string")))
    parts = owned.join(read, "content", "left").withColumn("raw", F.coalesce("raw", lost.cast("binary")))
    joined = parts.groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("offset", "raw"))).alias("parts"))
    magic = F.lit(MAGIC).cast("binary")
    together = F.aggregate(
        F.slice("parts", F.lit(2), F.size("parts")), F.col("parts")[0]["raw"], lambda done, part: F.concat(done, magic, part["raw"])
    )
    return _with_parts(joined.select("file", F.col("start").alias("offset"), together.alias("raw")))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_id``, ``record_type``, ``payload_bytes``, ``payload_digest``, ``refers_to``, ``file`` and ``offset``
    of every record."""
    every = staged(candidates(spark, path))
    kept = every.join(reachable(every), ["file", "offset"], "left_semi")
    columns = ["file", "offset", "header", "http", "digest", "payload_bytes"]
    torn = cut_lineage(kept.filter("digest IS NULL").select("file", "offset", "next"))
    found = kept.filter("digest IS NOT NULL").select(*columns)
    if torn.limit(1).count():
        found = found.unionByName(_mended(spark, path, every, torn).select(*columns))
    header, kind = F.col("header"), _field(F.col("header"), "WARC-Type")
    page = F.regexp_extract(_field(header, "WARC-Record-ID"), "^<urn:page:(-?[0-9]+)>$", 1)
    refers = F.regexp_extract(_field(header, "WARC-Refers-To"), "^<urn:page:(-?[0-9]+)>$", 1)
    recorded = F.regexp_replace(_field(header, "WARC-Payload-Digest"), "^sha1:", "")
    original = _number(_field(F.col("http"), "Content-Length"))
    return found.select(
        F.when(page != "", page.cast("long")).alias("page_id"),
        kind.alias("record_type"),
        # A revisit holds only the headers of its payload.
        F.when(kind == "revisit", original).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(kind == "revisit", recorded).otherwise(F.col("digest")).alias("payload_digest"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
        "file", "offset",
    )


def _sql_base32() -> str:
    groups = [f"CAST('0x' || substr(h, {at}, 5) AS BIGINT)" for at in range(1, 41, 5)]
    return " || ".join(f"substr('{BASE32_DIGITS}', CAST(({g} >> {s}) & 31 AS INT) + 1, 1)" for g in groups for s in (15, 10, 5, 0))


ORACLE_SQL = f"""
WITH p AS (
    SELECT row_number() OVER (ORDER BY page_id) AS k, page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
    SELECT *, {_sql_base32()} AS digest, min(page_id) OVER (PARTITION BY h) AS first_id FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""

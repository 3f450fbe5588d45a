"""Personal data: checked patterns, and candidates that boosted trees select.

Base spans are those of four fixed patterns that pass their checks. Generators with high recall
propose further, overlapping spans: whatever looks like a written-out address, a number in groups or a
long token. Gradient-boosted trees score each candidate by its format and by the words around it. They
learn from candidates that strict rules settle either way; the threshold is the least score at which
all settled candidates that the fit has not seen have the wanted precision, each class weighted to its
share in the corpus. Candidates at or above it that no base span
touches are selected too.

DataFrame and ML functions only. Texts are read once; hits, their distances and the text around
them go to a narrow table in the shared folder. Everything behind it is linear in the number of hits.
The fit sees half of at most ``max_fit`` settled candidates of each class, those with the least hash; the
threshold is taken from all others. Copies of a candidate, with the same text around them, count once in both.

Patterns are written so that each is linear in the text and never recurses: runs are possessive, and a
run is only tried at its beginning or right behind the last match, where alone a match can start.

Each row is a document of its own, also if it repeats another; null text counts as empty; null ids
pass through. If the fit or the threshold lacks distinct settled candidates of a class, or no score has
the wanted precision, the base spans are all there is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacelake.session import cut_lineage, staged

BASE = ("email", "ip", "card", "phone")
"""Kinds with checks, in the order in which spans with the same start are listed."""
PROPOSED = ("address", "number", "secret")
"""Kinds of the generators, listed behind the base kinds."""

_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "address": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)*+",
    "number": r"(?<![0-9A-Za-z])\+?[0-9](?:[\x20().-]{0,3}[0-9]){6,}+",
    "secret": r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{16,}+",
}
GUARDS = {"email": "@", "phone": "+"}
"""What a text must contain for the pattern to be tried."""

CONTEXT = 24
MAX_FIT = 5_000
"""Distinct settled candidates of each class that the fit sees at most."""
TREES, DEPTH = 10, 3
PRECISION = 0.99

CONTEXT_WORDS = {
    "says_phone": "phone|tel|call|fax|mobile|whatsapp",
    "says_card": "card|visa|credit|account|iban|payment",
    "says_mail": "mail|contact|write to|reach",
    "says_secret": "key|token|secret|passw|auth|credential",
    "says_count": "page|version|isbn|figure|chapter|total|year",
}
# Formats of credentials that issuers publish.
SECRET_FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})$"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """True if the check sum of a text of digits holds."""
    def value(char: Column, i: Column) -> Column:
        double = char.cast("int") * 2
        return F.when(i % 2 == 0, char.cast("int")).when(double > 9, double - 9).otherwise(double)

    places = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), value)
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: Column, hit: Column) -> Column:
    digits = _digits(hit)
    n = F.length(digits)
    small = lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (F.right(part, F.lit(3)).cast("int") <= 255)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", F.forall(F.split(hit, r"\."), small))
        .when(kind == "card", F.when((n >= 14) & (n <= 19), _luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "phone", (n >= 10) & (n <= 15))
        .otherwise(F.lit(None).cast("boolean"))
    )


def _hits(text: Column, kind: str) -> Column:
    """For each match the length of the text since the one before, the match, and what is around it."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.split(text, pattern, -1)
    rows = F.zip_with(
        found, between,
        lambda hit, gap: F.struct(hit.alias("hit"), F.length(gap).alias("gap"), F.right(gap, F.lit(CONTEXT)).alias("before"), F.left(gap, F.lit(CONTEXT)).alias("lead")),
    )
    guard = F.contains(text, F.lit(GUARDS[kind])) if kind in GUARDS else text.rlike(pattern)
    return F.when(guard, rows)


def _found(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """One row for each document: its id, and for each kind the hits or null."""
    ids = F.struct(F.col(id_col), *keep).alias("_id")
    rows = docs.select(ids, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.select("_id", *[_hits(F.col("_text"), kind).alias(kind) for kind in (*BASE, *PROPOSED)])


def _spans(found: DataFrame) -> DataFrame:
    """One row for each hit, with ``start`` and ``end`` in code points."""
    kinds = [F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("listed"), F.col(kind).alias("hits")) for n, kind in enumerate((*BASE, *PROPOSED))]
    rows = found.select("_row", F.explode(F.array(*kinds)).alias("k")).filter("k.hits IS NOT NULL")
    rows = rows.select("_row", "k.kind", "k.listed", F.posexplode("k.hits").alias("nth", "h"))
    rows = rows.select("_row", "kind", "listed", "nth", "h.hit", F.coalesce("h.gap", F.lit(0)).alias("gap"), "h.before", "h.lead")
    order = Window.partitionBy("_row", "listed").orderBy("nth")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.coalesce(F.length("hit"), F.lit(0))
    rows = rows.withColumn("end", F.sum(F.col("gap") + size).over(upto)).withColumn("start", F.col("end") - size)
    rows = rows.withColumn("after", F.coalesce(F.lead("lead").over(order), F.lit("")))
    # Behind the last hit there is one more gap.
    return rows.filter("hit IS NOT NULL").drop("gap", "lead", "nth")


def _features(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    hit, digits = F.col("hit"), _digits(F.col("hit"))
    n = F.length(hit)
    around = F.lower(F.concat("before", F.lit(" "), "after"))
    count = lambda chars: n - F.length(F.regexp_replace(hit, chars, ""))
    columns = {
        "length": n, "digits": F.length(digits), "upper": count("[A-Z]"), "lower": count("[a-z]"),
        "blanks": count("[ ]"), "dashes": count("[-]"), "dots": count("[.]"), "marks": count("[^A-Za-z0-9 .-]"),
        "distinct": F.size(F.array_distinct(F.split(hit, "(?!^)(?!$)"))),
        "runs": F.size(F.split(hit, "[0-9]+")),
        "plus": hit.startswith("+").cast("int"), "at": F.contains(hit, F.lit("@")).cast("int"),
        "luhn": F.when(F.length(digits) > 1, _luhn(digits)).otherwise(F.lit(False)).cast("int"),
        "joined": F.col("before").rlike("[A-Za-z0-9]$").cast("int"), "followed": F.col("after").rlike("^[A-Za-z0-9%]").cast("int"),
        "kind_of": F.col("listed"),
    } | {name: around.rlike(words).cast("int") for name, words in CONTEXT_WORDS.items()}
    return rows.withColumns({f"f_{name}": column.cast("double") for name, column in columns.items()}), [f"f_{name}" for name in columns]


def _settled(rows: DataFrame) -> DataFrame:
    """Add ``label``: 1 or 0 where a strict rule knows, else null. ``touched`` says whether a base span overlaps."""
    hit, n = F.col("hit"), F.length(_digits(F.col("hit")))
    personal = F.col("touched") | ((F.col("kind") == "secret") & hit.rlike(SECRET_FORMATS))
    harmless = (
        ((F.col("kind") == "secret") & ~(hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")))
        | ((F.col("kind") == "number") & ((n < 9) | (n > 19) | hit.rlike(r"^(19|20)[0-9]{2}[-.][0-9]{2}[-.][0-9]{2}")))
        # A number as long as a card's whose check sum fails is an order or serial number.
        | ((F.col("kind") == "number") & (n >= 14) & ~_luhn(_digits(hit)))
        | ((F.col("kind") == "address") & ~hit.rlike(r"\.|dot"))
    )
    return rows.withColumn("label", F.when(personal, 1.0).when(harmless, 0.0))


def _touched(candidates: DataFrame, base: DataFrame) -> DataFrame:
    """Add ``touched``. Base spans are merged to the places they cover in order, so a document is
    swept once: the greatest end of the base spans that start before the candidate ends."""
    marks = base.select("_row", F.col("start").alias("at"), F.lit(0).alias("turn"), F.col("end").alias("reach"), F.lit(None).cast("long").alias("key"))
    keyed = candidates.withColumn("key", F.xxhash64("_row", "listed", "start"))
    asks = keyed.select("_row", (F.col("end") - 1).alias("at"), F.lit(1).alias("turn"), F.lit(None).cast("long").alias("reach"), "key")
    upto = Window.partitionBy("_row").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = marks.unionByName(asks).withColumn("reach", F.max("reach").over(upto)).filter("turn = 1")
    reach = swept.select(F.col("_row").alias("of"), F.col("key").alias("asked"), F.col("reach"))
    joined = keyed.join(reach, (F.col("_row") == F.col("of")) & (F.col("key") == F.col("asked")))
    return joined.withColumn("touched", F.coalesce(F.col("reach") > F.col("start"), F.lit(False))).drop("of", "asked", "key", "reach")


def _fit(candidates: DataFrame, features: list[str], max_fit: int, precision: float):
    """The boosted trees and their threshold, or None."""
    known = candidates.filter("label IS NOT NULL").select("label", "hit", "before", "after", *features).distinct()
    known = staged(known.withColumn("_mark", F.xxhash64("hit", "before", "after", *features)))
    parts = [known.filter(F.col("label") == label).orderBy("_mark", "hit", "before", "after").limit(max_fit) for label in (0.0, 1.0)]
    assemble = VectorAssembler(inputCols=features, outputCol="vector").transform
    sample = cut_lineage(reduce(DataFrame.unionByName, parts))
    even = F.col("_mark") % 2 == 0
    learn = cut_lineage(assemble(sample.filter(even)).select("label", "vector"))
    learnt = {row["label"]: row["count"] for row in learn.groupBy("label").count().collect()}
    if len(learnt) < 2:
        return None
    model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=1).fit(learn)
    # All that the fit has not seen: the other half, and this half behind the last of the class in the sample.
    last = {row["label"]: row["last"] for row in sample.groupBy("label").agg(F.max("_mark").alias("last")).collect()}
    seen = reduce(Column.__or__, [(F.col("label") == label) & (F.col("_mark") <= mark) for label, mark in last.items()])
    scored = model.transform(assemble(known.filter(~(even & seen)))).select("label", F.floor(vector_to_array("probability")[1] * 200).alias("bin"))
    bins = scored.groupBy("bin", "label").count().orderBy(F.desc("bin")).collect()
    kept = {label: sum(row["count"] for row in bins if row["label"] == label) for label in learnt}
    if not all(kept.values()):
        return None
    counts = {}
    for row in bins:
        # Those kept of a class stand for all of it, so that the classes have the ratio they have in the corpus.
        counts.setdefault(row["bin"], {})[row["label"]] = row["count"] * (1 + learnt[row["label"]] / kept[row["label"]])
    total = right = 0.0
    threshold = None
    for at, of in counts.items():
        total, right = total + sum(of.values()), right + of.get(1.0, 0.0)
        if right >= precision * total:
            threshold = at / 200
    return None if threshold is None else (model, threshold)


def find_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_fit: int = MAX_FIT,
    precision: float = PRECISION,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row a document: ``id_col``, the columns ``keep``, and ``base`` and ``spans``, arrays of (start,
    listed, kind, end) in order."""
    found = staged(_found(docs, id_col, text_col, keep).withColumn("_row", F.monotonically_increasing_id()))
    hits = _spans(found)
    hits = staged(hits.withColumn("passes", _passes(F.col("kind"), F.col("hit"))))
    base = hits.filter("passes")
    candidates, features = _features(hits.filter(F.col("kind").isin(*PROPOSED)))
    candidates = cut_lineage(_settled(_touched(candidates, base)))
    fitted = _fit(candidates, features, max_fit, precision)
    columns = ["_row", "start", "listed", "kind", "end"]
    chosen = base.select(*columns, F.lit(True).alias("is_base"))
    if fitted:
        model, threshold = fitted
        vectors = VectorAssembler(inputCols=features, outputCol="vector").transform(candidates.filter("NOT touched"))
        likely = model.transform(vectors).filter(vector_to_array("probability")[1] >= threshold)
        chosen = chosen.unionByName(likely.select(*columns, F.lit(False).alias("is_base")))
    span = F.struct("start", "listed", "kind", "end")
    lists = chosen.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_base"), span))).alias("base"), F.sort_array(F.collect_list(span)).alias("spans")
    )
    out = found.select("_row", "_id").join(lists, "_row", "left")
    empty = F.array().cast("array<struct<start:bigint,listed:int,kind:string,end:bigint>>")
    return out.select("_id.*", F.coalesce("base", empty).alias("base"), F.coalesce("spans", empty).alias("spans"))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first stays
    and the rest of the others is cut."""
    step = F.aggregate(
        spans,
        F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))).otherwise(
            F.struct(
                F.concat(a["out"], F.array(F.substring(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"),
                s["end"].alias("at"),
            )
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"].cast("int") + 1, F.lit(2**31 - 1))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(step)

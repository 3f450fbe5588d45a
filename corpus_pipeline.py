"""From documents to packed sequences: judge, dedup, cut, redact, pack.

All stages but the last return the columns of their documents, extra ones unchanged whatever their names. Null
and empty texts are documents like others, an empty table gives empty results, and rows that repeat are near
copies of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pacelake.llm import pii, quality_model, queries, simhash, substring_dedup
from pacelake.llm.common import table
from pacelake.session import ship_package, staged

KEPT = ("doc_id", "text")

def _plain(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the other columns by number, as operators and stages add columns of their own."""
    others = [name for name in docs.columns if name not in KEPT]
    return docs.select(*KEPT, *[_column(name).alias(f"other {n}") for n, name in enumerate(others)])


def _named(plain: DataFrame, docs: DataFrame, new_text: bool = False) -> DataFrame:
    """The columns of ``docs`` from what became of ``_plain(docs)``; after a change of text ``n_chars`` is counted anew."""
    others = [name for name in docs.columns if name not in KEPT]
    found = {name: _column(f"other {n}").alias(name) for n, name in enumerate(others)} | {name: F.col(name) for name in KEPT}
    if new_text:
        found["n_chars"] = F.length("text").cast("long").alias("n_chars")
    return plain.select(*[found[name] for name in docs.columns])


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _marked(plain: DataFrame) -> DataFrame:
    """With the id, ``_mark`` tells rows apart unless they are copies of each other."""
    return plain.withColumn("_mark", F.xxhash64(F.coalesce("text", F.lit(""))))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    ship_package(spark)
    labels = table(spark, sf_dir, "labels").filter(~quality_model.held_out())
    plain = _plain(docs)
    model = quality_model.fit(plain, labels)
    scored = quality_model.score(plain, model, threshold_score=queries.QUALITY_THRESHOLD)
    return _named(scored.filter(F.col("score") >= queries.QUALITY_THRESHOLD), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id; of rows without an id, and of copies
    of a row, one stays."""
    ship_package(spark)
    marked = _marked(_plain(docs))
    groups = simhash.simhash_dedup(marked, keep=("_mark",))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_mark")
    chosen = groups.groupBy("component").agg(F.min(order).alias("one")).select(
        F.col("one.doc_id").alias("_id"), F.col("one._mark").alias("_of")
    )
    stays = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_of"))
    return _named(marked.join(chosen, stays, "left_semi").dropDuplicates(["doc_id", "_mark"]), docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have."""
    ship_package(spark)
    return _named(substring_dedup.substring_dedup(_plain(docs)), docs, new_text=True)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    ship_package(spark)
    marked = _marked(_plain(docs))
    found = pii.find_spans(marked, keep=("_mark",)).filter("size(spans) > 0").dropDuplicates(["doc_id", "_mark"])
    found = found.select(F.col("doc_id").alias("_id"), F.col("_mark").alias("_of"), "spans")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_of"))
    joined = marked.join(found, same, "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(pii.redact(F.col("text"), F.col("spans")))
    return _named(joined.withColumn("text", text), docs, new_text=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    ship_package(spark)
    return queries.packed(docs)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_dedup", near_dedup),
    ("substring_dedup", cut_passages),
    ("pii", redact),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None
"""The classifier, XXH64 fingerprints and the tokenizer have no SQL; tests hold the rows against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

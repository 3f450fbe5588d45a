"""Document quality from Bradley-Terry pairwise ranking.

A document's worth is a linear function of features of its whole text. Preference pairs (a good
and a bad labelled document) give a logistic loss on feature differences, which Newton steps
minimise. The threshold is a quantile of the worth of all labelled documents: the share of bad ones among
them, moved into the widest gap nearby. ``score`` is the Bradley-Terry probability that the
document beats one at the threshold, shifted so that the threshold has the wanted score.

The fit sees at most ``max_labelled`` labelled documents of each class, those with the least hash
of their id, so it is the same on every run; everything else covers all rows. For the threshold the worth
of all labelled documents is ranked in Spark; of the gaps only the widest of each slice reaches the driver.

Null text counts as empty and is scored like any text without words. Null labels teach nothing,
nor do ids with both labels. Repeated rows get equal scores. Without labels of both classes every document
scores 1: nothing is known against it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacelake.session import staged

MAX_LABELLED = 10_000
"""Labelled documents of each class that the fit sees at most."""

PAIRS_EACH = 20
"""Preference pairs for each labelled document of the larger class."""

RIDGE = 1e-2
CLIP = 6.0
"""Standardised features are cut to this many deviations."""

BYTE_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".!?",
    "comma": b",;:",
    "bang": b"!",
    "symbol": b"#*$%&|<>=+~^_@{}[]\\/",
    "bar": b"|",
    "newline": b"\n",
}

FEATURES = (
    *BYTE_CLASSES, "log_words", "word_length", "long_words", "distinct_words", "short_words", "repeated_runs",
    "symbol_words", "capital_words", "stopped_lines", "line_words", "repeated_lines", "odd_joints",
)


def text_features(text: str | None) -> list[float]:
    data = (text or "").encode()
    n = max(len(data), 1)
    row = [(len(data) - len(data.translate(None, chars))) / n for chars in BYTE_CLASSES.values()]
    words = data.split()
    m = max(len(words), 1)
    lengths = np.fromiter(map(len, words), dtype=np.int32, count=len(words))
    runs = len(words) - 2
    lines = [line for line in data.split(b"\n") if line.strip()]
    k = max(len(lines), 1)
    symbols = BYTE_CLASSES["symbol"] + b"!"
    return row + [
        float(np.log1p(len(words))),
        min(float(lengths.mean()) if len(words) else 0.0, 50.0),
        float((lengths > 15).mean()) if len(words) else 0.0,
        len(set(words)) / m,
        float((lengths <= 3).mean()) if len(words) else 0.0,
        1 - len(set(zip(words, words[1:], words[2:], strict=False))) / runs if runs > 0 else 0.0,
        sum(word[-1] in symbols for word in words) / m,
        sum(word[:1].isupper() for word in words) / m,
        sum(line.rstrip()[-1] in b".!?" for line in lines) / k,
        float(np.log1p(len(words) / k)),
        1 - len(set(lines)) / k,
        data.count(b" | ") / m,
    ]


class Model(NamedTuple):
    mean: list[float]
    scale: list[float]
    weights: list[float]
    threshold: float
    """Worth at which a document is as good as rejected."""


def _standard(features: np.ndarray, model: Model) -> np.ndarray:
    return np.clip((features - np.array(model.mean)) / np.array(model.scale), -CLIP, CLIP)


def worth(features: np.ndarray, model: Model) -> np.ndarray:
    return (_standard(features, model) * np.array(model.weights)).sum(axis=1)


def fit_pairs(features: np.ndarray, good: np.ndarray, pairs_each: int = PAIRS_EACH) -> Model:
    """Newton steps on the logistic loss of the worth differences of (good, bad) pairs; no threshold yet."""
    scale = features.std(axis=0)
    model = Model(features.mean(axis=0).tolist(), np.where(scale > 1e-9, scale, 1.0).tolist(), [], 0.0)
    x = _standard(features, model)
    chosen = np.random.default_rng(0)
    wins, losses = np.flatnonzero(good), np.flatnonzero(~good)
    n = pairs_each * max(len(wins), len(losses))
    better, worse = chosen.choice(wins, n), chosen.choice(losses, n)
    differ = x[better] - x[worse]
    weights = np.zeros(x.shape[1])
    for _ in range(30):
        lost = 1 / (1 + np.exp(np.clip(differ @ weights, -30, 30)))
        gradient = differ.T @ lost / n - RIDGE * weights
        curve = (differ * (lost * (1 - lost))[:, None]).T @ differ / n + RIDGE * np.eye(len(weights))
        step = np.linalg.solve(curve, gradient)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return model._replace(weights=weights.tolist())


def _featured(docs: DataFrame, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_features(text.as_py()) for text in batch.column(text_col)]
            columns = {name: batch.column(name) for name in names}
            yield pa.RecordBatch.from_pydict(columns | {"features": pa.array(rows, pa.list_(pa.float64()))})

    names = [name for name in docs.columns if name != text_col]
    schema = T.StructType([docs.schema[name] for name in names]).add("features", T.ArrayType(T.DoubleType()))
    return docs.mapInArrow(run, schema)


def _worths(rows: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = worth(np.array(batch.column("features").to_pylist()).reshape(-1, len(FEATURES)), model)
            yield pa.RecordBatch.from_pydict({"worth": pa.array(values, pa.float64())})

    return rows.select("features").mapInArrow(run, "worth double")


def widest_gap(worths: DataFrame, share: float) -> float:
    """The middle of the widest gap of the column ``worth`` within 2 % of its quantile ``share``.

    Distinct values are sorted by range; each slice sends its row count and ends, then its widest gap.
    """
    values = worths.groupBy("worth").agg(F.count("*").alias("n"))
    sliced = staged(values.repartitionByRange("worth").withColumn("slice", F.spark_partition_id()))
    ends = F.sum("n").alias("rows"), F.min("worth").alias("least"), F.max("worth").alias("most")
    slices = sliced.groupBy("slice").agg(*ends).orderBy("slice").collect()
    total = sum(one["rows"] for one in slices)
    low, high = (int(np.clip((share + d) * total, 1, total - 1)) for d in (-0.02, 0.02))
    # The rank of the first row of each slice, for slices with ranks from low to high.
    first = dict(zip((one["slice"] for one in slices), np.cumsum([0, *(one["rows"] for one in slices)]).tolist()))
    near = [one["slice"] for one in slices if first[one["slice"]] <= high and first[one["slice"]] + one["rows"] > low]
    start = reduce(lambda found, at: found.when(F.col("slice") == at, F.lit(first[at])), near, F.when(F.lit(False), F.lit(0)))
    order = Window.partitionBy("slice").orderBy("worth")
    rank = start + F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sliced.filter(F.col("slice").isin(near)).select("slice", "worth", rank.alias("rank"), F.lag("worth").over(order).alias("before"))
    gap = F.struct((F.col("worth") - F.col("before")).alias("gap"), (-F.col("worth")).alias("turned"), "before")
    found = ranked.filter(F.col("rank").between(low, high) & F.col("before").isNotNull()).groupBy("slice").agg(F.max(gap).alias("widest")).collect()
    gaps = [(row["widest"]["gap"], row["widest"]["turned"], row["widest"]["before"]) for row in found]
    gaps += [(b["least"] - a["most"], -b["least"], a["most"]) for a, b in zip(slices, slices[1:]) if low <= first[b["slice"]] <= high]
    if not gaps:  # all of these ranks have one value
        last = ranked.filter(F.col("rank") <= low).agg(F.max("worth")).first()[0]
        return float(last)
    _, turned, below = max(gaps)
    return (below - turned) / 2


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
) -> Model | None:
    """The model from all labels given; None unless both classes have a document."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(id_col).agg(F.min(label_col).alias("_low"), F.max(label_col).alias("_high")).filter("_low = _high")
    texts = docs.select(id_col, F.col(text_col).alias("_text")).filter(F.col(id_col).isNotNull())
    # One document an id; only features travel to the labels.
    rows = _featured(texts, "_text").groupBy(id_col).agg(F.min("features").alias("features"))
    rows = staged(rows.join(known.select(id_col, "_low"), id_col))
    counts = {row["_low"]: row["count"] for row in rows.groupBy("_low").count().collect()}
    if len(counts) < 2:
        return None
    order = [F.xxhash64(id_col), F.col(id_col)]
    sample = [row for label in (0, 1) for row in rows.filter(F.col("_low") == label).orderBy(*order).limit(max_labelled).collect()]
    good = np.array([row["_low"] == 1 for row in sample], dtype=bool)
    features = np.array([row["features"] for row in sample])
    order = np.lexsort((*features.T, good))
    model = fit_pairs(features[order], good[order])
    return model._replace(threshold=widest_gap(_worths(rows, model), counts[0] / sum(counts.values())))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", threshold_score: float = 0.5) -> DataFrame:
    """Add ``score``, from 0 to 1; documents at the model's threshold have ``threshold_score``."""
    shift = float(np.log(threshold_score / (1 - threshold_score)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                values = np.ones(batch.num_rows)
            else:
                rows = [text_features(text.as_py()) for text in batch.column(text_col)]
                value = worth(np.array(rows).reshape(-1, len(FEATURES)), model) - model.threshold
                values = 1 / (1 + np.exp(-np.clip(value + shift, -500, 500)))
            columns = {name: batch.column(name) for name in names}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(values)})

    docs = docs.drop("score")
    names = docs.columns
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def held_out(id_col: str = "doc_id"):
    """True for the fifth of ids that are never learnt from; null ids are learnt from neither."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))

"""One-hot vectors for columns with very many categories, from a vocabulary table instead of one column each."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from pacelake.operators.features import value_counts
from pacelake.operators.ordering import number_rows
from pacelake.session import MAX_BROADCAST_ROWS, staged

_VALUE, _INDEX, _VECTOR = "_hot_value", "_hot_index", "_hot_vector"


def hot(column: str) -> str:
    """Name of a column's vector."""
    return f"{column}_hot"


def _unit(place: Column, size: int) -> Column:
    """Sparse vector of ``size`` with a 1 at ``place``, empty where that is NULL.

    Spark's encoder describes every category in the column's metadata, which the driver holds; this has none.
    """

    @F.pandas_udf(VectorUDT())
    def vector(places: pd.Series) -> pd.DataFrame:
        known = places.notna()
        at = [[int(i)] if k else [] for i, k in zip(places, known)]
        return pd.DataFrame({
            "type": pd.Series(0, places.index, dtype="int8"), "size": pd.Series(size, places.index, dtype="int32"),
            "indices": at, "values": [[1.0] * len(i) for i in at],
        }, index=places.index)

    return vector(place)


@dataclass
class SparseOneHot:
    """A sparse 0/1 vector per categorical column, with a place for every category in sorted order.

    Unlike the dense encoder, two categories have two places. NULL counts as the most frequent
    value, the smaller one on a tie; an unknown value gives an empty vector. The vocabulary stays
    a table (column, v, n, index) in the shared folder; the driver holds only its size and the fill
    value of each column.
    """

    vocabulary: DataFrame
    sizes: dict[str, int]
    fill: dict[str, str]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> SparseOneHot:
        counted = staged(value_counts(df, columns))
        vocabulary = staged(number_rows(counted, ["column"], ["v"], "index"))
        usual = F.min_by("v", F.struct(-F.col("n"), "v"))
        found = {r["column"]: r for r in vocabulary.groupBy("column").agg(F.count("*").alias("size"), usual.alias("v")).collect()}
        # A column without any value still needs a vector that holds nothing.
        sizes = {c: found[c]["size"] if c in found else 1 for c in columns}
        return cls(vocabulary, sizes, {c: r["v"] for c, r in found.items()})

    def _words(self, column: str) -> DataFrame:
        """A column's part of the vocabulary; broadcast only if it is known to be small."""
        words = self.vocabulary.filter(F.col("column") == column).select(F.col("v").alias(_VALUE), F.col("index").alias(_INDEX))
        return F.broadcast(words) if self.sizes[column] <= MAX_BROADCAST_ROWS else words

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace each column by its vector, named ``<column>_hot``."""
        for i, (c, size) in enumerate(self.sizes.items()):
            value = F.col(f"`{c}`").cast("string")
            if c in self.fill:
                value = F.coalesce(value, F.lit(self.fill[c]))
            df = df.withColumn(_VALUE, value).join(self._words(c), _VALUE, "left")
            df = df.withColumn(f"{_VECTOR}_{i}", _unit(F.col(_INDEX), size)).drop(_VALUE, _INDEX)
        return df.drop(*self.sizes).withColumnsRenamed({f"{_VECTOR}_{i}": hot(c) for i, c in enumerate(self.sizes)})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """Category of the largest value above 0, the first of equal ones; NULL where there is none.

        Vectors may be sparse or dense, such as predicted ones.
        """
        for c in self.sizes:
            vector = F.unwrap_udt(F.col(f"`{hot(c)}`"))
            best = F.array_max(vector["values"])
            at = F.array_position(vector["values"], best).cast("int") - 1
            place = F.when(vector["type"] == 0, F.get(vector["indices"], at)).otherwise(at)
            df = df.withColumn(_INDEX, F.when(best > 0, place).cast("long")).join(self._words(c), _INDEX, "left")
            df = df.withColumnRenamed(_VALUE, c).drop(_INDEX, hot(c))
        return df

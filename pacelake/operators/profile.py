"""Profiles of whole tables: histograms, summaries, null shares, correlations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pacelake.functions.scalars import sleep_hours
from pacelake.operators.quantiles import exact_quantiles
from pacelake.schemas import SPARSE_SHARE

QUARTILES = [0.25, 0.5, 0.75]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    left_out = set(exclude)
    return sorted(
        f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in left_out
    )


def time_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Timestamp columns, with or without zone."""
    kinds = (T.TimestampType, T.TimestampNTZType)
    return sorted(f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in set(exclude))


def other_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    known = {*numeric_columns(df), *time_columns(df), *exclude}
    return sorted(c for c in df.columns if c not in known)


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over the non-null values; empty bins show 0, the last is closed."""
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    low, high = values.agg(F.min("v"), F.max("v")).first()
    spine = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    if low is None:
        return spine.withColumn("low", F.lit(None).cast("double")).withColumn("n", F.lit(0).cast("long"))
    if low == high:
        low, high = low - 0.5, high + 0.5
    bin_of = F.least(
        F.width_bucket("v", F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins).cast("long")
    )
    counts = values.groupBy(bin_of.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    edge = F.lit(low) + (F.col("bin") - 1) * F.lit((high - low) / bins)
    return spine.join(counts, "bin", "left").select("bin", edge.alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample standard deviation, min, quartiles and max per column."""
    quartiles = exact_quantiles(df, columns, QUARTILES)
    rows = []
    for c in columns:
        q25, q50, q75 = (F.lit(v).cast("double") for v in quartiles[c])
        v = F.col(c).cast("double")
        rows.append(F.struct(
            F.lit(c).alias("column"), F.count(v).alias("count"), F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"), F.min(v).alias("min"), q25.alias("p25"),
            q50.alias("p50"), q75.alias("p75"), F.max(v).alias("max"),
        ))
    return _rows_of_one_pass(df, rows)


def _rows_of_one_pass(df: DataFrame, rows: list[Column]) -> DataFrame:
    """All aggregates in one pass, then one output row per struct."""
    return df.agg(F.array(*rows).alias("_rows")).select(F.explode("_rows").alias("r")).select("r.*")


def null_share(df: DataFrame, columns: Sequence[str], divisor: int | None = None) -> DataFrame:
    """Share of nulls per column, largest first; per cent of ``divisor`` rows if given."""
    rows = []
    for c in columns:
        nulls = F.count_if(F.col(c).isNull())
        share = nulls / F.count(F.lit(1)) if divisor is None else nulls / F.lit(divisor) * 100
        rows.append(F.struct(F.lit(c).alias("column"), share.alias("null_share")))
    return _rows_of_one_pass(df, rows).orderBy(F.desc("null_share"), "column")


def null_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of rows, and of nulls per column, in one pass."""
    nulls = [F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns]
    total, *counts = df.agg(F.count(F.lit(1)), *nulls).first()
    return total, dict(zip(df.columns, counts))


def sparse_columns(df: DataFrame, share: float = SPARSE_SHARE) -> list[str]:
    """Columns whose nulls make up at least ``share`` of the rows."""
    total, nulls = null_counts(df)
    return [c for c, n in nulls.items() if n >= total * share]


def drop_sparse(df: DataFrame, share: float = SPARSE_SHARE, keep: Sequence[str] = ()) -> DataFrame:
    return df.drop(*[c for c in sparse_columns(df, share) if c not in set(keep)])


def drop_empty(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns without any value."""
    return drop_sparse(df, 1.0, keep)


_PRODUCTS = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"


def _cross_products(centres: Sequence[float]):
    """Sums over the rows of a task where both columns of a pair are known, for all pairs at once."""
    width = len(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sx, sxx, sxy = np.zeros((4, width, width))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - np.array(centres)
            known = (~np.isnan(x)).astype(np.float64)
            x = np.nan_to_num(x, nan=0.0, posinf=np.inf, neginf=-np.inf)
            n += known.T @ known
            sx += x.T @ known
            sxx += (x * x).T @ known
            sxy += x.T @ x
        i, j = np.indices((width, width), dtype=np.int32)
        cells = [i, j, n, sx, sx.T, sxx, sxx.T, sxy]
        names = [part.split()[0] for part in _PRODUCTS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel()) for c in cells], names)

    return run


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, each over the rows where both are known.

    NaN counts as unknown. NULL where a column has fewer than two different values. Every task
    sends one row a pair. A first pass finds the means, around which the products are taken.
    """
    columns = list(columns)
    cast = [F.col(f"`{c}`").cast("double") for c in columns]
    values = df.select(*[F.when(~F.isnan(c), c).alias(f"c{i}") for i, c in enumerate(cast)])
    means = values.agg(*[F.avg(c) for c in values.columns]).first()
    centres = [m if m is not None else 0.0 for m in means]
    sums = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    products = values.mapInArrow(_cross_products(centres), _PRODUCTS).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in sums])
    var_x = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    var_y = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    # what rounding leaves of a constant column is no variance
    varies = (F.col("n") > 1) & (var_x > 1e-12 * F.col("sxx")) & (var_y > 1e-12 * F.col("syy"))
    r = F.when(varies, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(var_x * var_y))
    pairs = [(i, j, a, b) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    named = df.sparkSession.createDataFrame(pairs, "i int, j int, a string, b string")
    return named.join(products.select("i", "j", r.alias("r")), ["i", "j"], "left").select("a", "b", "r")


def mean_sleep_hours(df: DataFrame, phases: Sequence[str]) -> DataFrame:
    return df.agg(F.avg(sleep_hours(*phases)).alias("mean_sleep_h"))


def distinct_sports(df: DataFrame) -> DataFrame:
    return df.select("sport").filter("sport IS NOT NULL").distinct()


def count_sports(df: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count("sport").alias("sports"))

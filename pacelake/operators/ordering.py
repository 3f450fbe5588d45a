"""Row positions, running sums and newest-n per group, safe against huge groups.

A running sum needs its group in order. While every group fits one task, a plain window
does it with one shuffle. Where one athlete holds more rows than a task should sort, the
table is split by range on (group, order) instead, so that a group spans many tasks: each
slice sums its own rows, and the totals of earlier slices are added afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pacelake.session import MAX_GROUP_ROWS, cut_lineage

_SLICE = "_slice"


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the largest group; one pre-aggregated count over the key columns."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    weight: Column,
    name: str,
    max_group_rows: int = MAX_GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Add ``name``: sum of ``weight`` over the group's rows up to and including this one.

    ``order`` names columns, ascending, and must be total within a group. ``largest`` bounds the
    rows of a group, if that is known; else they are counted.
    """
    keys, order = list(keys), list(order)
    if (largest_group(df, keys) if largest is None else largest) <= max_group_rows:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        return df.withColumn(name, F.sum(weight).over(upto))
    return _running_sum_by_range(df, keys, order, weight, name)


def _running_sum_by_range(
    df: DataFrame, keys: list[str], order: list[str], weight: Column, name: str
) -> DataFrame:
    # Both readers below must see one and the same split, also after a lost executor.
    sliced = cut_lineage(
        df.repartitionByRange(*keys, *order).withColumn(_SLICE, F.spark_partition_id())
    )
    within = Window.partitionBy(*keys, _SLICE).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        sliced.groupBy(*keys, _SLICE)
        .agg(F.sum(weight).alias("_total"))
        .withColumn("_before", F.sum("_total").over(earlier))
        # A group that starts in its slice has nothing before it. What is left is at most
        # one group per slice, the one running on from the slice before.
        .filter(F.col("_before").isNotNull())
        .drop("_total")
    )
    return (
        sliced.withColumn(name, F.sum(weight).over(within))
        .join(F.broadcast(before), [*keys, _SLICE], "left")
        .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
        .drop("_before", _SLICE)
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "pos",
    max_group_rows: int = MAX_GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """0-based position of each row in its group."""
    out = running_sum(df, keys, order, F.lit(1).cast("long"), name, max_group_rows, largest)
    return out.withColumn(name, F.col(name) - 1)


def drop_first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Drop the earliest row of each group."""
    numbered = number_rows(df, keys, order, "_pos")
    return numbered.filter("_pos >= 1").drop("_pos")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One whole row per key, the first in ``order``; pre-aggregated before the shuffle."""
    names = {c: F.col(f"`{c}`") for c in df.columns}  # a name may hold dots
    rest = [column for c, column in names.items() if c not in set(keys)]
    row = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*").select(*names.values())


def newest_per_key(
    df: DataFrame, keys: Sequence[str], time: str, tiebreak: str, n: int, skip: int = 0
) -> DataFrame:
    """Newest ``n`` rows per key after skipping the ``skip`` newest; adds ``age`` (1 = newest).

    Every task keeps only its own newest rows of a key before the shuffle, so a hot key
    sends at most n + skip rows per task. Beyond the limit up to which Spark does that by
    itself, a salted first round does it.
    """
    last = n + skip
    newest = [F.col(time).desc(), F.col(tiebreak).desc()]
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if last > limit:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(tiebreak)), F.lit(256)))
        rank = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*newest))
        df = salted.withColumn("_rank", rank).filter(F.col("_rank") <= last).drop("_rank", "_salt")
    age = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
    out = df.withColumn("age", age).filter(F.col("age") <= last)
    return out.filter(F.col("age") > skip) if skip else out


def newest_time(
    df: DataFrame, keys: Sequence[str], time: str, before: Column | None = None
) -> DataFrame:
    """Newest timestamp per key, or the newest one strictly before ``before``."""
    value = F.col(time) if before is None else F.when(F.col(time) < before, F.col(time))
    return df.groupBy(*keys).agg(F.max(value).alias("newest"))

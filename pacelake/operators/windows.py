"""Windows of past history rows in front of an anchor: a session, or a date.

Every kind of window is reduced to "the n history rows that end before position e". The
history is packed once into overlapping chunks of at most 2n rows, and each anchor then
meets exactly one chunk in an equi-join on (athlete, chunk). So no history row is copied
more than twice, and an athlete with a very long history spreads over many chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pacelake.functions.scalars import whole_second
from pacelake.operators.ordering import largest_group, newest_per_key, number_rows, running_sum
from pacelake.schemas import WINDOW_ROWS
from pacelake.session import MAX_GROUP_ROWS

USER = "user_id"
SUMMARY_WINDOWS = 512


def pack_chunks(numbered: DataFrame, columns: Sequence[str], n: int, pos: str = "pos") -> DataFrame:
    """(user, chunk, rows): chunk c holds positions n(c-1) up to n(c+1)-1 in order."""
    home = F.floor(F.col(pos) / n)
    item = F.struct(F.col(pos).alias("pos"), *columns)
    return (
        numbered.select(USER, F.explode(F.array(home, home + 1)).alias("chunk"), item.alias("item"))
        .groupBy(USER, "chunk")
        .agg(F.array_sort(F.collect_list("item")).alias("rows"))
    )


def rows_before(
    chunks: DataFrame, anchors: DataFrame, end: str, n: int, keep: Column | None = None
) -> DataFrame:
    """Add ``window``: array of the rows at positions end-n up to end-1, oldest first.

    ``keep`` may name a further cut: a column of ``anchors`` that each row's ``begin``
    must lie before.
    """
    chunk = F.floor((F.col(end) - 1) / n)
    found = anchors.withColumn("chunk", chunk).join(chunks, [USER, "chunk"], "left")
    low, high = F.col(end) - n, F.col(end)

    def inside(r: Column) -> Column:
        cond = (r["pos"] >= low) & (r["pos"] < high)
        return cond & (r["begin"] < keep) if keep is not None else cond

    rows = F.coalesce("rows", F.array().cast(chunks.schema["rows"].dataType))
    window = F.filter(rows, inside)
    if keep is None:
        # Positions follow each other, so that the rows need not be looked at one by one.
        first, last = F.get(rows, F.lit(0))["pos"], F.get(rows, F.size(rows) - 1)["pos"]
        start = F.greatest(low, first)
        part = F.slice(rows, (start - first + 1).cast("int"), F.greatest(high - start, F.lit(0)).cast("int"))
        window = F.when(last - first + 1 == F.size(rows), part).otherwise(window)
    return found.withColumn("window", window).drop("rows", "chunk")


def count_before(
    history: DataFrame,
    anchors: DataFrame,
    begin: str,
    row_id: str,
    at: str,
    max_group_rows: int = MAX_GROUP_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Add ``n_before`` to ``anchors``: number of history rows of the athlete with begin < at.

    Union and running count instead of a range join. At equal times the anchor sorts first.
    ``largest`` bounds an athlete's rows and anchors together, if that is known.
    """
    rows = history.select(
        USER, F.col(begin).alias("_t"), F.lit(1).cast("long").alias("_is_row"), F.col(row_id).alias("_id")
    )
    marks = anchors.withColumns({"_t": F.col(at), "_is_row": F.lit(0).cast("long")})
    both = marks.unionByName(rows, allowMissingColumns=True)
    counted = running_sum(
        both, [USER], ["_t", "_is_row", "_id"], F.col("_is_row"), "n_before", max_group_rows, largest
    )
    return counted.filter("_is_row = 0").select(*anchors.columns, "n_before")


def training_windows(
    history: DataFrame,
    sessions: DataFrame,
    columns: Sequence[str],
    *,
    begin: str = "begin_ts",
    row_id: str = "row_id",
    start: str = "start_time",
    session_id: str = "activity_id",
    n: int = WINDOW_ROWS,
    mode: str = "reference",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Sessions from number n on, each with the window of history rows in front of it.

    ``mode="reference"`` takes history positions i-n .. i-1 for session number i, as far
    as they begin before the session; history and session numbers need not match, so a
    window can be short. ``mode="asof"`` takes the true last n rows before the session.
    """
    most_rows, most_sessions = largest_group(history, [USER]), largest_group(sessions, [USER])
    past = number_rows(history, [USER], [begin, row_id], "pos", max_group_rows, most_rows)
    chunks = pack_chunks(past, [F.col(begin).alias("begin"), *columns], n)
    marks = number_rows(sessions, [USER], [start, session_id], "session_no", max_group_rows, most_sessions)
    marks = marks.filter(F.col("session_no") >= n).withColumn("_cut", whole_second(start))
    if mode == "reference":
        out = rows_before(chunks, marks, "session_no", n, keep=F.col("_cut"))
    elif mode == "asof":
        marks = count_before(history, marks, begin, row_id, "_cut", max_group_rows, most_rows + most_sessions)
        out = rows_before(chunks, marks, "n_before", n).drop("n_before")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return out.drop("_cut")


def window_for_date(
    history: DataFrame,
    date: Column,
    *,
    begin: str = "begin_ts",
    row_id: str = "row_id",
    n: int = WINDOW_ROWS,
    skip_latest: bool = True,
) -> DataFrame:
    """Per athlete, the rows of the window in front of one date, one row each, with ``age``.

    The newest row before the date is left out by default: the window is the n before it.
    """
    past = history.filter(F.col(begin) < whole_second(date))
    return newest_per_key(past, [USER], begin, row_id, n, skip=1 if skip_latest else 0)


def day_anchors(history: DataFrame, days: int, begin: str = "begin_ts") -> DataFrame:
    """(user, days_back, anchor): newest begin minus 0 .. days-1 days, in whole seconds."""
    newest = history.groupBy(USER).agg(F.max(begin).alias("_newest"))
    back = newest.select(USER, "_newest", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("days_back"))
    shifted = F.col("_newest") - F.make_dt_interval(days=F.col("days_back"))
    return back.select(USER, "days_back", whole_second(shifted).alias("anchor"))


def windows_for_anchors(
    history: DataFrame,
    anchors: DataFrame,
    columns: Sequence[str],
    *,
    at: str = "anchor",
    begin: str = "begin_ts",
    row_id: str = "row_id",
    n: int = WINDOW_ROWS,
    skip_latest: bool = True,
    max_group_rows: int = MAX_GROUP_ROWS,
    days: int | None = None,
) -> DataFrame:
    """Windows in front of any number of anchors per athlete.

    ``days`` says that all anchors are within the last days; only rows that these can hold are packed.
    """
    past = number_rows(history, [USER], [begin, row_id], "pos", max_group_rows)
    if days is not None:
        past = recent_rows(past, days, begin=begin, row_id=row_id, n=n)
    chunks = pack_chunks(past, [F.col(begin).alias("begin"), *columns], n)
    marks = count_before(history, anchors, begin, row_id, at, max_group_rows)
    end = F.col("n_before") - (1 if skip_latest else 0)
    return rows_before(chunks, marks.withColumn("_end", end), "_end", n).drop("_end", "n_before")


def recent_rows(
    history: DataFrame, days: int, *, begin: str = "begin_ts", row_id: str = "row_id", n: int = WINDOW_ROWS
) -> DataFrame:
    """The rows that windows of the last ``days`` days can hold.

    Those from the oldest anchor on, and the n + 1 newest before it, which a task cuts before
    the shuffle. Rows without a time count as oldest.
    """
    newest = history.groupBy(USER).agg(F.max(begin).alias("_newest"))
    oldest = whole_second(F.col("_newest") - F.make_dt_interval(days=F.lit(days - 1)))
    # the athlete's own column of that name, if any, steps aside for the age of a row
    rows = history.withColumnRenamed("age", "_own_age").join(newest.select(USER, oldest.alias("_oldest")), USER)
    later = F.coalesce(F.col(begin) >= F.col("_oldest"), F.lit(False))
    earlier = newest_per_key(rows.filter(~later), [USER], begin, row_id, n + 1).drop("age")
    found = earlier.unionByName(rows.filter(later)).drop("_oldest")
    return found.withColumnRenamed("_own_age", "age").select(*[F.col(f"`{c}`") for c in history.columns])


def windows_for_last_days(history: DataFrame, columns: Sequence[str], days: int = 30, **kw) -> DataFrame:
    """Windows in front of each of the last ``days`` days of every athlete."""
    anchors = day_anchors(history, days, kw.get("begin", "begin_ts"))
    return windows_for_anchors(history, anchors, columns, days=days, **kw)


def feature_vector(df: DataFrame, columns: Sequence[str], name: str = "x") -> DataFrame:
    """Add the feature columns as one array; a missing cell counts as 0, as padding does."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns]
    return df.withColumn(name, F.array(*cells))


def _summary(width: int):
    """Mean, last value and trend of each window, one after the other; windows come as flat arrays.

    Rows are added in order, windows of equal length together.
    """

    def run(flat: pa.Array) -> pa.Array:
        size = np.diff(flat.offsets.to_numpy()) // max(width, 1)
        cells = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat.flatten()) // max(width, 1), width)
        start = np.cumsum(size) - size
        out = np.zeros((len(size), 3, width))
        for n in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == n)
            half = n // 2
            for low in range(0, len(at), SUMMARY_WINDOWS):
                part = at[low:low + SUMMARY_WINDOWS]
                rows = cells[start[part][:, None] + np.arange(n)]
                older, newer = rows[:, :half].sum(axis=1), rows[:, half:].sum(axis=1)
                out[part, 0] = (older + newer) / n
                out[part, 1] = rows[:, -1]
                out[part, 2] = newer / (n - half) - older / max(half, 1)
        ends = pa.array(np.arange(len(size) + 1) * 3 * width, pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(out.ravel()))

    return F.arrow_udf(run, "array<double>")


def summarise(df: DataFrame, width: int, window: str = "window") -> DataFrame:
    """Per window of rows with a feature array ``x``: row count, and arrays with the mean,
    the last value and the trend of each feature.

    The trend is the mean of the newer half minus the mean of the older half. An empty
    window gives 0.
    """
    flat = F.flatten(F.transform(window, lambda r: r["x"]))
    sums = df.withColumn("window_rows", F.size(window)).withColumn("_summary", _summary(width)(flat))
    parts = ("window_mean", "window_last", "window_trend")
    return sums.withColumns({
        name: F.slice("_summary", i * width + 1, width) for i, name in enumerate(parts)
    }).drop("_summary")


def flat_matrix(df: DataFrame, width: int, n: int, window: str = "window") -> DataFrame:
    """Add ``matrix``: n times ``width`` numbers, oldest row first, short windows padded
    with 0 in front."""
    cells = F.flatten(F.transform(window, lambda r: r["x"]))
    short = F.lit(n) - F.size(window)
    pad = F.array_repeat(F.lit(0.0), short * width)
    return df.withColumns({"matrix": F.concat(pad, cells), "padded_rows": short})

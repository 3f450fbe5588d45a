"""Joins of nights, workouts and days to one history per athlete."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pacelake.session import is_small


def sleep_with_workouts(
    sleep: DataFrame, workouts: DataFrame, day: str = "date", how: str = "left"
) -> DataFrame:
    """Night and workouts of the same day; a night repeats once per workout.

    ``how="left"`` keeps nights without a workout, ``"inner"`` drops them.
    """
    return sleep.join(workouts, ["user_id", day], how)


def with_daily(history: DataFrame, daily: DataFrame, day: str = "calendarDate") -> DataFrame:
    """Add the daily values; ``daily`` holds one row per athlete and day.

    A daily column named like one of the history gets the suffix ``_daily``.
    """
    shared = [c for c in daily.columns if c in history.columns and c not in ("user_id", day)]
    daily = daily.withColumnsRenamed({c: f"{c}_daily" for c in shared})
    return history.join(daily, ["user_id", day], "left")


def merge_history(sleep: DataFrame, workouts: DataFrame, daily: DataFrame) -> DataFrame:
    """Cleaned sleep, workouts and days as one history table keyed by athlete and day."""
    nights = sleep_with_workouts(sleep, workouts).withColumnRenamed("date", "calendarDate")
    return with_daily(nights, daily)


def rows_per_model(rows: DataFrame, models: DataFrame, limit: int = 1000) -> DataFrame:
    """Every input row once per selected model, from a table of model names.

    The list of models is short; more than ``limit`` are an error, as each row is repeated
    per model.
    """
    if not is_small(models, limit):
        raise ValueError(f"more than {limit} models selected")
    names = [r[0] for r in models.select("model_name").distinct().sort("model_name").collect()]
    return rows.withColumn("model_name", F.explode(F.array(*[F.lit(n) for n in names])))


def tag_union(**sources: DataFrame) -> DataFrame:
    """Stack tables over the first one's columns, each row tagged with its source."""
    first = next(iter(sources.values())).columns
    out = None
    for name, df in sources.items():
        part = df.select(F.lit(name).alias("source"), *first)
        out = part if out is None else out.unionByName(part)
    return out


def stack(*tables: DataFrame) -> DataFrame:
    """Stack tables with the union of their columns; gaps are NULL."""
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out

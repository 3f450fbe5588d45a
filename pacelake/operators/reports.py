"""Descriptive reports over sessions. Column names are parameters with usual defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pacelake.functions.scalars import in_month, kilometres, kmh, month_start, round_half_even
from pacelake.operators.ordering import newest_per_key
from pacelake.schemas import CROSS_TABLE_SPORTS, SPEED_TREND_SPORTS


def _sum_or_zero(c: Column | str) -> Column:
    """A group without any value sums to 0, not to NULL."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def workouts_per_month(df: DataFrame, end: str = "timestamp") -> DataFrame:
    return df.groupBy(month_start(end).alias("month")).agg(F.count("*").alias("workouts"))


def workouts_per_sport(df: DataFrame, ordered: bool = True) -> DataFrame:
    """Most frequent sport first; sessions without a sport do not count."""
    out = df.filter("sport IS NOT NULL").groupBy("sport").agg(F.count("*").alias("workouts"))
    return out.orderBy(F.desc("workouts"), "sport") if ordered else out


def distance_by_year_month(
    df: DataFrame, end: str = "timestamp", distance: str = "total_distance"
) -> DataFrame:
    keys = [F.year(end).alias("year"), F.month(end).alias("month")]
    return df.filter(F.col(end).isNotNull()).groupBy(*keys).agg(_sum_or_zero(distance).alias("distance"))


def distance_by_day(
    df: DataFrame, year: int, month: int, start: str = "start_time", distance: str = "total_distance"
) -> DataFrame:
    chosen = df.filter(in_month(start, year, month))
    return chosen.groupBy(F.dayofmonth(start).alias("day")).agg(_sum_or_zero(distance).alias("distance"))


def calories_and_km_by_month(
    df: DataFrame, end: str = "timestamp", calories: str = "total_calories",
    distance: str = "total_distance", by_year: bool = False,
) -> DataFrame:
    """Month 1-12 with all years pooled, unless ``by_year``."""
    keys = [F.month(end).alias("month")]
    if by_year:
        keys.insert(0, F.year(end).alias("year"))
    return df.filter(F.col(end).isNotNull()).groupBy(*keys).agg(
        _sum_or_zero(calories).alias("calories"),
        _sum_or_zero(kilometres(distance)).alias("km"),
    )


def moving(df: DataFrame, speed: str = "enhanced_avg_speed") -> DataFrame:
    """Sessions with a known speed above zero."""
    return df.filter(F.col(speed) > 0)


def speed_trend(
    df: DataFrame, end: str = "timestamp", speed: str = "enhanced_avg_speed",
    sports: Sequence[str] = SPEED_TREND_SPORTS,
) -> DataFrame:
    """Mean km/h per sport and month; months in between without sessions show as NULL."""
    monthly = (
        moving(df, speed)
        .filter(F.col("sport").isin(*sports))
        .groupBy("sport", month_start(end).alias("month"))
        .agg(round_half_even(F.avg(F.col(speed) * 3.6), 2).alias("avg_kmh"))
    )
    months = F.sequence(F.min("month"), F.max("month"), F.expr("INTERVAL 1 MONTH"))
    spine = monthly.groupBy("sport").agg(months.alias("m")).select("sport", F.explode("m").alias("month"))
    return spine.join(monthly, ["sport", "month"], "left")


def workouts_per_day(df: DataFrame, end: str = "timestamp", activity: str = "activity_id") -> DataFrame:
    return df.groupBy(F.to_date(end).alias("day")).agg(F.count(activity).alias("workouts"))


def day_sport_table(
    df: DataFrame, end: str = "timestamp", sports: Sequence[str] = CROSS_TABLE_SPORTS
) -> DataFrame:
    """Day by sport counts. A day with other sports only stays as a row of zeros."""
    known = df.filter("sport IS NOT NULL").groupBy(F.to_date(end).alias("day"))
    return known.agg(*[F.count_if(F.col("sport") == s).alias(s) for s in sports])


def mean_by_sport(df: DataFrame, value: str = "max_heart_rate") -> DataFrame:
    return df.filter("sport IS NOT NULL").groupBy("sport").agg(F.avg(value).alias(f"mean_{value}"))


def cadence_speed_points(df: DataFrame) -> DataFrame:
    """Points of the cadence against speed chart."""
    points = df.select("avg_cadence", "enhanced_avg_speed", "sport")
    return points.dropna(subset=["avg_cadence", "enhanced_avg_speed"])


def xy_points(df: DataFrame, y: Column, features: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """One (feature, x, y) row per row and feature, for scatter charts against one value."""
    shaped = df.select(*ids, y.alias("y"), *[F.col(c).cast("double").alias(c) for c in features])
    return shaped.unpivot([*ids, "y"], list(features), "feature", "x")


def last_sessions(
    df: DataFrame, sport: str, n: int, keys: Sequence[str] = ("user_id",),
    time: str = "start_time", activity: str = "activity_id",
) -> DataFrame:
    """Last n sessions of one sport per athlete: rank 1..n oldest first, km and heart rate."""
    newest = newest_per_key(df.filter(F.col("sport") == sport), keys, time, activity, n)
    kept = F.count("*").over(Window.partitionBy(*keys))  # at most n rows per athlete
    return newest.withColumn("_n", kept).select(
        *keys, activity, (F.col("_n") - F.col("age") + 1).alias("rank"),
        kilometres("total_distance").alias("km"), "avg_heart_rate",
    )


def last_rows_where(
    df: DataFrame, n: int, condition: Column, keys: Sequence[str] = ("user_id",),
    time: str = "start_time", activity: str = "activity_id",
) -> DataFrame:
    """Of the last n rows per athlete, those that meet a condition."""
    return newest_per_key(df, keys, time, activity, n).filter(condition).drop("age")


def with_elapsed(df: DataFrame, time: str = "timestamp", activity: Sequence[str] = ("activity_id",)) -> DataFrame:
    """Add seconds since the first sample of the workout.

    The first time per workout is pre-aggregated and joined back, so a workout with very
    many samples is never sorted or held as one group.
    """
    first = df.groupBy(*activity).agg(F.min(time).alias("_first"))
    micros = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("_first").cast("timestamp"))
    joined = df.join(first, list(activity), "left")
    return joined.withColumn("elapsed_s", micros / F.lit(1e6)).drop("_first")


def compare_with_history(
    predicted: DataFrame, sessions: DataFrame, features: Sequence[str], sport: str, n: int,
    keys: Sequence[str] = ("user_id",), time: str = "timestamp", activity: str = "activity_id",
) -> DataFrame:
    """(feature, predicted, historical average) against the newest n sessions of one sport.

    ``predicted`` holds one row per athlete.
    """
    keys = list(keys)
    recent = newest_per_key(sessions.filter(F.col("sport") == sport), keys, time, activity, n)
    means = recent.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in features])
    past = means.unpivot(keys, list(features), "feature", "historical_average")
    ahead = predicted.select(*keys, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(
        keys, list(features), "feature", "predicted"
    )
    return ahead.join(past, [*keys, "feature"], "left")


def speed_kmh(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: kmh(c) for c in columns})

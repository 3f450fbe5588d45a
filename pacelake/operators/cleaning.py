"""Cleaning of the exported tables: typed columns, one row per night or day."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pacelake.functions.scalars import element_or_null, millis_to_day, millis_to_timestamp, nested_or_null
from pacelake.operators.ordering import first_per_key
from pacelake.schemas import (
    DAILY_DROP, DAILY_FIRST_DAY, SLEEP_DROP, SLEEP_PHASES, WORKOUT_COLUMNS,
)

FILE_ORDER = "_file_order"


def with_file_order(df: DataFrame) -> DataFrame:
    """Add what "first in file order" means for rows read from files."""
    name = F.col("_metadata.file_path")
    start = F.col("_metadata.file_block_start")
    return df.withColumn(FILE_ORDER, F.struct(name, start, F.monotonically_increasing_id().alias("row")))


def _first(df: DataFrame, keys: list[str], tiebreak: str | None) -> DataFrame:
    order = tiebreak or (FILE_ORDER if FILE_ORDER in df.columns else None)
    if order:
        return first_per_key(df, keys, [order])
    # Without a declared order, the whole row decides, so the result does not vary.
    return first_per_key(df, keys, sorted(c for c in df.columns if c not in keys))


def one_sleep_per_span(df: DataFrame, day: str, start: str, end: str, tiebreak: str | None = None) -> DataFrame:
    """First row per (athlete, day, sleep start, sleep end)."""
    return _first(df, ["user_id", day, start, end], tiebreak)


def one_row_per_day(
    df: DataFrame, day: str = "calendarDate", tiebreak: str | None = None, first_day: str | None = None
) -> DataFrame:
    """First row per (athlete, day), from ``first_day`` on."""
    if first_day:
        df = df.filter(F.col(day) >= F.lit(first_day).cast("date"))
    return _first(df, ["user_id", day], tiebreak)


def clean_sleep(raw: DataFrame, tiebreak: str | None = None) -> DataFrame:
    """One row per sleep span with typed times, four phases and the quality score."""
    nights = one_sleep_per_span(
        raw.drop(*SLEEP_DROP), "calendarDate", "sleepStartTimestampGMT", "sleepEndTimestampGMT", tiebreak
    )
    return nights.select(
        "user_id",
        F.to_date("calendarDate").alias("date"),
        F.col("sleepStartTimestampGMT").cast("timestamp_ntz").alias("start_sleep"),
        F.col("sleepEndTimestampGMT").cast("timestamp_ntz").alias("end_sleep"),
        *SLEEP_PHASES,
        nested_or_null("sleepScores", "qualityScore").alias("qualityScore"),
    )


def clean_workouts(raw: DataFrame, dedup: bool = False, tiebreak: str | None = None) -> DataFrame:
    """Workout summaries with times from epoch milliseconds. Equal begins stay by default."""
    if dedup:
        raw = _first(raw, ["user_id", "beginTimestamp"], tiebreak)
    begin = F.col("beginTimestamp")
    return raw.select("user_id", *WORKOUT_COLUMNS).withColumns(
        {"date": millis_to_day(begin), "beginTimestamp": millis_to_timestamp(begin)}
    )


def clean_daily(raw: DataFrame, tiebreak: str | None = None) -> DataFrame:
    """One row per day with the useful parts of the nested fields."""
    typed = raw.withColumn("calendarDate", F.to_date("calendarDate"))
    days = one_row_per_day(typed, "calendarDate", tiebreak, DAILY_FIRST_DAY)
    battery = nested_or_null("bodyBattery", "bodyBatteryStatList")
    stress = nested_or_null("allDayStress", "aggregatorList")
    breath = {
        f"respiration_{name}": nested_or_null("respiration", name)
        for name in ("avgWakingRespirationValue", "highestRespirationValue", "lowestRespirationValue")
    }
    return days.withColumns({
        "hydration_sweatLossInML": nested_or_null("hydration", "sweatLossInML"),
        **breath,
        # by position in the list, not by any type tag
        "bodyBattery_Highest": element_or_null(battery, 0, "statsValue"),
        "bodyBattery_Lowest": element_or_null(battery, 1, "statsValue"),
        "allDayStress_awake": element_or_null(stress, 1, "averageStressLevel"),
        "allDayStress_asleep": element_or_null(stress, 2, "averageStressLevel"),
    }).drop(*DAILY_DROP, FILE_ORDER)

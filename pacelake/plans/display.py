"""Readable summaries of sessions and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from pacelake.functions import scalars as S
from pacelake.schemas import DISPLAY_CODES, DISPLAY_HEADINGS

TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "dd/MM/yyyy HH:mm", "H:mm:ss"]


def _as_time(df: DataFrame, name: str):
    if isinstance(df.schema[name].dataType, T.StringType):
        return S.parse_time(name, TIME_FORMATS).cast("timestamp_ntz")
    return F.col(name)


def summarise_session(df: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """Calories, sport, distance, heart rates, speeds, duration, end and start per session."""
    start, end = _as_time(df, "start_time"), _as_time(df, "timestamp")
    seconds = S.duration_seconds(start, end)
    speed = S.kmh("enhanced_avg_speed")
    return df.select(
        *ids,
        F.col("total_calories").alias("calories"),
        F.upper("sport").alias("sport"),
        S.estimated_km(speed, seconds).alias("distance"),
        "max_heart_rate",
        "avg_heart_rate",
        speed.alias("avg_speed"),
        S.kmh("enhanced_max_speed").alias("max_speed"),
        S.duration_hours(seconds).alias("hours"),
        S.duration_minutes(seconds).alias("minutes"),
        end.alias("timestamp"),
        start.alias("start_time"),
    )


def summarise_predictions(df: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """Display table: units, duration, distance and benefit as text, under display headings."""
    seconds = S.duration_seconds(_as_time(df, "start_time"), _as_time(df, "timestamp"))
    shown = df.withColumns({
        "enhanced_avg_speed": S.kmh("enhanced_avg_speed"),
        "enhanced_max_speed": S.kmh("enhanced_max_speed"),
        "duration": S.duration_text(seconds),
        "total_distance": S.estimated_km(S.kmh("enhanced_avg_speed"), seconds),
        "188": S.benefit_text("188"),
    }).withColumnsRenamed(DISPLAY_CODES)
    headings = dict(DISPLAY_HEADINGS)
    if "model_name" in df.columns:
        headings["model_name"] = "Model name"
    return shown.select(*ids, *headings).withColumnsRenamed(headings)

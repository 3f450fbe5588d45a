"""Time of day as a point on the unit circle, and back."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from pacelake.functions.scalars import as_col


def time_angle(c: Column | str) -> Column:
    """Angle of the time of day; seconds are ignored."""
    minutes = F.hour(as_col(c)) * 60 + F.minute(as_col(c))
    return F.lit(2 * math.pi) * (minutes / F.lit(1440.0))


def encode_time(c: Column | str) -> tuple[Column, Column]:
    return F.sin(time_angle(c)), F.cos(time_angle(c))


def decode_hours(sine: Column | str, cosine: Column | str) -> Column:
    """Hours of the day in [0, 24) of a point, not only of points on the circle."""
    degrees = F.atan2(as_col(sine), as_col(cosine)) * F.lit(180 / math.pi)
    return F.when(degrees < 0, degrees + 360).otherwise(degrees) * F.lit(24.0) / F.lit(360.0)


def decode_time(sine: Column | str, cosine: Column | str, snap: bool = False) -> Column:
    """``H:MM:SS`` with each part truncated by itself, which can be a minute off after rounding
    errors; ``snap`` rounds to whole seconds first and is exact."""
    hours = decode_hours(sine, cosine)
    if snap:
        seconds = F.pmod(F.round(hours * 3600, 0).cast("long"), F.lit(86_400))
        h = F.floor(seconds / 3600)
        m = F.floor(F.pmod(seconds, F.lit(3600)) / 60)
        s = F.pmod(seconds, F.lit(60))
    else:
        h = F.floor(hours)
        m = F.floor(F.pmod(hours * 60.0, F.lit(60.0)))
        s = F.floor(F.pmod(hours * 3600.0, F.lit(60.0)))
    return F.format_string("%d:%02d:%02d", h.cast("int"), m.cast("int"), s.cast("int"))


def encode_times(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each time column by its ``_sin`` and ``_cos``."""
    out = {}
    for c in columns:
        out[f"{c}_sin"], out[f"{c}_cos"] = encode_time(c)
    return df.withColumns(out).drop(*columns)


def decode_times(df: DataFrame, columns: list[str], snap: bool = False) -> DataFrame:
    """Inverse of :func:`encode_times`, as text."""
    out = {c: decode_time(f"{c}_sin", f"{c}_cos", snap) for c in columns}
    return df.withColumns(out).drop(*[f"{c}_{part}" for c in columns for part in ("sin", "cos")])

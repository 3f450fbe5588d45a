"""Scalar functions over workouts, nights and predictions. All stay native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from pacelake.schemas import BENEFIT_LABELS

DAY_SECONDS = 86_400


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c: Column | str) -> Column:
    """NaN becomes NULL, as Spark sorts and compares NaN as a value."""
    return F.when(~F.isnan(as_col(c)), as_col(c))


def nested_or_null(c: Column | str, *path: str) -> Column:
    """Field of a struct column; NULL where the struct is missing."""
    out = as_col(c)
    for name in path:
        out = out.getField(name)
    return out


def element_or_null(c: Column | str, index: int, field: str) -> Column:
    """Field of the element at a 0-based position; NULL past the end of a short list."""
    return F.get(as_col(c), F.lit(index)).getField(field)


def json_number(c: Column | str, path: str) -> Column:
    return F.get_json_object(as_col(c), path).cast("double")


def millis_to_timestamp(c: Column | str) -> Column:
    return F.timestamp_millis(as_col(c)).cast("timestamp_ntz")


def millis_to_day(c: Column | str) -> Column:
    return millis_to_timestamp(c).cast("date")


def parse_time(c: Column | str, formats: Sequence[str]) -> Column:
    """First format that fits; NULL if none does."""
    return F.coalesce(*[F.try_to_timestamp(as_col(c), F.lit(f)) for f in formats])


_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?"
_MARK = r"[/.\-]"


def parse_free_time(c: Column | str, day_first: bool = False, on: str = "1970-01-01") -> Column:
    """Date, time or both in free form, told apart by shape alone; NULL if no shape fits or the date does not exist.

    ``2023-10-08``, ``08/10/2023`` and ``8.10.2023``, each with or without ``17:16`` or ``17:16:05.5``
    after a blank or T, and a bare ``17:16`` on the day ``on``. Of two numbers that can both be the month the
    first one is, or with ``day_first`` the second; where only one can be, that one is.
    """
    text = F.trim(as_col(c).cast("string"))

    def part(pattern: str, group: int) -> Column:
        found = F.regexp_extract(text, pattern, group)
        return F.when(found != "", found)

    def built(pattern: str, year: Column, month: Column, day: Column, clock: int) -> Column:
        hour, minute = (F.coalesce(part(pattern, clock + i), F.lit("0")).cast("int") for i in range(2))
        second = F.coalesce(part(pattern, clock + 2), F.lit("0")).cast("decimal(16,6)")
        made = F.call_function("try_make_timestamp_ntz", year, month, day, hour, minute, second)
        return F.when(F.regexp_like(text, F.lit(pattern)), made)

    clock = rf"(?:[ T]+{_CLOCK})?$"
    iso = rf"^(\d{{4}}){_MARK}(\d{{1,2}}){_MARK}(\d{{1,2}}){clock}"
    local = rf"^(\d{{1,2}}){_MARK}(\d{{1,2}}){_MARK}(\d{{4}}){clock}"
    bare = rf"^{_CLOCK}$"
    year, month, day = (part(iso, i).cast("int") for i in (1, 2, 3))
    one, two = (part(local, i).cast("int") for i in (1, 2))
    swapped = (two <= 12) if day_first else (one > 12)
    start = [F.lit(int(x)) for x in on.split("-")]
    return F.coalesce(
        built(iso, year, month, day, 4),
        built(local, part(local, 3).cast("int"), F.when(swapped, two).otherwise(one), F.when(swapped, one).otherwise(two), 4),
        built(bare, *start, 1),
    )


def round_half_even(c: Column | str, digits: int) -> Column:
    """Scale, round to the nearest whole number with ties to even, scale back."""
    scale = F.lit(10.0**digits)
    return F.rint(as_col(c) * scale) / scale


def kmh(speed: Column | str) -> Column:
    """m/s to km/h with two decimals, ties to even."""
    return round_half_even(as_col(speed) * F.lit(3.6), 2)


def kilometres(metres: Column | str) -> Column:
    return as_col(metres) / F.lit(1000.0)


def epoch_seconds(c: Column | str) -> Column:
    return F.unix_seconds(as_col(c).cast("timestamp"))


def duration_seconds(start: Column | str, end: Column | str) -> Column:
    """Whole seconds from start to end, modulo one day and never negative."""
    micros = F.unix_micros(as_col(end).cast("timestamp")) - F.unix_micros(
        as_col(start).cast("timestamp")
    )
    return F.pmod(F.floor(micros / F.lit(1_000_000)), F.lit(DAY_SECONDS))


def duration_hours(seconds: Column | str) -> Column:
    return F.floor(as_col(seconds) / F.lit(3600)).cast("long")


def duration_minutes(seconds: Column | str) -> Column:
    return F.floor(F.pmod(as_col(seconds), F.lit(3600)) / F.lit(60)).cast("long")


def duration_text(seconds: Column | str) -> Column:
    """``2h5``: hours and minutes without padding."""
    return F.concat(
        duration_hours(seconds).cast("string"), F.lit("h"), duration_minutes(seconds).cast("string")
    )


def millis_duration(c: Column | str) -> Column:
    """A duration given in milliseconds, as an interval."""
    return F.make_dt_interval(secs=(as_col(c) / F.lit(1000.0)).cast("decimal(18,6)"))


def estimated_km(rounded_kmh: Column | str, seconds: Column | str) -> Column:
    return round_half_even(as_col(rounded_kmh) * as_col(seconds) / F.lit(3600.0), 2)


def _label_map(labels: dict[int, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])


def benefit_label(code: Column | str, labels: dict[int, str] = BENEFIT_LABELS) -> Column:
    """Label of an exact code; NULL for unknown or fractional codes."""
    c = as_col(code)
    return F.when(c == F.floor(c), F.try_element_at(_label_map(labels), c.cast("int")))


def benefit_text(value: Column | str, labels: dict[int, str] = BENEFIT_LABELS) -> Column:
    """Label when the value reads as a number (rounded, ties to even), else the text itself.

    A number without a label stays as its rounded text.
    """
    text = as_col(value).cast("string")
    number = F.bround(text.try_cast("double"), 0).cast("int")
    label = F.try_element_at(_label_map(labels), number)
    return F.coalesce(label, number.cast("string"), text)


def in_month(day: Column | str, year: int, month: int) -> Column:
    """Half-open range, so the predicate reaches the scan."""
    after = (year + month // 12, month % 12 + 1)
    low = F.lit(f"{year:04d}-{month:02d}-01").cast("timestamp_ntz")
    high = F.lit(f"{after[0]:04d}-{after[1]:02d}-01").cast("timestamp_ntz")
    return (as_col(day) >= low) & (as_col(day) < high)


def month_start(c: Column | str) -> Column:
    return F.date_trunc("month", as_col(c)).cast("date")


def fill_speed(average: Column | str, maximum: Column | str) -> tuple[Column, Column]:
    """Missing average is 0; missing maximum is the filled average."""
    filled = F.coalesce(as_col(average), F.lit(0.0))
    return filled, F.coalesce(as_col(maximum), filled)


def full_stamina(sport: Column | str, stamina: Column | str) -> Column:
    """Swimming and walking carry no beginning stamina; they start from 100."""
    return F.when(as_col(sport).isin("swimming", "walking"), F.lit(100.0)).otherwise(as_col(stamina))


def sleep_hours(*phases: Column | str) -> Column:
    """Sum of the phases in hours; NULL if any phase is."""
    total = as_col(phases[0])
    for phase in phases[1:]:
        total = total + as_col(phase)
    return total / F.lit(3600.0)


def whole_second(c: Column | str) -> Column:
    """Without its fraction; a time without a zone is not taken through the session's zone."""
    local = as_col(c).cast("timestamp_ntz")
    return local - F.make_dt_interval(secs=F.extract(F.lit("SECONDS"), local) % 1)


def time_text(c: Column | str) -> Column:
    return F.date_format(as_col(c), "yyyy-MM-dd HH:mm:ss")

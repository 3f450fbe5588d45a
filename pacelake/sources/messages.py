"""Decoded device messages: one row per message, fields as a string map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pacelake.operators.merge import stack
from pacelake.schemas import (
    ALL_RECORD_KEYS, ALL_SESSION_KEYS, MESSAGE_KEYS, message_type,
)

WIDE_KEYS = {**MESSAGE_KEYS, "SESSION": ALL_SESSION_KEYS, "RECORD": ALL_RECORD_KEYS}


RESCUED = "malformed_fields"


def project_messages(messages: DataFrame, kind: str, wide: bool = False, rescue: bool = False) -> DataFrame:
    """Messages of one kind with one typed column per key; absent keys are NULL.

    ``wide`` takes the key lists united over all sports. A text that does not read as its key's type is
    NULL too; ``rescue`` adds ``malformed_fields``, a map of such keys to their texts, NULL if there are none.
    """
    keys = (WIDE_KEYS if wide else MESSAGE_KEYS)[kind]
    fields = [F.col("fields")[k].try_cast(message_type(k)).alias(k) for k in keys]
    if rescue:
        fields.append(_malformed(keys).alias(RESCUED))
    return messages.filter(F.col("mesg") == kind).select("user_id", "activity_id", "seq", *fields)


def _malformed(keys: Sequence[str]) -> Column:
    """The keys whose text is there but does not read as their type, with the text."""
    by_type: dict[str, list[str]] = {}
    for key in keys:
        by_type.setdefault(message_type(key), []).append(key)
    wrong = F.lit(False)

    def fails(key: Column, text: Column) -> Column:
        bad = wrong
        for kind, names in by_type.items():
            if kind != "string":
                bad = bad | (key.isin(names) & text.isNotNull() & text.try_cast(kind).isNull())
        return bad

    found = F.map_filter("fields", fails)
    return F.when(F.size(found) > 0, found)


def malformed_counts(messages: DataFrame, kinds: Sequence[str] = tuple(MESSAGE_KEYS), wide: bool = False) -> DataFrame:
    """(mesg, key, n, example): how many cells of each key did not read as its type, and the least such text."""
    parts = [
        project_messages(messages, kind, wide, rescue=True).select(F.lit(kind).alias("mesg"), F.explode(RESCUED).alias("key", "text"))
        for kind in kinds
    ]
    return stack(*parts).groupBy("mesg", "key").agg(F.count("*").alias("n"), F.min("text").alias("example"))


def all_sessions(messages: DataFrame, wide: bool = False) -> DataFrame:
    """The session rows of all workouts as one table."""
    return project_messages(messages, "SESSION", wide)


def samples(messages: DataFrame) -> DataFrame:
    """The time series of every workout."""
    return project_messages(messages, "RECORD")


def full_samples(messages: DataFrame) -> DataFrame:
    """Samples, pool lengths and strength sets stacked; columns united, gaps NULL."""
    return stack(*[project_messages(messages, k) for k in ("RECORD", "LENGTH", "SET")])


def activity_from_file(path: Column | None = None) -> Column:
    """Activity id from a file name: the text before ``.fit``."""
    name = F.col("_metadata.file_path") if path is None else path
    return F.regexp_extract(name, r"([^/]+?)\.fit", 1)

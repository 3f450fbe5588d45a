"""What several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
"""Words are runs of anything but ASCII white space."""

SLICE_CHARS = 4_000_000
"""Text that a Python task turns into arrays at once; more is done slice by slice."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns of one's own that no column of ``df`` has, in whatever case."""
    taken = {name.casefold() for name in df.columns}
    found = []
    for name in wanted:
        while name.casefold() in taken:
            name += "_"
        taken.add(name.casefold())
        found.append(name)
    return found


def slices(sizes: Iterable[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Cut 0..n into ranges of about ``limit`` in all; every range has a row at least."""
    start = held = end = 0
    for end, size in enumerate(sizes, 1):
        held += size
        if held >= limit:
            yield start, end
            start, held = end, 0
    if start < end:
        yield start, end


class Recent:
    """Remembers what was used last: when full, the older half goes and the newer becomes the older."""

    def __init__(self, limit: int):
        self.limit, self.newer, self.older = limit, {}, {}

    def find_all(self, keys: Iterable) -> tuple[dict, list]:
        """What is known, and the keys that are not."""
        found, again, unknown = {}, {}, []
        for key in keys:
            value = self.newer.get(key)
            if value is not None:
                found[key] = value
                continue
            value = self.older.get(key)
            if value is not None:
                again[key] = value
            else:
                unknown.append(key)
        self.keep_all(again)
        return found | again, unknown

    def keep_all(self, entries: dict) -> None:
        if len(self.newer) + len(entries) > self.limit:
            self.older, self.newer = self.newer, {}
        self.newer |= entries

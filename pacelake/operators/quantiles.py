"""Exact quantiles of many columns at once, at any size.

``percentile`` holds every distinct value of a column in one task. That is fine up to a
known number of values. Beyond it, a mergeable sketch gives a bracket around each
quantile, one pass counts what lies below and inside the bracket, and the bracket is
narrowed until the few values left inside it can be ranked exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

MAX_VALUES = 1_000_000
"""Values of one column that a task may hold; all columns of one pass together hold at most
``COLUMNS_AT_ONCE`` times as many."""
COLUMNS_AT_ONCE = 4
ACCURACY = 10_000


@dataclass
class _Target:
    column: str
    prob: float
    rank: float
    low: float
    high: float
    below: int = 0
    inside: int = 0
    missed: int = 0
    value: float | None = None

    @property
    def span(self) -> Column:
        c = F.col(self.column)
        return (c >= F.lit(self.low)) & (c <= F.lit(self.high))

    @property
    def covered(self) -> bool:
        last = self.below + self.inside - 1
        return self.below <= math.floor(self.rank) and math.ceil(self.rank) <= last

    @property
    def local(self) -> float:
        """Rank inside the bracket as a fraction of its last rank."""
        return (self.rank - self.below) / max(self.inside - 1, 1)


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], max_values: int = MAX_VALUES
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of the non-null values, per column."""
    columns, probs = list(columns), list(probs)
    if not columns:
        return {}
    df = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    names = dict(enumerate(columns))
    counts = df.agg(*[F.count(c).alias(f"n{i}") for i, c in names.items()]).first()
    out = {c: [None] * len(probs) for c in columns}
    few = [i for i in names if 0 < counts[i] <= max_values]
    for batch in _batches(few, [counts[i] for i in few], COLUMNS_AT_ONCE * max_values):
        row = df.agg(*[F.percentile(names[i], F.array(*map(F.lit, probs))).alias(f"q{i}") for i in batch]).first()
        out |= {names[i]: list(row[f"q{i}"]) for i in batch}
    many = {c: counts[i] for i, c in names.items() if counts[i] > max_values}
    if many:
        targets = _first_brackets(df, many, probs)
        _narrow(df, targets, max_values)
        found = {(t.column, t.prob): t.value for t in targets}
        out |= {c: [found[c, p] for p in probs] for c in many}
    return out


def _batches(items: Sequence, sizes: Sequence[int], limit: int) -> Iterator[list]:
    """Items in order, as many at once as their sizes stay within ``limit``; one at least."""
    batch, held = [], 0
    for item, size in zip(items, sizes):
        if batch and held + size > limit:
            yield batch
            batch, held = [], 0
        batch.append(item)
        held += size
    if batch:
        yield batch


def _margins(fraction: float, rows: int, missed: int = 0) -> list[float]:
    """Twice the sketch's error plus two ranks to both sides; wider after each miss."""
    margin = (2 / ACCURACY + 2 / rows) * 2**missed
    return [max(0.0, fraction - margin), min(1.0, fraction + margin)]


def _sketch(c: Column, fraction: float, rows: int, missed: int = 0) -> Column:
    return F.percentile_approx(c, _margins(fraction, rows, missed), ACCURACY)


def _first_brackets(df: DataFrame, known: dict[str, int], probs: list[float]) -> list[_Target]:
    # One sketch a column answers for all its quantiles.
    columns = list(known)
    row = df.agg(*[
        F.percentile_approx(F.col(c), [x for p in probs for x in _margins(p, known[c])], ACCURACY).alias(f"b{i}")
        for i, c in enumerate(columns)
    ]).first()
    return [
        _Target(c, p, p * (known[c] - 1), *row[i][2 * k:2 * k + 2]) for i, c in enumerate(columns) for k, p in enumerate(probs)
    ]


def _narrow(df: DataFrame, targets: list[_Target], max_values: int) -> None:
    open_targets = targets
    while open_targets:
        counted = df.agg(*[
            e
            for i, t in enumerate(open_targets)
            for e in (
                F.count_if(F.col(t.column) < F.lit(t.low)).alias(f"l{i}"),
                F.count_if(t.span).alias(f"m{i}"),
                F.approx_count_distinct(F.when(t.span, F.col(t.column))).alias(f"d{i}"),
            )
        ]).first()
        finish, held, narrow, widen = [], [], [], []
        for i, t in enumerate(open_targets):
            t.below, t.inside = counted[f"l{i}"], counted[f"m{i}"]
            if not t.covered:
                widen.append(t)
            elif t.low == t.high:
                t.value = t.low
            elif (size := min(t.inside, 2 * counted[f"d{i}"])) <= max_values:
                finish.append(t)
                held.append(size)
            else:
                narrow.append(t)
        for t in widen:  # the sketch missed; start again from the open side
            t.missed += 1
            if t.below > math.floor(t.rank):
                t.low = -math.inf
            if math.ceil(t.rank) > t.below + t.inside - 1:
                t.high = math.inf
        for batch in _batches(finish, held, COLUMNS_AT_ONCE * max_values):
            row = df.agg(*[
                F.percentile(F.when(t.span, F.col(t.column)), F.lit(t.local)).alias(f"v{i}")
                for i, t in enumerate(batch)
            ]).first()
            for i, t in enumerate(batch):
                t.value = row[i]
        if narrow:
            row = df.agg(*[
                _sketch(F.when(t.span, F.col(t.column)), t.local, t.inside, t.missed).alias(f"b{i}")
                for i, t in enumerate(narrow)
            ]).first()
            for i, t in enumerate(narrow):
                t.low, t.high = row[i]
        open_targets = narrow + widen

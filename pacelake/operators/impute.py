"""Exact nearest-neighbour imputation within one athlete's rows.

A missing value becomes the mean over the k nearest rows that have it. The distance is
Euclidean over the columns both rows have, scaled by all columns / shared columns; equal
distances go by row id. Rows without such a neighbour take the athlete's mean, then the
mean over all.

An athlete whose rows fit one task is solved there. A larger one is cut into tiles, the
index, written once for all later transforms: donors that know the same of the best
separating features, the axes, near in these, share a tile. Donors that know several are also cut into tiles
along each one, for rows that share just that one with them. A tile's box holds the least and greatest value of every feature
that all its donors know. A row's distance to the box, over whichever of these features the row
itself knows, bounds its distance to each donor in the tile from below. The tiles
nearest to a row bound its k-th distances from above; beyond these only the
tiles that can still matter are visited. Nothing is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from pacelake.operators.ordering import number_rows
from pacelake.schemas import IMPUTE_NEIGHBOURS
from pacelake.session import MAX_BROADCAST_ROWS, MAX_GROUP_ROWS, is_small, staged

TILE_ROWS = 4096
VISIT_ROWS = 4096
BATCH_ROWS = 20_000
AXES = 4
BUCKET_BITS = 4
_CELLS = 1 << 18  # pairs of rows compared at once


def _matrix(rows: pd.DataFrame, width: int) -> np.ndarray:
    """Feature cells of a group as one array; NULL reads as NaN."""
    return rows[[f"v{i}" for i in range(width)]].to_numpy(dtype="float64")


def _distances(rows: np.ndarray, donors: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distances of each row to the donors ``at`` it, over shared columns, scaled by all / shared; inf if
    none is shared."""
    total = np.zeros(at.shape)
    shared = np.zeros(at.shape)
    for f in range(rows.shape[1]):
        gap = rows[:, f, None] - donors[:, f][at]
        known = ~np.isnan(gap)
        total += np.where(known, gap * gap, 0.0)
        shared += known
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(shared > 0, total * rows.shape[1] / shared, np.inf)


def _smallest(dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k smallest finite entries per row; on a tie the lower column."""
    k = min(k, dist.shape[1])
    limit = np.partition(dist, k - 1, axis=1)[:, k - 1:k]
    row, col = np.nonzero((dist <= limit) & np.isfinite(dist))
    order = np.lexsort((col, dist[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], col[rank < k]


@dataclass
class _Groups:
    """For each row of one side, where its group's rows are on the other side, in that side's order."""

    order: np.ndarray
    start: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, a: pd.DataFrame, b: pd.DataFrame, keys: list[str]) -> _Groups:
        both = pd.concat([a[keys], b[[f"d_{k}" for k in keys]].set_axis(keys, axis=1)], ignore_index=True)
        group = both.groupby(keys, sort=False).ngroup().fillna(-1).to_numpy(dtype="int64")  # -1: a key is NULL
        ours, theirs = group[:len(a)], group[len(a):]
        order = np.argsort(theirs, kind="stable")
        start = np.searchsorted(theirs[order], ours)
        count = np.searchsorted(theirs[order], ours, side="right") - start
        return cls(order, start, np.where(ours < 0, 0, count))

    def slabs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, places, valid): rows of groups of like size at once, each with its group's rows on the other side.

        Many groups are tiny, so that one step for each would cost more than its arithmetic.
        """
        rows = np.argsort(-self.count, kind="stable")
        rows = rows[:np.count_nonzero(self.count)]
        low = 0
        while low < len(rows):
            width = int(self.count[rows[low]])
            part = rows[low:low + max(1, _CELLS // width)]
            low += len(part)
            nth = np.arange(width)
            valid = nth < self.count[part][:, None]
            yield part, self.order[np.where(valid, self.start[part][:, None] + nth, 0)], valid


def _neighbours(
    rows: np.ndarray, donors: np.ndarray, groups: _Groups, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(column, rows, donors, squared distances), one entry per row lacking the column and
    each of its k nearest donors of its group; donors come sorted by id."""
    for part, at, valid in groups.slabs():
        dist = np.where(valid, _distances(rows[part], donors, at), np.inf)
        for f in range(rows.shape[1]):
            lacking = np.flatnonzero(np.isnan(rows[part, f]))
            if len(lacking):
                having = ~np.isnan(donors[:, f])[at[lacking]]
                sub = np.where(having, dist[lacking], np.inf)
                r, d = _smallest(sub, k)
                yield f, part[lacking[r]], at[lacking[r], d], sub[r, d]


def _fill_blocks(keys: list[str], width: int, k: int):
    """Athletes that fit one task: filled values of their incomplete rows."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("rid")
        need, have = _matrix(a, width), _matrix(b, width)
        total, count = np.zeros_like(need), np.zeros_like(need)
        for f, row, donor, _ in _neighbours(need, have, _Groups.of(a, b, keys), k):
            np.add.at(total[:, f], row, have[donor, f])
            np.add.at(count[:, f], row, 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            filled = np.where(np.isnan(need), total / count, need)
        out = a[[*keys, "rid"]].reset_index(drop=True)
        return out.join(pd.DataFrame(filled, columns=[f"v{i}" for i in range(width)]))

    return run


def _search_tiles(keys: list[str], width: int, k: int):
    """Nearest donors of a tile for each row that visits it, one output row each."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("rid")
        need, have = _matrix(a, width), _matrix(b, width)
        ids = b["rid"].to_numpy()
        parts = [(np.array([], "int64"), np.array([], "int32"), np.array([]), ids[:0], np.array([]))]
        for f, row, donor, dist in _neighbours(need, have, _Groups.of(a, b, keys), k):
            parts.append((row, np.full(len(row), f, "int32"), dist, ids[donor], have[donor, f]))
        row, f, dist, donor, value = (np.concatenate(x) for x in zip(*parts))
        out = a[[*keys, "rid"]].take(row).reset_index(drop=True)
        return out.assign(f=f, dist=dist, donor=donor, value=value)

    return run


def _choose_tiles(keys: list[str], width: int, k: int, axes: list[int]):
    """Tiles that rows visit, one output row each.

    Of the cuts of donors that know the same axes, a row takes the one along the axis that it
    shares with them, if that is a single one, and else the cut by all of them.

    Rows without bounds take, for each column they lack, the tile nearest by its box's middle
    that has k donors of the column. Rows with bounds ``g`` take
    every other tile that may hold a donor of a lacking column within that column's bound.
    """

    def boxes_of(b: pd.DataFrame) -> tuple[np.ndarray, ...]:
        sides = (b[[f"{side}{i}" for i in range(width)]].to_numpy(dtype="float64") for side in ("lo", "hi", "have"))
        return *sides, b["along"].to_numpy(dtype="int64")

    def usable(need: np.ndarray, low: np.ndarray, along: np.ndarray, at: np.ndarray) -> np.ndarray:
        theirs = ~np.isnan(low[:, axes])
        several = theirs.sum(axis=1) > 1
        shared, last = np.zeros(at.shape, dtype="int64"), np.zeros(at.shape, dtype="int64")
        for nth, axis in enumerate(axes):
            both = ~np.isnan(need[:, axis])[:, None] & theirs[:, nth][at]
            shared += both
            last = np.where(both, axis, last)  # the shared axis, if there is a single one
        return np.where((shared == 1) & several[at], last, -1) == along[at]

    def home(need: np.ndarray, ours: np.ndarray, low: np.ndarray, high: np.ndarray, have: np.ndarray, at: np.ndarray) -> np.ndarray:
        far = np.where(ours, np.minimum(_distances(need, (low + high) / 2, at), np.finfo("float64").max), np.inf)
        visits = np.zeros(far.shape, dtype=bool)
        for f in range(width):
            lacking = np.flatnonzero(np.isnan(need[:, f]))
            if len(lacking):
                far_f = np.where((have[:, f] >= k)[at[lacking]], far[lacking], np.inf)
                nearest = np.argmin(far_f, axis=1)
                found = np.isfinite(far_f[np.arange(len(lacking)), nearest])
                visits[lacking[found], nearest[found]] = True
        return visits

    def within(need: np.ndarray, bound: np.ndarray, low: np.ndarray, high: np.ndarray, have: np.ndarray, at: np.ndarray) -> np.ndarray:
        least, shared = np.zeros(at.shape), np.zeros(at.shape)
        for f in range(width):
            gap = np.fmax(np.fmax(low[:, f][at] - need[:, f, None], need[:, f, None] - high[:, f][at]), 0.0)
            least += gap * gap  # 0 where a side is not known
            # A donor shares at most the row's features that some donor of the tile knows.
            shared += ~np.isnan(need[:, f])[:, None] & (have[:, f] > 0)[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(shared > 0, least * (width / shared) * (1 - 1e-9), np.nan)  # room for rounding
        reached = np.zeros(least.shape, dtype=bool)
        for f in range(width):
            lacking = np.isnan(need[:, f])[:, None]
            reached |= lacking & (have[:, f] > 0)[at] & (least <= bound[:, f, None])
        return reached

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("d_tile")
        need, tiles, boxes = _matrix(a, width), b["d_tile"].to_numpy(), boxes_of(b)
        bound = a[[f"g{i}" for i in range(width)]].to_numpy(dtype="float64") if "g0" in a else None
        rows, found = [np.array([], "int64")], [tiles[:0]]
        for part, at, valid in _Groups.of(a, b, keys).slabs():
            ours = usable(need[part], boxes[0], boxes[3], at) & valid
            visits = home(need[part], ours, *boxes[:3], at)
            if bound is not None:
                visits = within(need[part], bound[part], *boxes[:3], at) & ours & ~visits
            r, t = np.nonzero(visits)
            rows.append(part[r])
            found.append(tiles[at[r, t]])
        cells = [f"v{i}" for i in range(width)]
        out = a[[*keys, "rid", *cells]].take(np.concatenate(rows)).reset_index(drop=True)
        return out.assign(tile=np.concatenate(found))

    return run


@dataclass
class NeighbourImputer:
    """Fitted on a table of donors; fills tables of the same columns.

    ``block`` names the columns within which neighbours are sought, ``row_id`` a number or
    text that tells rows of a block apart.
    """

    donors: DataFrame
    columns: list[str]
    block: list[str]
    row_id: str
    k: int = IMPUTE_NEIGHBOURS
    tile_rows: int = TILE_ROWS
    max_group_rows: int = MAX_GROUP_ROWS

    def transform(self, df: DataFrame) -> DataFrame:
        """Fill every missing value of the columns."""
        filled = self._by_block(df)
        index = {c: f"v{i}" for i, c in enumerate(self.columns)}
        keys = [*self.block, self.row_id]
        out = df.join(filled.withColumnRenamed("rid", self.row_id), keys, "left").withColumns({
            c: F.coalesce(F.col(f"`{c}`").cast("double"), v) for c, v in index.items()
        }).drop(*index.values())
        return self._with_means(out)

    def _cells(self, df: DataFrame, *columns: str, prefix: str = "") -> DataFrame:
        """One plain column per feature, for Arrow; key columns under a prefix."""
        cells = [F.get("v", F.lit(i)).alias(f"v{i}") for i in range(len(self.columns))]
        return df.select(*[F.col(c).alias(prefix + c) for c in columns], "rid", *cells)

    def _cogroup(
        self, left: DataFrame, right: DataFrame, keys: list[str], n_rows: int, run, *fields: T.StructField
    ) -> DataFrame:
        """``run`` on batches of whole groups of rows and donors.

        Groups are bounded but often tiny, so Python gets them by batches of about
        ``BATCH_ROWS`` rows; ``n_rows`` is the rough size of both sides.
        """
        batches = max(left.sparkSession.sparkContext.defaultParallelism, n_rows // BATCH_ROWS)
        rows = self._cells(left, *keys).withColumn("batch", F.pmod(F.xxhash64(*keys), F.lit(batches)))
        donors = self._cells(right, *keys, prefix="d_").withColumn(
            "d_batch", F.pmod(F.xxhash64(*[f"d_{k}" for k in keys]), F.lit(batches))
        )
        schema = T.StructType([rows.schema[k] for k in keys] + list(fields))
        return rows.groupBy("batch").cogroup(donors.groupBy("d_batch")).applyInPandas(run, schema)

    # -- nearest rows --------------------------------------------------------

    @property
    def _id_type(self) -> T.DataType:
        return self.donors.schema[self.row_id].dataType

    def _vectors(self, df: DataFrame) -> DataFrame:
        v = F.array(*[F.col(f"`{c}`").cast("double") for c in self.columns])
        return df.select(*self.block, F.col(self.row_id).cast(self._id_type).alias("rid"), v.alias("v"))

    def _by_block(self, df: DataFrame) -> DataFrame:
        donors = self._vectors(self.donors)
        need = self._vectors(df).filter(F.exists("v", lambda x: x.isNull()))
        sides = donors.select(*self.block, F.lit(1).alias("d")).union(need.select(*self.block, F.lit(0)))
        sizes = sides.groupBy(*self.block).agg(F.sum("d").alias("d"), F.sum(1 - F.col("d")).alias("r"))
        sizes = staged(sizes.withColumns({
            "_indexed": F.col("d") > self.tile_rows, "_parts": F.greatest(F.ceil(F.col("r") / self.tile_rows), F.lit(1)),
        }))
        n_rows, n_indexed, n_split = sizes.agg(
            F.sum(F.col("d") * F.col("_parts") + F.col("r")), F.count_if("_indexed"), F.count_if(F.col("_parts") > 1)
        ).first()
        if not n_indexed and not n_split:
            return self._solve_small(need, donors, n_rows or 0)
        some = sizes.filter("_indexed OR _parts > 1").select(*self.block, "_indexed", "_parts")
        key = F.broadcast(some) if n_indexed + n_split <= MAX_BROADCAST_ROWS else some
        need, donors = need.join(key, self.block, "left"), donors.join(key, self.block, "left")
        indexed = F.coalesce("_indexed", F.lit(False))
        # Many incomplete rows of few donors are dealt over parts, each with all donors.
        parts = F.coalesce("_parts", F.lit(1))
        small = self._solve_small(
            need.filter(~indexed).withColumn("part", F.pmod(F.xxhash64("rid"), parts)),
            donors.filter(~indexed).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))),
            n_rows, [*self.block, "part"],
        ).drop("part")
        if not n_indexed:
            return small
        return small.unionByName(self._solve_large(need.filter(indexed).drop("_indexed", "_parts")))

    def _solve_small(self, need: DataFrame, donors: DataFrame, n_rows: int, keys: list[str] | None = None) -> DataFrame:
        keys = keys or self.block
        cells = [T.StructField(f"v{i}", T.DoubleType()) for i in range(len(self.columns))]
        return self._cogroup(need, donors, keys, n_rows, _fill_blocks(keys, len(self.columns), self.k), T.StructField("rid", self._id_type), *cells)

    # -- athletes too large for one task --------------------------------------

    @cached_property
    def _index(self) -> tuple[DataFrame, DataFrame, list[int]]:
        """(block, tile, rid, v), the tiles' boxes and the axes, for athletes with more donors than a tile; written once."""
        donors = self._vectors(self.donors)
        wide = donors.groupBy(*self.block).agg(F.count("*").alias("n")).filter(F.col("n") > self.tile_rows).drop("n")
        wide = staged(wide)
        donors = donors.join(F.broadcast(wide) if is_small(wide) else wide, self.block, "left_semi")
        # More than k equal rows never matter: the first k by id come before the others.
        same = Window.partitionBy(*self.block, "v").orderBy("rid")
        donors = donors.filter(F.exists("v", lambda x: x.isNotNull()))
        donors = donors.withColumn("_r", F.row_number().over(same)).filter(F.col("_r") <= self.k).drop("_r")
        axes = self._axes(donors)
        cells = [F.get("v", F.lit(i)) for i, _ in axes]
        pattern = F.array(*[c.isNotNull() for c in cells]).cast("string")
        buckets = [F.size(F.filter(F.lit(cuts), lambda cut, c=c: cut < c)) if cuts else F.lit(0) for c, (_, cuts) in zip(cells, axes)]
        curve = F.lit(0)  # the axes' buckets, bit by bit
        for bit in reversed(range(BUCKET_BITS)):
            for bucket in buckets:
                curve = curve * 2 + F.shiftright(bucket, bit).bitwiseAND(F.lit(1))
        several = F.size(F.filter(F.array(*[c.isNotNull() for c in cells]), lambda known: known)) > 1
        cuts = F.array(F.lit(-1), *[F.when(several & c.isNotNull(), F.lit(i)) for c, (i, _) in zip(cells, axes)])
        placed = donors.withColumns({
            "_know": pattern, "along": F.explode(F.filter(cuts, lambda i: i.isNotNull())),
        }).withColumns({
            "_curve": F.when(F.col("along") < 0, curve).otherwise(0),
            "_x": F.coalesce(F.when(F.col("along") >= 0, F.get("v", F.col("along"))), *cells, F.lit(0.0)),
        })
        placed = number_rows(placed, [*self.block, "_know", "along"], ["_curve", "_x", "rid"], "_pos", self.max_group_rows)
        nth = F.floor(F.col("_pos") / self.tile_rows)
        tiles = staged(placed.select(*self.block, F.concat_ws("/", "_know", "along", nth).alias("tile"), "along", "rid", "v"))
        sides = []
        for i in range(len(self.columns)):
            c = F.get("v", F.lit(i))
            full = F.count(c) == F.count("*")
            sides += [F.when(full, F.min(c)).alias(f"lo{i}"), F.when(full, F.max(c)).alias(f"hi{i}"), F.count(c).alias(f"have{i}")]
        return tiles.drop("along"), staged(tiles.groupBy(*self.block, "tile", "along").agg(*sides)), [i for i, _ in axes]

    def _axes(self, donors: DataFrame) -> list[tuple[int, list[float]]]:
        """The features that separate best, widely spread and known in many rows, each with cuts into buckets."""
        cells = [F.get("v", F.lit(i)) for i in range(len(self.columns))]
        shares = [i / 2**BUCKET_BITS for i in range(1, 2**BUCKET_BITS)]
        row = donors.agg(*[F.coalesce(F.stddev_pop(c) * F.count(c), F.lit(0.0)) for c in cells]).first()
        best = sorted(range(len(cells)), key=lambda i: (-row[i], i))[:AXES]
        cuts = donors.agg(*[F.percentile_approx(cells[i], shares) for i in best]).first()
        return [(i, list(c or [])) for i, c in zip(best, cuts)]

    def _solve_large(self, need: DataFrame) -> DataFrame:
        tiles, boxes, axes = self._index
        # Equal incomplete rows have equal answers.
        asked = staged(need.groupBy(*self.block, "v").agg(F.min("rid").alias("rid")))
        near = staged(self._nearest(staged(self._visits(asked, boxes, axes)), tiles))
        bounded = staged(asked.join(self._bounds(near), [*self.block, "rid"], "left"))
        more = self._nearest(staged(self._visits(bounded, boxes, axes)), tiles)
        rank = Window.partitionBy(*self.block, "rid", "f").orderBy("dist", "donor")
        best = near.unionByName(more).withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= self.k)
        means = best.groupBy(*self.block, "rid", "f").agg(F.avg("value").alias("value"))
        cells = means.groupBy(*self.block, "rid").agg(
            F.map_from_entries(F.collect_list(F.struct("f", "value"))).alias("_cells")
        )
        filled = F.transform("v", lambda e, i: F.coalesce(e, F.try_element_at("_cells", i)))
        answers = asked.join(cells, [*self.block, "rid"], "left").select(
            *self.block, "v", filled.alias("filled")
        )
        found = need.join(answers, [*self.block, "v"])
        return found.select(*self.block, "rid", *[
            F.get("filled", F.lit(i)).alias(f"v{i}") for i in range(len(self.columns))
        ])

    def _visits(self, rows: DataFrame, boxes: DataFrame, axes: list[int]) -> DataFrame:
        """(block, rid, v, tile): the tiles near to each row, or with ``_bounds`` the others within these.

        Rows of an athlete are spread over parts, each of which gets the athlete's boxes.
        """
        width = len(self.columns)
        counts = rows.groupBy(*self.block).agg(F.ceil(F.count("*") / VISIT_ROWS).alias("_parts"))
        spread = rows.join(counts, self.block).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("_parts")))
        keys = [*self.block, "part"]
        n_rows = counts.agg(F.sum("_parts")).first()[0] or 0
        batches = max(rows.sparkSession.sparkContext.defaultParallelism, n_rows * VISIT_ROWS // BATCH_ROWS)
        left = self._cells(spread, *keys)
        if "_bounds" in rows.columns:
            # A column without k donors so far has no bound.
            limits = [F.coalesce(F.try_element_at("_bounds", F.lit(i)), F.lit(float("inf"))).alias(f"g{i}") for i in range(width)]
            cells = [F.get("v", F.lit(i)).alias(f"v{i}") for i in range(width)]
            left = spread.select(*keys, "rid", *cells, *limits)
        copied = boxes.join(counts, self.block).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
        right = copied.select(*[F.col(c).alias(f"d_{c}") for c in [*keys, "tile"]], "along", *[
            f"{side}{i}" for side in ("lo", "hi", "have") for i in range(width)
        ])
        left = left.withColumn("batch", F.pmod(F.xxhash64(*keys), F.lit(batches)))
        right = right.withColumn("d_batch", F.pmod(F.xxhash64(*[f"d_{c}" for c in keys]), F.lit(batches)))
        schema = T.StructType([
            *[left.schema[c] for c in [*keys, "rid", *[f"v{i}" for i in range(width)]]], T.StructField("tile", T.StringType()),
        ])
        chosen = left.groupBy("batch").cogroup(right.groupBy("d_batch")).applyInPandas(_choose_tiles(keys, width, self.k, axes), schema)
        vector = F.array(*[F.when(~F.isnan(f"v{i}"), F.col(f"v{i}")) for i in range(width)])
        return chosen.select(*self.block, "rid", vector.alias("v"), "tile")

    def _nearest(self, visits: DataFrame, tiles: DataFrame) -> DataFrame:
        """Nearest donors per visiting row and missing column, tile by tile.

        A tile that many rows visit is copied, so that no task gets too many visits.
        """
        sizes = visits.groupBy(*self.block, "tile").agg(F.count("*").alias("n"))
        counts = sizes.withColumn("_copies", F.ceil(F.col("n") / VISIT_ROWS))
        n_rows = counts.agg(F.sum(F.col("n") + F.col("_copies") * self.tile_rows)).first()[0] or 0
        counts = counts.drop("n")
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).alias("part")
        copies = tiles.join(counts, [*self.block, "tile"]).select(*self.block, "tile", "rid", "v", parts)
        spread = visits.join(counts, [*self.block, "tile"]).select(
            *self.block, "tile", "rid", "v", F.pmod(F.xxhash64("rid"), F.col("_copies")).alias("part")
        )
        keys = [*self.block, "tile", "part"]
        run = _search_tiles(keys, len(self.columns), self.k)
        found = self._cogroup(
            spread, copies, keys, n_rows, run,
            T.StructField("rid", self._id_type), T.StructField("f", T.IntegerType()),
            T.StructField("dist", T.DoubleType()), T.StructField("donor", self._id_type),
            T.StructField("value", T.DoubleType()),
        )
        return found.drop("tile", "part")

    def _bounds(self, near: DataFrame) -> DataFrame:
        """Squared distance of the k-th donor so far, by column that has k."""
        per_cell = near.groupBy(*self.block, "rid", "f").agg(F.array_sort(F.collect_list("dist")).alias("dist"))
        per_cell = per_cell.filter(F.size("dist") >= self.k).select(
            *self.block, "rid", F.struct("f", F.get("dist", F.lit(self.k - 1)).alias("dist")).alias("e")
        )
        return per_cell.groupBy(*self.block, "rid").agg(F.map_from_entries(F.collect_list("e")).alias("_bounds"))

    # -- no neighbour ----------------------------------------------------------

    @cached_property
    def _overall(self) -> list[float | None]:
        return list(self.donors.agg(*[F.avg(F.col(f"`{c}`")) for c in self.columns]).first())

    @cached_property
    def _block_means(self) -> DataFrame:
        """Means of each block, written once for all later transforms."""
        return staged(self.donors.groupBy(*self.block).agg(*[
            F.avg(F.col(f"`{c}`")).alias(f"_m{i}") for i, c in enumerate(self.columns)
        ]))

    def _with_means(self, df: DataFrame) -> DataFrame:
        names = {c: f"_m{i}" for i, c in enumerate(self.columns)}
        fallback = {c: F.lit(v).cast("double") for c, v in zip(self.columns, self._overall)}
        return df.join(self._block_means, self.block, "left").withColumns({
            c: F.coalesce(F.col(f"`{c}`"), m, fallback[c]) for c, m in names.items()
        }).drop(*names.values())


def fit_neighbour_imputer(
    df: DataFrame, columns: Sequence[str], row_id: str, block: Sequence[str] = ("user_id",), **options
) -> NeighbourImputer:
    keep = [*block, row_id, *columns]
    return NeighbourImputer(df.select(*keep), list(columns), list(block), row_id, **options)

"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

Trees are grown on a bounded sample; a node splits at the median along the difference of two sampled
vectors. Every vector is filed in one leaf of each tree. A query searches all trees through one
priority queue: the node whose worst margin on its path is best comes next, and a leaf that comes up is
visited, until the budget of visits is used. Visits and leaves meet by leaf, and each leaf's
vectors are compared exactly, in double precision.

The budget is measured, not guessed: for a bounded sample of queries the exact neighbours are found
by brute force in blocks, and the budget is the least number of visits that meets the wanted recall.

Equal vectors are searched as one and keep only as many ids as can be asked for, the least, so
copies cannot fill a leaf. A leaf with many rows or visits is dealt to several tasks.

Vectors that are null, empty, zero, of another length than most, or hold null or non-finite
components take no part, nor do rows with a null id. Repeated rows count once. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pacelake.session import staged

TREES = 6
LEAF_ROWS = 512
"""Vectors that a leaf should hold ..."""
MAX_LEAVES = 1 << 13
"""... but a tree has no more leaves than this, which bounds what is broadcast."""
SAMPLE_PER_LEAF = 16
"""Sampled vectors for each leaf of a tree: at most 131,072 vectors grow the forest."""
CALIBRATION = 64
"""Sampled queries that measure the budget."""
RECALL = 0.97
BLOCK_ROWS = 4096
BLOCK_VISITS = 8192


class Tree(NamedTuple):
    """Node n splits at ``planes[n] @ v <= cuts[n]`` into ``left[n]`` and ``right[n]``; a negative
    child is the leaf ``-1 - child``."""

    planes: np.ndarray
    cuts: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int


def grow(sample: np.ndarray, leaves: int, seed: int) -> Tree:
    chosen = np.random.default_rng(seed)
    planes: list[np.ndarray] = []
    cuts: list[float] = []
    children: list[list[int]] = []
    count = 0
    stack = [(np.arange(len(sample)), leaves, -1, 0)]
    while stack:
        rows, wanted, parent, side = stack.pop()
        if wanted <= 1 or len(rows) < 2:
            node = -1 - count
            count += 1
        else:
            a, b = sample[chosen.choice(rows, 2, replace=False)]
            plane = a - b if np.any(a != b) else chosen.standard_normal(sample.shape[1])
            along = sample[rows] @ plane
            cut = float(np.median(along))
            node = len(planes)
            planes.append(plane)
            cuts.append(cut)
            children.append([0, 0])
            low = along <= cut
            stack += [(rows[~low], wanted // 2, node, 1), (rows[low], wanted - wanted // 2, node, 0)]
        if parent >= 0:
            children[parent][side] = node
    sides = np.array(children, dtype=np.int64).reshape(-1, 2)
    return Tree(np.array(planes).reshape(-1, sample.shape[1]), np.array(cuts), sides[:, 0], sides[:, 1], count)


def leaf_of(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros(len(vectors), dtype=np.int64)
    if not len(tree.cuts):
        return out
    node = np.zeros(len(vectors), dtype=np.int64)
    going = np.arange(len(vectors))
    while len(going):
        here = node[going]
        low = (vectors[going] * tree.planes[here]).sum(axis=1) <= tree.cuts[here]
        node[going] = np.where(low, tree.left[here], tree.right[here])
        going = going[node[going] >= 0]
    return -1 - node


def visits(forest: list[Tree], query: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """The (tree, leaf) that a query visits, in order, from one queue over all trees."""
    sides = [tree.planes @ query - tree.cuts for tree in forest]
    queue = [(-np.inf, t, 0 if len(tree.cuts) else -1) for t, tree in enumerate(forest)]
    heapq.heapify(queue)
    found: list[tuple[int, int]] = []
    while queue and len(found) < budget:
        worst, t, node = heapq.heappop(queue)
        while node >= 0:
            margin, tree = sides[t][node], forest[t]
            near, far = (tree.left[node], tree.right[node]) if margin <= 0 else (tree.right[node], tree.left[node])
            heapq.heappush(queue, (max(worst, abs(margin)), t, int(far)))
            node = int(near)
        found.append((t, -1 - node))
    return found


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """In double precision, each row by itself, so that a vector's score does not depend on its place."""
    products = (vectors * query).sum(axis=1)
    return products / np.sqrt((vectors * vectors).sum(axis=1) * (query * query).sum())


def _best(vectors: np.ndarray, ids: list, units: np.ndarray, query: np.ndarray, k: int) -> list[tuple[float, int]]:
    """The k nearest as (minus score, id)."""
    rough = units @ (query / np.sqrt((query * query).sum()))
    near = np.argpartition(-rough, k - 1)[:k] if len(rough) > k else np.arange(len(rough))
    near = np.flatnonzero(rough >= rough[near].min() - 1e-9)
    exact = cosines(vectors[near], query)
    rows = [(-float(score), int(one)) for score, at in zip(exact, near, strict=True) for one in ids[at]]
    return sorted(rows)[:k]


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist() if hasattr(column, "tolist") else column, dtype=np.float64)


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    values = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), values.alias("v")).filter("id IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
    return rows.withColumn("v", F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))


def _forest(groups: DataFrame, rows: int, leaf_rows: int, trees: int) -> list[Tree]:
    leaves = int(min(MAX_LEAVES, max(1, -(-rows // leaf_rows))))
    size = max(2, leaves * SAMPLE_PER_LEAF)
    sample = groups.orderBy(F.xxhash64("gid"), "gid").limit(size).select("v").toPandas()["v"]
    units = unit(_matrix(sample))
    return [grow(units, leaves, seed) for seed in range(trees)]


def _calibrated(spark: SparkSession, groups: DataFrame, asked: DataFrame, forest: list[Tree], k: int, recall: float) -> int:
    """The least number of visits that finds ``recall`` of the exact neighbours of sampled queries."""
    sample = asked.orderBy(F.xxhash64("gid", F.lit(1)), "gid").limit(CALIBRATION).toPandas()
    queries = spark.sparkContext.broadcast(_matrix(sample["v"]))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = _matrix(batch["v"])
            rough = unit(vectors) @ unit(queries.value).T
            for q in range(rough.shape[1]):
                near = np.argsort(-rough[:, q], kind="stable")[: k + 1]
                yield pd.DataFrame({"q": q, "score": rough[near, q], "gid": batch["gid"].to_numpy()[near], "v": [vectors[i].tolist() for i in near]})

    found = groups.select("gid", "v").mapInPandas(exact, "q int, score double, gid long, v array<double>")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "gid"))
    top = found.withColumn("rank", rank).filter(F.col("rank") <= k + 1).toPandas()  # CALIBRATION * (k + 1) rows
    total = sum(tree.leaves for tree in forest)
    needed = []
    for q, rows in top.groupby("q"):
        order = {leaf: n for n, leaf in enumerate(visits(forest, unit(queries.value[[q]])[0], total), 1)}
        units = unit(_matrix(rows["v"]))
        homes = np.array([leaf_of(tree, units) for tree in forest])
        needed += [min(order[t, int(homes[t, i])] for t in range(len(forest))) for i in range(len(rows))]
    queries.unpersist()
    return int(np.quantile(needed, recall, method="higher")) if needed else 1


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    recall: float = RECALL,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest found of each row for which ``is_query`` holds.

    ``is_query`` is a condition on a column ``id``.
    """
    spark = vectors.sparkSession
    rows = _valid(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head(1)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    # Of equal vectors no more than k + 1 ids are ever needed; the window keeps as many before the shuffle.
    rows = rows.filter(F.size("v") == sizes[0]["n"])
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    first = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
    groups = staged(first.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("gid"), "ids", "v"))
    members = rows.filter(is_query).distinct().join(groups.select("gid", "v"), "v").select(F.col("id").alias("query_id"), "gid")
    members = staged(members)
    asked = staged(groups.join(members.select("gid").distinct(), "gid", "left_semi").select("gid", "v"))
    count = groups.count()
    if not asked.limit(1).count():
        return empty
    forest = _forest(groups, count, leaf_rows, trees)
    budget = _calibrated(spark, groups, asked, forest, k, recall)
    shared = spark.sparkContext.broadcast(forest)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries = _matrix(batch.column(1).to_pylist())
            rows_, tree, leaf = [], [], []
            for n, query in enumerate(unit(queries)):
                for t, at in visits(shared.value, query, budget):
                    rows_.append(n)
                    tree.append(t)
                    leaf.append(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree, pa.int32()), pa.array(leaf, pa.int32()), *batch.take(pa.array(rows_, pa.int64())).columns], ["tree", "leaf", "gid", "v"]
            )

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = unit(_matrix(batch.column("v").to_pylist()))
            for t, tree in enumerate(shared.value):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(units), t, np.int32)), pa.array(leaf_of(tree, units).astype(np.int32)), *batch.columns], ["tree", "leaf", "gid", "ids", "v"]
                )

    visited = asked.mapInArrow(search, "tree int, leaf int, gid long, v array<double>")
    filed = groups.mapInArrow(file, "tree int, leaf int, gid long, ids array<long>, v array<double>")
    # At most trees * MAX_LEAVES counts: into how many blocks a leaf's rows and visits are dealt.
    blocks = filed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))
    turns = visited.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / BLOCK_VISITS).alias("turns"))
    dealt = F.broadcast(staged(blocks.join(turns, ["tree", "leaf"])))
    left = filed.join(dealt, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("gid"), "parts"))
    left = left.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).drop("parts", "turns")
    right = visited.join(dealt, ["tree", "leaf"]).withColumn("turn", F.pmod(F.xxhash64("gid"), "turns"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts", "turns")

    def compare(held: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if held.empty or asks.empty:
            return pd.DataFrame({"gid": pd.Series(dtype="int64"), "near": pd.Series(dtype=object)})
        matrix, queries = _matrix(held["v"]), _matrix(asks["v"])
        units, ids = unit(matrix), held["ids"].tolist()
        near = [[{"less": a, "id": b} for a, b in _best(matrix, ids, units, query, k + 1)] for query in queries]
        return pd.DataFrame({"gid": asks["gid"].to_numpy(), "near": near})

    keys = ["tree", "leaf", "part", "turn"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        compare, "gid long, near array<struct<less:double,id:long>>"
    )
    # A query has as many lists as visits, each of k + 1.
    merged = pairs.groupBy("gid").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
    merged = merged.select("gid", F.slice("near", 1, 2 * (k + 1)).alias("near"))
    out = members.join(merged, "gid")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.less")).alias("score"))

"""Linear forecasts of many targets from one pass over the training rows.

The pass sums the cross products of all features and all targets, cut into square blocks that
are added up by block before they reach the driver. Everything else works on that one matrix, whose size depends on
the number of columns alone: ridge regressions for all targets, softmax heads for classes, and descent
by rounds with early stopping on held-out rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

BLOCK = 256
MAX_COLUMNS = 6000
"""Features and targets together; their matrix is held by the driver, and by a task."""

ROWS = 2048
RIDGE = 1e-3


@dataclass
class Gram:
    """Sums of products of (1, features, targets) over ``n`` rows."""

    products: np.ndarray
    width: int

    @property
    def n(self) -> float:
        return self.products[0, 0]

    def moments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Means, covariances and deviations; what only rounding sets apart from a constant counts as one."""
        mean = self.products[0, 1:] / max(self.n, 1.0)
        square = np.diag(self.products)[1:] / max(self.n, 1.0)
        cov = self.products[1:, 1:] / max(self.n, 1.0) - np.outer(mean, mean)
        spread = np.diag(cov)
        return mean, cov, np.sqrt(np.where(spread > 1e-13 * square, spread, 0.0))


def _partial(width: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            parts = batch.column("part").to_numpy()
            cells = batch.column("z").flatten().to_numpy().reshape(-1, width + count)
            for low in range(0, len(cells), ROWS):
                z = np.hstack((np.ones((len(cells[low:low + ROWS]), 1)), cells[low:low + ROWS]))
                for part in np.unique(parts[low:low + ROWS]).tolist():
                    rows = z[parts[low:low + ROWS] == part]
                    sums[part] = sums.get(part, 0.0) + rows.T @ rows
        for part, total in sums.items():
            for i in range(0, len(total), BLOCK):
                for j in range(i, len(total), BLOCK):
                    block = np.ascontiguousarray(total[i:i + BLOCK, j:j + BLOCK]).tobytes()
                    yield pa.RecordBatch.from_pydict({"part": [part], "i": [i], "j": [j], "block": [block]})

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block; rows come sorted, and one block at a time is held."""
    key, total = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({**{n: [v] for n, v in zip(("part", "i", "j"), key)}, "block": [total.tobytes()]})

    for batch in batches:
        for row in batch.to_pylist():
            block = np.frombuffer(row["block"])
            if key == (row["part"], row["i"], row["j"]):
                total = total + block
            else:
                if key is not None:
                    yield out()
                key, total = (row["part"], row["i"], row["j"]), block
    if key is not None:
        yield out()


def grams(
    matrix: DataFrame, targets: Sequence[str], features: str = "features", part: str | None = None, width: int | None = None,
) -> dict[int, Gram]:
    """The sums of products, apart for each value of the 0/1 column ``part``, from one pass.

    Rows that lack a target are left out; a missing feature or row of features is an error of the caller.
    Without ``width``, the number of features, the first row is computed beforehand to see it.
    """
    if width is None:
        first = matrix.select(F.size(_cells(matrix, features))).first()
        if first is None:
            raise ValueError("no rows to learn from")
        width = first[0]
    size = 1 + width + len(targets)
    if size > MAX_COLUMNS:
        raise ValueError(f"{size} columns; at most {MAX_COLUMNS} fit one matrix")
    truths = [F.col(f"`{t}`").cast("double") for t in targets]
    z = F.concat(_cells(matrix, features), F.array(*truths).cast("array<double>"))
    chosen = F.col(part).cast("int").cast("bigint") if part else F.lit(0).cast("bigint")
    rows = matrix.select(chosen.alias("part"), z.alias("z")).filter(F.forall("z", lambda x: x.isNotNull()))
    # One partial matrix for each core, however many input splits there are.
    rows = rows.coalesce(matrix.sparkSession.sparkContext.defaultParallelism)
    schema = "part bigint, i bigint, j bigint, block binary"
    partial = rows.mapInArrow(_partial(width, len(targets)), schema)
    added = partial.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j").mapInArrow(_added, schema)
    out: dict[int, Gram] = {}
    for row in added.toLocalIterator():
        found = out.setdefault(row["part"], Gram(np.zeros((size, size)), width)).products
        i, j = row["i"], row["j"]
        high = min(BLOCK, size - i)
        block = np.frombuffer(row["block"]).reshape(high, -1)
        found[i:i + high, j:j + block.shape[1]] = block
        found[j:j + block.shape[1], i:i + high] = block.T
    if not out:
        raise ValueError("no rows to learn from")
    return out


def _cells(df: DataFrame, features: str):
    column = F.col(features)
    return column if isinstance(df.schema[features].dataType, T.ArrayType) else vector_to_array(column)


@dataclass
class LinearTargets:
    """A coefficient table: one row for each number, and one for each class of a softmax head.

    ``heads`` lists the rows of each head, whose values come as shares of 1. A ``hidden`` row, as of a dropped
    first category, takes its share but does not come out.
    """

    rows: list[str]
    intercepts: np.ndarray
    coefficients: np.ndarray
    heads: list[list[str]] = field(default_factory=list)
    hidden: list[str] = field(default_factory=list)

    @property
    def targets(self) -> list[str]:
        return [name for name in self.rows if name not in self.hidden]

    def save(self, path: str, spark: SparkSession) -> None:
        head = {name: k for k, names in enumerate(self.heads) for name in names}
        table = [
            (i, name, float(self.intercepts[i]), self.coefficients[i].tolist(), head.get(name), name in self.hidden)
            for i, name in enumerate(self.rows)
        ]
        schema = "nth int, name string, intercept double, coefficients array<double>, head int, hidden boolean"
        spark.createDataFrame(table, schema).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> LinearTargets:
        rows = spark.read.parquet(path).orderBy("nth").collect()
        count = max((r["head"] for r in rows if r["head"] is not None), default=-1) + 1
        return cls(
            [r["name"] for r in rows], np.array([r["intercept"] for r in rows]),
            np.array([r["coefficients"] for r in rows]).reshape(len(rows), -1),
            [[r["name"] for r in rows if r["head"] == k] for k in range(count)], [r["name"] for r in rows if r["hidden"]],
        )

    def values(self, x: np.ndarray) -> np.ndarray:
        out = x @ self.coefficients.T + self.intercepts
        for names in self.heads:
            at = [self.rows.index(name) for name in names]
            scores = np.exp(out[:, at] - out[:, at].max(axis=1, keepdims=True))
            out[:, at] = scores / scores.sum(axis=1, keepdims=True)
        return out[:, [i for i, name in enumerate(self.rows) if name not in self.hidden]]


def predict_each(models: dict[str, LinearTargets], df: DataFrame, features: str = "features") -> DataFrame:
    """Every row once per model, with ``model_name`` and the model's targets in place of the features.

    All models are applied in one pass, as products of matrices; a target that a model lacks is NULL.
    """
    targets = list(dict.fromkeys(t for model in models.values() for t in model.targets))
    kept = [c for c in df.columns if c != features]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("_x").flatten().to_numpy().reshape(batch.num_rows, -1)
            for name, model in models.items():
                found = dict(zip(model.targets, model.values(x).T))
                lacking = pa.nulls(batch.num_rows, pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(len(kept))), pa.array([name] * batch.num_rows, pa.string()),
                     *(pa.array(np.ascontiguousarray(found[t])) if t in found else lacking for t in targets)],
                    names=[*kept, "model_name", *targets],
                )

    given = df.select(*[F.col(f"`{c}`") for c in kept], _cells(df, features).alias("_x"))
    fields = [given.schema[c] for c in kept]
    extra = [T.StructField("model_name", T.StringType()), *(T.StructField(t, T.DoubleType()) for t in targets)]
    return given.mapInArrow(run, T.StructType([*fields, *extra]))


# -- fits from the matrix --------------------------------------------------------------


def ridge(gram: Gram, targets: Sequence[str], penalty: float = RIDGE) -> LinearTargets:
    """Least squares per target with a penalty on scaled coefficients, as Spark's normal solver has it."""
    p = gram.width
    mean, cov, std = gram.moments()
    active = np.flatnonzero(std[:p] > 0)
    scale = std[active]
    values, vectors = np.linalg.eigh(cov[np.ix_(active, active)] / np.outer(scale, scale)) if len(active) else (np.empty(0), np.empty((0, 0)))
    out = np.zeros((len(targets), p))
    for k in range(len(targets)):
        spread = std[p + k]
        if spread > 0 and len(active):
            wanted = vectors.T @ (cov[active, p + k] / (scale * spread))
            weight = np.maximum(values, 0.0) + penalty / spread
            usable = weight > 1e-12
            solved = vectors[:, usable] @ (wanted[usable] / weight[usable])
            out[k, active] = solved * spread / scale
    return LinearTargets(list(targets), mean[p:] - out @ mean[:p], out)


def softmax_head(gram: Gram, targets: Sequence[str], classes: Sequence[str], hidden: str | None = None, penalty: float = RIDGE) -> LinearTargets:
    """Shares of classes by a linear discriminant: softmax of scores that are linear in the features.

    ``classes`` are 0/1 targets. ``hidden`` names the class of rows that have none of them, if there are such.
    """
    p, index = gram.width, {t: i for i, t in enumerate(targets)}
    at = [1 + p + index[c] for c in classes]
    counts, sums = gram.products[0, at], gram.products[1:p + 1, at].T
    names = list(classes)
    if hidden is not None:
        counts = np.append(counts, gram.n - counts.sum())
        sums = np.vstack((sums, gram.products[0, 1:p + 1] - sums.sum(axis=0)))
        names.append(hidden)
    seen = counts > 0
    means = np.where(seen[:, None], sums / np.maximum(counts, 1.0)[:, None], 0.0)
    whole = gram.products[1:p + 1, 1:p + 1]
    within = (whole - (means * counts[:, None]).T @ means) / max(gram.n, 1.0)
    _, _, std = gram.moments()
    active = np.flatnonzero(std[:p] > 0)
    scale = std[active]
    pooled = within[np.ix_(active, active)] / np.outer(scale, scale) + penalty * np.eye(len(active))
    coefficients = np.zeros((len(names), p))
    if len(active):
        coefficients[:, active] = np.linalg.solve(pooled, (means[:, active] / scale).T).T / scale
    intercepts = -0.5 * (coefficients * means).sum(axis=1) + np.log(np.maximum(counts, 1e-300) / max(gram.n, 1.0))
    return LinearTargets(names, intercepts, coefficients, [names], [hidden] if hidden is not None else [])


@dataclass
class Rounds:
    """Held-out squared error of each target after each round, and the round that was kept."""

    errors: dict[str, list[float]]
    best: dict[str, int]


def descend(
    train: Gram, held_out: Gram, targets: Sequence[str], rounds: int = 50, patience: int = 10, steps: int = 20,
) -> tuple[LinearTargets, Rounds]:
    """Least squares by descent in rounds of ``steps``, each target stopping by itself.

    A target stops when its held-out error has not fallen for ``patience`` rounds, and goes back to
    the round with the least one. Round 0 is the mean.
    """
    p = train.width
    mean, cov, std = train.moments()
    scale = np.where(std[:p] > 0, std[:p], 1.0)
    c = np.where(np.outer(std[:p], std[:p]) > 0, cov[:p, :p] / np.outer(scale, scale), 0.0)
    rate = 1.0 / max(np.linalg.eigvalsh(c)[-1], 1e-12) if p else 1.0
    center, n = np.concatenate((mean[:p], mean[p:])), max(held_out.n, 1.0)
    g = held_out.products / n
    shifted = g[1:, 1:] - np.outer(g[0, 1:], center) - np.outer(center, g[0, 1:]) + np.outer(center, center)
    held_xx, held_xy, held_yy = shifted[:p, :p] / np.outer(scale, scale), shifted[:p, p:] / scale[:, None], np.diag(shifted)[p:]
    out, errors, best = np.zeros((len(targets), p)), {}, {}
    for k, target in enumerate(targets):
        b = cov[:p, p + k] / scale
        w, kept, curve = np.zeros(p), np.zeros(p), [float(held_yy[k])]
        at = 0
        for nth in range(1, rounds + 1):
            for _ in range(steps):
                w = w + rate * (b - c @ w)
            curve.append(float(held_yy[k] - 2 * w @ held_xy[:, k] + w @ held_xx @ w))
            if curve[-1] < curve[at]:
                at, kept = nth, w
            elif nth - at >= patience:
                break
        out[k], errors[target], best[target] = kept / scale, curve, at
    return LinearTargets(list(targets), mean[p:] - out @ mean[:p], out), Rounds(errors, best)


def joined(*parts: LinearTargets) -> LinearTargets:
    """One table of several fits over the same features."""
    return LinearTargets(
        [r for x in parts for r in x.rows], np.concatenate([x.intercepts for x in parts]),
        np.vstack([x.coefficients for x in parts]), [h for x in parts for h in x.heads], [h for x in parts for h in x.hidden],
    )

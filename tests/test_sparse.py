"""Sparse one-hot vectors over many categories."""

from __future__ import annotations

from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from pacelake.operators import sparse
from pacelake.operators.sparse import SparseOneHot


def test_a_hundred_thousand_categories_encode_and_invert(spark):
    n = 100_001  # above what may be broadcast
    df = spark.range(n).select("id", F.concat(F.lit("c"), "id").alias("c"))
    coder = SparseOneHot.fit(df, ["c"])
    coded = coder.transform(df)
    cells = F.unwrap_udt("c_hot")
    seen = coded.select(cells["size"].alias("size"), F.get(cells["indices"], F.lit(0)).alias("at"), F.size(cells["values"]).alias("n"))
    got = seen.agg(F.min("size"), F.max("size"), F.count_distinct("at"), F.min("n"), F.max("n")).first()
    assert tuple(got) == (n, n, n, 1, 1)
    back = coder.inverse_transform(coded)
    assert back.count() == n and back.filter(F.col("c") != F.concat(F.lit("c"), "id")).count() == 0


def test_null_unknown_and_empty(spark):
    rows = [(1, "b", None), (2, "a", None), (3, None, None), (4, "b", None)]
    df = spark.createDataFrame(rows, "id int, `x.y` string, empty string")
    coder = SparseOneHot.fit(df, ["x.y", "empty"])
    assert coder.sizes == {"x.y": 2, "empty": 1} and coder.fill == {"x.y": "b"}
    more = df.union(spark.createDataFrame([(5, "new", "text")], df.schema))
    coded = coder.transform(more)
    found = {r["id"]: r for r in coded.collect()}
    assert [found[i]["x.y_hot"].toArray().tolist() for i in range(1, 6)] == [[0, 1], [1, 0], [0, 1], [0, 1], [0, 0]]
    assert all(r["empty_hot"].toArray().tolist() == [0] for r in found.values())
    back = {r["id"]: (r["x.y"], r["empty"]) for r in coder.inverse_transform(coded).collect()}
    assert back == {1: ("b", None), 2: ("a", None), 3: ("b", None), 4: ("b", None), 5: (None, None)}
    assert coder.transform(df.limit(0)).count() == 0


def test_no_category_is_described_in_the_schema(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("c"))
    coded = SparseOneHot.fit(df, ["c"]).transform(df)
    assert coded.schema["c_hot"].metadata == {}
    assert "ml_attr" not in coded._jdf.schema().json()


def test_a_table_without_rows(spark):
    df = spark.createDataFrame([], "id int, c string")
    coder = SparseOneHot.fit(df, ["c"])
    assert coder.sizes == {"c": 1} and coder.transform(df).count() == 0


def test_dense_predictions_are_read_by_their_largest_value(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, c string")
    coder = SparseOneHot.fit(df, ["c"])
    guesses = [(1, Vectors.dense(0.1, 0.7, 0.7)), (2, Vectors.sparse(3, [2], [0.4])), (3, Vectors.dense(-1.0, 0.0, 0.0))]
    got = coder.inverse_transform(spark.createDataFrame(guesses, ["id", sparse.hot("c")]))
    assert dict(map(tuple, got.select("id", "c").collect())) == {1: "b", 2: "c", 3: None}

"""Work that is done once: neighbour searches of a training, comparisons of many small groups, the matrix of one pass."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.features import _history, _named
from checks.views import Views
from pacelake.operators import features, forecast as M, impute, linear, windows
from pacelake.operators.impute import NeighbourImputer

SF = "/root/testdata/sf0.001"
CONFIG = M.Config(window_rows=8, mode="asof")


@pytest.fixture(scope="module")
def tables(spark):
    v = Views(spark, SF)
    return _history(v), _named(v)


def test_training_searches_neighbours_once_per_table(tables, monkeypatch):
    searched, whole = [], NeighbourImputer.transform
    monkeypatch.setattr(NeighbourImputer, "transform", lambda self, df: searched.append(self.row_id) or whole(self, df))
    M.train(*tables, CONFIG)
    assert sorted(searched) == ["activity_id", "row_id"]


def test_training_in_one_pass_keeps_no_matrix(tables, monkeypatch):
    def refused(self, *_, **__):
        raise AssertionError("a checkpoint")

    kept, staged = [], M.staged
    monkeypatch.setattr(type(tables[0]), "checkpoint", refused)
    monkeypatch.setattr(M, "staged", lambda df: kept.append(df.columns) or staged(df))
    M.train(*tables, CONFIG)
    assert not any("features" in columns for columns in kept)


def test_fitted_table_is_that_of_transform(tables):
    history, sessions = tables
    for table, settings, keep in (
        (history, features.history_settings("row_id"), ["beginTimestamp"]), (sessions, features.session_settings("activity_id"), ["start_time"]),
    ):
        model, encoded = features.fit_transform(table, settings, keep)
        again = model.transform(table, keep)
        assert encoded.columns == again.columns
        key = settings.row_id
        one, two = (df.orderBy(key).toPandas() for df in (encoded, again))
        pd.testing.assert_frame_equal(one, two)


@pytest.mark.parametrize("most", [7, 1 << 18])
def test_small_groups_are_compared_together(monkeypatch, most):
    monkeypatch.setattr(impute, "_CELLS", most)
    rng = np.random.default_rng(5)
    n = 6000
    a = pd.DataFrame({"u": rng.integers(0, 1500, n).astype(float), "rid": np.arange(n), "v0": rng.integers(0, 9, n), "v1": rng.random(n)})
    a.loc[::3, "v0"], a.loc[::50, "v1"], a.loc[::40, "u"] = np.nan, np.nan, np.nan  # no neighbours without an athlete
    b = a.sample(frac=1.0, random_state=3).rename(columns={"u": "d_u"})
    groups = impute._Groups.of(a, b, ["u"])
    if most > n:
        assert len(list(groups.slabs())) < 10
    got = impute._fill_blocks(["u"], 2, 3)(a, b).set_index("rid")
    for rid in [*range(0, 300, 3), *range(0, 2000, 50)]:
        row, near = a.loc[rid], a[a["u"] == a.loc[rid, "u"]]
        for c in ("v0", "v1"):
            if pd.isna(row[c]):
                both = [(x, y) for x in ("v0", "v1") for y in [near[x] - row[x]]]
                gaps = pd.concat([y for _, y in both], axis=1)
                shared = gaps.notna().sum(axis=1)
                far = ((gaps ** 2).sum(axis=1) * 2 / shared).where(shared > 0)
                own = pd.DataFrame({"far": far, "rid": near["rid"], "x": near[c]}).dropna().sort_values(["far", "rid"])
                want = own["x"].head(3).mean()
                assert (pd.isna(want) and pd.isna(got.loc[rid, c])) or got.loc[rid, c] == pytest.approx(want)


def test_positions_after_each_other_are_cut_by_place(spark):
    rows = [(1, i, i) for i in range(7)] + [(2, 0, 0)]
    past = spark.createDataFrame(rows, "user_id int, pos long, begin long").withColumn("x", F.array(F.col("pos").cast("double")))
    chunks = windows.pack_chunks(past, ["begin", "x"], 3)
    holed = windows.pack_chunks(past.filter("pos <> 3"), ["begin", "x"], 3)
    ends = spark.createDataFrame([(u, e) for u in (1, 2, 3) for e in (-1, 0, 1, 3, 4, 7, 9, 30)], "user_id int, end long")
    for packed, there in ((chunks, range(7)), (holed, [0, 1, 2, 4, 5, 6])):
        for r in windows.rows_before(packed, ends, "end", 3).collect():
            have = there if r["user_id"] == 1 else [0] if r["user_id"] == 2 else []
            assert [w["pos"] for w in r["window"]] == [p for p in have if r["end"] - 3 <= p < r["end"]], r


def test_a_matrix_without_rows_is_an_error(spark):
    empty = spark.createDataFrame([], "features array<double>, y double")
    with pytest.raises(ValueError, match="no rows"):
        linear.grams(empty, ["y"], width=2)

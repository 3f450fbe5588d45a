"""Operators on small hand-made frames, with expected values worked out by hand."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacelake.functions import cyclic, scalars as S
from pacelake.operators import cleaning, features, ordering, profile, quantiles, reports, windows
from pacelake.operators.impute import NeighbourImputer, fit_neighbour_imputer
from pacelake.operators.quantiles import exact_quantiles

T0 = dt.datetime(2024, 1, 1, 6, 0)


def one(df):
    return [tuple(r) for r in df.collect()]


# -- scalars -----------------------------------------------------------------


def test_duration_wraps_at_midnight(spark):
    df = spark.sql("""SELECT TIMESTAMP_NTZ '2024-01-01 23:50:00' AS a, TIMESTAMP_NTZ '2024-01-02 00:20:00' AS b""")
    s = S.duration_seconds("a", "b")
    assert one(df.select(s, S.duration_text(s))) == [(1800, "0h30")]
    back = S.duration_seconds("b", "a")
    assert one(df.select(back, S.duration_text(back))) == [(84600, "23h30")]


def test_times_of_day_without_date_give_a_duration(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '1970-01-01 23:00:00' AS a, TIMESTAMP_NTZ '1970-01-01 01:05:59' AS b")
    assert one(df.select(S.duration_text(S.duration_seconds("a", "b")))) == [("2h5",)]


def test_rounding_goes_to_even(spark):
    df = spark.sql("SELECT 0.125D AS a, 0.375D AS b, 2.5D AS c")
    got = one(df.select(S.round_half_even("a", 2), S.round_half_even("b", 2), S.round_half_even("c", 0)))
    assert got == [(0.12, 0.38, 2.0)]


def test_short_arrays_give_null(spark):
    df = spark.sql("SELECT array(named_struct('statsValue', 5.0D)) AS a")
    assert one(df.select(*[S.element_or_null("a", i, "statsValue") for i in (0, 1, 2)])) == [(5.0, None, None)]


def test_benefit_labels(spark):
    df = spark.createDataFrame([(0.0,), (7.0,), (8.0,), (2.5,), (None,)], "c double")
    assert [r[0] for r in one(df.select(S.benefit_label("c")))] == ["None", "Speed", None, None, None]
    text = spark.createDataFrame([("2.5",), ("3.5",), ("Tempo",), ("9",), (None,)], "c string")
    assert [r[0] for r in one(text.select(S.benefit_text("c")))] == ["Base", "Threshold", "Tempo", "9", None]


def test_free_text_dates(spark):
    df = spark.createDataFrame([("08/10/2023 17:16",), ("2023-10-08",), ("no date",)], "t string")
    got = one(df.select(S.parse_time("t", ["dd/MM/yyyy HH:mm", "yyyy-MM-dd"]).cast("string")))
    assert [r[0] for r in got] == ["2023-10-08 17:16:00", "2023-10-08 00:00:00", None]


def test_time_of_day_round_trip(spark):
    day = spark.range(1440).select(
        "id", (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("t")
    )
    sine, cosine = cyclic.encode_time("t")
    exact = cyclic.decode_time(sine, cosine, snap=True)
    plain = cyclic.decode_time(sine, cosine)
    for minute, snapped, cut in one(day.select("id", exact, plain)):
        assert snapped == f"{minute // 60}:{minute % 60:02d}:00"
        # Each part is cut off on its own, so noise can put any of them one too low.
        h, m, s = map(int, cut.split(":"))
        assert h in (minute // 60, minute // 60 - 1)
        assert m in (minute % 60, (minute - 1) % 60) and s in (0, 59)


def test_known_points_of_the_circle(spark):
    df = spark.createDataFrame([(0.0, 1.0), (-1.0, 0.0), (1.0, 0.0)], "s double, c double")
    assert [r[0] for r in one(df.select(cyclic.decode_time("s", "c")))] == ["0:00:00", "18:00:00", "6:00:00"]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "c double")
    assert [r[0] for r in one(df.select(S.null_if_nan("c")))] == [None, 1.0, None]


# -- cleaning and order --------------------------------------------------------


def test_workouts_with_equal_begin_stay_by_default(spark):
    from pacelake.schemas import WORKOUT

    rows = [dict(user_id=1, beginTimestamp=1_704_067_200_000, distance=float(i)) for i in range(2)]
    df = spark.createDataFrame(rows, WORKOUT)
    assert cleaning.clean_workouts(df).count() == 2
    kept = cleaning.clean_workouts(df, dedup=True, tiebreak="distance").select("distance", "date", "beginTimestamp")
    assert one(kept) == [(0.0, dt.date(2024, 1, 1), dt.datetime(2024, 1, 1))]


@pytest.fixture(scope="module")
def tangled(spark):
    """One athlete with a third of all rows and many equal times."""
    rng = random.Random(3)
    rows = [(1 if i % 3 == 0 else 2 + i % 7, T0 + dt.timedelta(minutes=rng.randrange(50)), i) for i in range(600)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "user_id long, t timestamp_ntz, id long").repartition(5)


def test_positions_do_not_depend_on_the_path(tangled):
    rows, df = tangled
    want, seen = {}, {}
    for u, _, i in sorted(rows):
        want[i] = seen.get(u, 0)
        seen[u] = want[i] + 1
    for limit in (10**6, 0):
        got = ordering.number_rows(df, ["user_id"], ["t", "id"], max_group_rows=limit)
        assert {r["id"]: r["pos"] for r in got.collect()} == want


def test_running_sum_with_weights_on_the_split_path(tangled):
    rows, df = tangled
    want, seen = {}, {}
    for u, _, i in sorted(rows):
        seen[u] = seen.get(u, 0) + i
        want[i] = seen[u]
    got = ordering.running_sum(df, ["user_id"], ["t", "id"], F.col("id"), "s", max_group_rows=10)
    assert {r["id"]: r["s"] for r in got.collect()} == want


def test_newest_per_key_beyond_the_built_in_limit(tangled):
    _, df = tangled
    few = ordering.newest_per_key(df, ["user_id"], "t", "id", 120)
    many = ordering.newest_per_key(df, ["user_id"], "t", "id", 1200)
    assert few.groupBy("user_id").count().agg(F.max("count")).first()[0] == 120
    assert many.count() == 600
    assert sorted(one(few.select("id", "age"))) == sorted(one(many.filter("age <= 120").select("id", "age")))


def test_first_per_key_keeps_whole_rows(tangled):
    rows, df = tangled
    got = ordering.first_per_key(df, ["user_id"], ["t", "id"])
    want = {u: min((t, i) for v, t, i in rows if v == u) for u in {r[0] for r in rows}}
    assert {r["user_id"]: (r["t"], r["id"]) for r in got.collect()} == want


# -- windows ---------------------------------------------------------------------


def _history(spark, n):
    rows = [(1, T0 + dt.timedelta(hours=i), i, float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "user_id long, begin_ts timestamp_ntz, row_id long, load double")


def test_window_for_date_skips_the_newest_row(spark):
    h = _history(spark, 100)
    date = F.lit("2024-01-03 12:00:00").cast("timestamp_ntz")  # rows 0..53 begin before
    ids = sorted(r["row_id"] for r in windows.window_for_date(h, date, n=10).collect())
    assert ids == list(range(43, 53))
    ids = sorted(r["row_id"] for r in windows.window_for_date(h, date, n=10, skip_latest=False).collect())
    assert ids == list(range(44, 54))


def test_training_windows_have_full_length_and_can_be_short(spark):
    h = _history(spark, 100)
    rows = [(1, T0 + dt.timedelta(hours=i, minutes=30), i) for i in range(120)]
    s = spark.createDataFrame(rows, "user_id long, start_time timestamp_ntz, activity_id long")
    got = windows.training_windows(h, s, ["load"], n=60)
    lengths = {r["activity_id"]: [x["pos"] for x in r["window"]] for r in got.collect()}
    assert sorted(lengths) == list(range(60, 120))
    assert lengths[60] == list(range(0, 60)) and lengths[100] == list(range(40, 100))
    assert lengths[119] == list(range(59, 100))  # the history ends before the sessions do
    asof = windows.training_windows(h, s, ["load"], n=60, mode="asof")
    assert {len(r["window"]) for r in asof.collect()} == {60}


def test_empty_windows_are_padded(spark):
    h = windows.feature_vector(_history(spark, 5), ["load"])
    anchors = spark.createDataFrame([(1, T0), (2, T0)], "user_id long, anchor timestamp_ntz")
    framed = windows.windows_for_anchors(h, anchors, ["x"], n=3)
    out = windows.summarise(windows.flat_matrix(framed, 1, 3), 1)
    for r in out.collect():
        assert r["matrix"] == [0.0, 0.0, 0.0] and r["padded_rows"] == 3
        assert (r["window_mean"], r["window_last"], r["window_trend"]) == ([0.0], [0.0], [0.0])


def test_window_summary(spark):
    h = windows.feature_vector(_history(spark, 5), ["load"])
    anchors = spark.createDataFrame([(1, T0 + dt.timedelta(days=1))], "user_id long, anchor timestamp_ntz")
    r = windows.summarise(windows.windows_for_anchors(h, anchors, ["x"], n=3), 1).first()
    assert [x["pos"] for x in r["window"]] == [1, 2, 3]
    assert (r["window_mean"], r["window_last"], r["window_trend"]) == ([2.0], [3.0], [1.5])


# -- profiles ---------------------------------------------------------------------


@pytest.mark.parametrize("values", [
    list(range(5000)),
    [1.0] * 3000 + [float(i) for i in range(2000)],
    [1.0] * 2500 + [2.0] * 2500,
    [1.0] * 1250 + [5.0] * 1250 + [7.0] * 2500,
    [-1e9, 1e9] + [0.1 * i for i in range(4000)],
])
def test_exact_quantiles(spark, values):
    values = [float(v) for v in values]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(4)
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    want = np.quantile(values, probs)
    for limit in (10**6, 100):
        assert exact_quantiles(df, ["v"], probs, limit)["v"] == pytest.approx(want, abs=1e-9)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i),) for i in (0, 1, 2, 10, 10)], "v double")
    assert [r["n"] for r in profile.histogram(df, "v", 5).orderBy("bin").collect()] == [2, 1, 0, 0, 2]
    flat = spark.createDataFrame([(3.0,)] * 4, "v double")
    assert [r["n"] for r in profile.histogram(flat, "v", 10).orderBy("bin").collect()] == [0] * 5 + [4] + [0] * 4
    empty = spark.createDataFrame([(None,)], "v double")
    assert [r["n"] for r in profile.histogram(empty, "v", 2).collect()] == [0, 0]


def test_sums_of_empty_groups_are_zero(spark):
    df = spark.createDataFrame([(T0, None)], "timestamp timestamp_ntz, total_distance double")
    assert one(reports.distance_by_year_month(df)) == [(2024, 1, 0.0)]


def test_speed_trend_shows_gaps(spark):
    rows = [("running", dt.datetime(2024, m, 5), 2.0) for m in (1, 3)]
    df = spark.createDataFrame(rows, "sport string, timestamp timestamp_ntz, enhanced_avg_speed double")
    got = reports.speed_trend(df).orderBy("month").collect()
    assert [r["avg_kmh"] for r in got] == [7.2, None, 7.2]


def test_sparse_columns_at_the_share(spark):
    df = spark.createDataFrame([(1, None, None)] * 6 + [(1, 1, None)] * 4, "a int, b int, c int")
    assert profile.sparse_columns(df) == ["b", "c"]
    assert profile.drop_empty(df).columns == ["a", "b"]


# -- encoders -----------------------------------------------------------------------


def test_constant_column_scales_by_one(spark):
    df = spark.createDataFrame([(1.0,)] * 4, "a double")
    scaler = features.RobustScaler.fit(df, ["a"])
    assert one(scaler.transform(spark.createDataFrame([(5.0,)], "a double"))) == [(4.0,)]


def test_scaler_round_trip_and_sketch(spark):
    df = spark.range(1001).select((F.col("id") * 1.5).alias("a"))
    scaler = features.RobustScaler.fit(df, ["a"])
    assert scaler.stats == {"a": [750.0, 750.0]}
    assert features.RobustScaler.fit_approximate(df, ["a"]).stats["a"] == pytest.approx([750, 750], rel=0.01)
    back = scaler.inverse_transform(scaler.transform(df))
    assert [r[0] for r in back.collect()] == pytest.approx([r[0] for r in df.collect()])


def test_one_hot_cases(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,), ("a",)], "s string")
    hot = features.OneHot.fit(df, ["s"])
    assert hot.names("s") == ["s_a", "s_b", "s_c"] and hot.fill == {"s": "a"}
    new = spark.createDataFrame([("z",), (None,), ("b",)], "s string")
    assert one(hot.transform(new)) == [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)]
    assert [r[0] for r in one(hot.inverse_transform(hot.transform(new)))] == [None, "a", "b"]
    two = features.OneHot.fit(df.filter("s <> 'c'"), ["s"])
    assert two.names("s") == ["s_b"]
    assert [r[0] for r in one(two.inverse_transform(two.transform(new)))] == ["a", "a", "b"]
    with pytest.raises(ValueError):
        features.OneHot.fit(df, ["s"], limit=2)


def _brute_force(rows, ids, k):
    x = np.array(rows, dtype=float)
    out = x.copy()
    width = x.shape[1]
    for i in range(len(x)):
        for f in np.flatnonzero(np.isnan(x[i])):
            near = []
            for j in range(len(x)):
                both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                if not np.isnan(x[j, f]) and both.any():
                    near.append((((x[i] - x[j])[both] ** 2).sum() * width / both.sum(), ids[j], x[j, f]))
            near.sort()
            known = x[~np.isnan(x[:, f]), f]
            out[i, f] = np.mean([v for _, _, v in near[:k]]) if near else known.mean() if len(known) else np.nan
    return out


@pytest.mark.parametrize("tile_rows", [10**6, 40, 7])
def test_imputation_equals_brute_force(spark, tile_rows):
    """Whole numbers on a small grid: many equal rows, equal distances, rows without values."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, size=(160, 3)).astype(float)
    x[rng.random(x.shape) < 0.25] = np.nan
    x[:40] = [2.0, np.nan, 1.0]  # copies with a hole
    x[40:90] = [2.0, 3.0, 1.0]  # copies without
    x[90] = np.nan
    ids = list(range(160))
    cells = [[None if np.isnan(v) else float(v) for v in row] for row in x]
    df = spark.createDataFrame(
        [(1, i, *row) for i, row in zip(ids, cells)] + [(2, 7, 1.0, None, None)],
        "user_id long, id long, a double, b double, c double",
    ).repartition(3)
    model = fit_neighbour_imputer(df, ["a", "b", "c"], "id", tile_rows=tile_rows)
    got = {(r["user_id"], r["id"]): r for r in model.transform(df).collect()}
    want = _brute_force(x, ids, 4)
    for i in ids:
        assert [got[1, i][c] for c in "abc"] == pytest.approx(list(want[i])), i
    # an athlete without any donor takes the mean over all
    assert got[2, 7]["b"] == pytest.approx(np.nanmean(x[:, 1]))


@pytest.mark.parametrize("spread", [1.0, 50.0])
def test_large_athlete_with_holes_visits_few_tiles(spark, spread):
    """4,000 rows, a third of all cells missing; the values are those of brute force, and the index is written once."""
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (4000, 3)) * [1.0, spread, 1.0]
    x[:, 2] = x[:, 0] + rng.normal(0, 0.05, 4000)
    x[rng.random(x.shape) < 1 / 3] = np.nan
    rows = [(1, i, *(None if np.isnan(v) else float(v) for v in row)) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "user_id long, id long, a double, b double, c double").repartition(4)
    model = fit_neighbour_imputer(df, ["a", "b", "c"], "id", tile_rows=50)
    visited = []
    nearest = NeighbourImputer._nearest
    model._nearest = lambda visits, tiles: visited.append(visits.count()) or nearest(model, visits, tiles)
    got = {r["id"]: [r["a"], r["b"], r["c"]] for r in model.transform(df).collect()}
    whole = fit_neighbour_imputer(df, ["a", "b", "c"], "id", tile_rows=10**6)
    want = {r["id"]: [r["a"], r["b"], r["c"]] for r in whole.transform(df).collect()}
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[i] for i in sorted(got)], [want[i] for i in sorted(want)], rtol=1e-9)
    asked = int(np.isnan(x).any(axis=1).sum())
    tiles = model._index[1].count()
    assert tiles >= 80 and sum(visited) / asked < 12, (tiles, sum(visited) / asked)
    assert model._index is model._index


def test_many_incomplete_rows_of_few_donors_are_dealt_over_parts(spark):
    donors = spark.createDataFrame([(1, i, float(i), float(i % 3)) for i in range(12)], "user_id long, id long, a double, b double")
    rows = spark.createDataFrame([(1, 100 + i, i / 7, None) for i in range(90)], donors.schema)
    small, split = (fit_neighbour_imputer(donors, ["a", "b"], "id", tile_rows=n).transform(rows) for n in (1000, 20))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, split.collect()))


def test_imputation_does_not_depend_on_partitions(spark):
    df = spark.range(300).select(
        (F.col("id") % 4).alias("user_id"), "id", F.when(F.col("id") % 5 != 0, F.col("id") % 13).cast("double").alias("a"),
        (F.col("id") % 17).cast("double").alias("b"),
    )
    model = fit_neighbour_imputer(df, ["a", "b"], "id")
    first = sorted(one(model.transform(df.repartition(7))))
    again = sorted(one(fit_neighbour_imputer(df.repartition(3), ["a", "b"], "id").transform(df.coalesce(1))))
    assert first == again and all(v is not None for row in first for v in row)


def test_quantiles_of_many_columns_in_batches(spark):
    rows = [(float(i), float(i % 7), None) for i in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = exact_quantiles(df, ["a", "b", "c"], [0.0, 0.5, 1.0], 120)
    assert got == exact_quantiles(df, ["a", "b", "c"], [0.0, 0.5, 1.0])
    assert got["a"] == [0.0, 249.5, 499.0] and got["c"] == [None] * 3
    assert list(quantiles._batches("abcd", [3, 3, 9, 1], 6)) == [["a", "b"], ["c"], ["d"]]


def test_correlation_over_known_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(1e6, 1.0, 400)
    y = x * 2 + rng.normal(0, 1.0, 400)
    rows = [
        (float(a), None if i % 3 == 0 else float(b), float("nan") if i % 5 == 0 else float(-a), 0.1, None)
        for i, (a, b) in enumerate(zip(x, y))
    ]
    df = spark.createDataFrame(rows, "x double, `y.1` double, z double, same double, none double").repartition(3)
    names = df.columns
    got = {(r["a"], r["b"]): r["r"] for r in profile.correlation(df, names).collect()}
    assert len(got) == 25 and got["x", "x"] == pytest.approx(1)
    known = np.arange(400) % 3 > 0
    assert got["x", "y.1"] == got["y.1", "x"] == pytest.approx(np.corrcoef(x[known], y[known])[0, 1], abs=1e-9)
    assert got["x", "z"] == pytest.approx(-1, abs=1e-9)
    assert all(got[a, b] is None for a in names for b in ("same", "none"))
    assert {r["r"] for r in profile.correlation(df.limit(0), names).collect()} == {None}


def test_recent_rows_hold_every_window(spark):
    rows = [(u, i, f"2024-01-{1 + i % 28:02d} 0{u}:00:00" if i % 9 else None, i) for u in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id long, row_id long, t string, age int")
    df = df.withColumn("begin_ts", F.col("t").cast("timestamp_ntz"))
    recent = windows.recent_rows(df, 4, n=5)
    assert recent.columns == df.columns and recent.count() < df.count() / 2
    kept = {(r["user_id"], r["row_id"]): r["age"] for r in recent.collect()}
    assert all(age == row for (_, row), age in kept.items())
    every = windows.windows_for_anchors(df, windows.day_anchors(df, 4), ["row_id"], n=5)
    some = windows.windows_for_anchors(recent, windows.day_anchors(recent, 4), ["row_id"], n=5)
    ids = [
        {(r["user_id"], r["days_back"]): [w["row_id"] for w in r["window"]] for r in framed.collect()}
        for framed in (every, some)
    ]
    assert ids[0] == ids[1] and all(ids[0].values())


@pytest.mark.parametrize("text, want", [
    ("08/10/2023 17:16", "2023-08-10 17:16:00"), ("2023-10-08 07:05:09.25", "2023-10-08 07:05:09.250000"),
    ("25/12/2023", "2023-12-25 00:00:00"), (" 8.1.2024T9:30 ", "2024-08-01 09:30:00"), ("7:05:30", "1970-01-01 07:05:30"),
    ("02/30/2023", None), ("soon", None), ("", None), (None, None), ("2023-10-08Z", None),
])
def test_free_times_by_shape(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    found = df.select(S.parse_free_time("t").alias("a"), S.parse_free_time("t", day_first=True).alias("b")).first()
    assert (None if found["a"] is None else str(found["a"])) == want
    if text == "08/10/2023 17:16":
        assert str(found["b"]) == "2023-10-08 17:16:00"

"""Encoders and forecast over the smallest supplied tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from checks.features import _history, _named
from checks.views import Views
from pacelake.operators import features, forecast as M
from pacelake.schemas import BENEFIT_LABELS

SF = "/root/testdata/sf0.001"
CONFIG = M.Config(window_rows=8, mode="asof")
CLOCK = r"^\d{1,2}:\d\d:\d\d$"


@pytest.fixture(scope="module")
def tables(spark):
    v = Views(spark, SF)
    return _history(v), _named(v)


@pytest.fixture(scope="module")
def model(tables):
    return M.train(*tables, CONFIG)


def test_encoded_rows_have_no_nulls(tables, model):
    for table, encoder in zip(tables, (model.history_encoder, model.session_encoder)):
        out = encoder.transform(table)
        nulls = out.agg(*[F.count_if(F.col(f"`{c}`").isNull()) for c in encoder.feature_columns]).first()
        assert sum(nulls) == 0 and out.count() == table.count()


def test_encoder_is_undone(tables, model):
    _, sessions = tables
    encoder = model.session_encoder
    back = encoder.inverse_transform(encoder.transform(sessions), keep=["activity_id"])
    both = sessions.select(
        "activity_id", F.col("sport").alias("s"), F.col("max_heart_rate").alias("h"), F.col("start_time").alias("t")
    ).join(back, "activity_id")
    bad = both.filter((F.col("s") != F.col("sport")) | (F.abs(F.col("h") - F.col("max_heart_rate")) > 1e-9)
                      | ~F.col("start_time").rlike(CLOCK))
    assert bad.count() == 0 and both.count() == sessions.count()


def test_matrix_has_full_windows(tables, model):
    matrix = M.training_matrix(*tables, model.history_encoder, model.session_encoder, CONFIG)
    width = 3 * len(model.history_encoder.feature_columns)
    for r in matrix.collect():
        assert r["session_no"] >= 8 and r["window_rows"] <= 8 and len(r["features"]) == width


def test_predictions_are_readable(tables, model):
    history, sessions = tables
    users = history.select("user_id").distinct().count()
    days = model.predict_for_last_days(history, 3)
    rows = days.collect()
    assert len(rows) == 3 * users
    sports = {r[0] for r in sessions.select("sport").distinct().collect()}
    for r in rows:
        assert r["sport"] in sports and r["188"] in BENEFIT_LABELS.values()
        assert all(len(r[c].split(":")) == 3 for c in ("start_time", "timestamp"))


def test_comparison_tags_and_days(tables, model):
    history, sessions = tables
    date = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    both = M.compare_for_date(model.predict_for_date(history, date), sessions, date)
    counts = {r[0]: r[1] for r in both.groupBy("source").count().collect()}
    assert counts["real"] == sessions.filter("to_date(start_time) = DATE '2024-01-20'").count()
    far = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    alone = M.compare_for_date(model.predict_for_date(history, far), sessions, far)
    assert {r[0] for r in alone.select("source").distinct().collect()} == {"prediction"}


def test_stored_model_predicts_the_same(spark, tables, model, tmp_path):
    history, _ = tables
    model.save(str(tmp_path / "model"), spark)
    loaded = M.ForecastModel.load(str(tmp_path / "model"), spark)
    a = model.next_activity(history).orderBy("user_id").collect()
    b = loaded.next_activity(history).orderBy("user_id").collect()
    assert a == b and len(a) > 0


def test_model_of_one_sport_predicts_that_sport(tables):
    history, sessions = tables
    model = M.train_per_sport(history, sessions, CONFIG, ["running"])["running"]
    assert model.session_encoder.one_hot.values["sport"] == ["running"]
    got = {r[0] for r in model.next_activity(history).select("sport").collect()}
    assert got <= {"running", None}


def test_plain_encoder_keeps_speeds_as_numbers(tables):
    _, sessions = tables
    encoder = features.fit_plain_session_encoder(sessions, "activity_id")
    assert "enhanced_avg_speed" in encoder.neighbour_columns and "188" in encoder.neighbour_columns
    assert not encoder.indicator_columns

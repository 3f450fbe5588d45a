"""Readers and writers over small files in a temporary folder."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pacelake.operators import cleaning
from pacelake.operators.ordering import first_per_key
from pacelake.schemas import DAILY_FILE, SLEEP_FILE
from pacelake.sources import messages, readers, sinks

NIGHT = {
    "user_id": 1, "calendarDate": "2024-01-02", "sleepStartTimestampGMT": "2024-01-01T22:10:00.0",
    "sleepEndTimestampGMT": "2024-01-02T06:00:00.0", "deepSleepSeconds": 3600, "lightSleepSeconds": 7200,
    "remSleepSeconds": None, "awakeSleepSeconds": 60, "sleepScores": {"qualityScore": "80"}, "retro": False,
}
DAY = {
    "user_id": 1, "calendarDate": "2024-01-02", "hydration": {"sweatLossInML": 500.0},
    "respiration": {"avgWakingRespirationValue": 14.0}, "totalSteps": 9000, "totalDistanceMeters": 7000.0,
    "bodyBattery": {"bodyBatteryStatList": [{"statsValue": 90.0}]},
    "allDayStress": {"aggregatorList": [{"averageStressLevel": 1.0}, {"averageStressLevel": 2.0}, {"averageStressLevel": 3.0}]},
}
MS = 1_704_186_000_000  # 2024-01-02 09:00:00 UTC


@pytest.fixture()
def exports(tmp_path):
    def put(folder, name, content):
        path = tmp_path / folder
        path.mkdir(exist_ok=True)
        (path / name).write_text(json.dumps(content))

    later = {**NIGHT, "sleepStartTimestampGMT": "2024-01-02T13:00:00.0", "sleepScores": None}
    put("sleep", "a.json", [NIGHT, later])
    put("sleep", "b.json", [{**NIGHT, "deepSleepSeconds": 1}, {**NIGHT, "calendarDate": "2024-01-03"}])
    (tmp_path / "sleep" / "notes.txt").write_text("not json")
    run = {"user_id": 1, "beginTimestamp": MS, "sportType": "RUNNING", "distance": 1000.0, "summary": {"laps": {"n": 3}}}
    put("workouts", "a.json", [{"summarizedActivitiesExport": [run, {**run, "sportType": "CYCLING"}]}])
    put("workouts", "b.json", [{"somethingElse": 1}])
    put("daily", "a.json", [DAY, {**DAY, "totalDistanceMeters": 1.0}, {**DAY, "calendarDate": "2018-05-05"}])
    put("daily", "b.json", [{"user_id": 1, "calendarDate": "2024-01-03"}])
    return {k: str(tmp_path / k) for k in ("sleep", "workouts", "daily")}


def test_sleep_keeps_the_first_in_file_order(spark, exports):
    rows = cleaning.clean_sleep(readers.read_json_folder(spark, exports["sleep"], SLEEP_FILE)).orderBy("start_sleep").collect()
    assert len(rows) == 3
    first = [r for r in rows if str(r["date"]) == "2024-01-02"][0]
    assert first["deepSleepSeconds"] == 3600 and first["qualityScore"] == "80" and first["remSleepSeconds"] is None
    assert rows[-1]["qualityScore"] is None


def test_columns_are_united_without_schema(spark, exports):
    df = readers.read_json_folder(spark, exports["daily"])
    assert {"hydration", "totalSteps", "calendarDate"} <= set(df.columns) and df.count() == 4


def test_workouts_are_flattened(spark, exports):
    df = readers.read_workouts(spark, exports["workouts"], schema=None)
    assert df.count() == 2 and "summary.laps.n" in df.columns
    assert [r[0] for r in df.select("`summary.laps.n`").collect()] == [3, 3]


def test_daily_values_by_position(spark, exports):
    rows = cleaning.clean_daily(readers.read_json_folder(spark, exports["daily"], DAILY_FILE)).orderBy("calendarDate").collect()
    assert [str(r["calendarDate"]) for r in rows] == ["2024-01-02", "2024-01-03"]
    day = rows[0]
    assert (day["bodyBattery_Highest"], day["bodyBattery_Lowest"]) == (90.0, None)
    assert (day["allDayStress_awake"], day["allDayStress_asleep"]) == (2.0, 3.0)
    assert day["hydration_sweatLossInML"] == 500.0 and day["totalDistanceMeters"] == 7000.0
    assert "totalSteps" not in rows[0].asDict() and rows[1]["hydration_sweatLossInML"] is None


def test_history_falls_back_to_csv_then_raw(spark, exports, tmp_path):
    merged = readers.merge_exports(spark, **exports)
    assert merged.count() == 5  # two nights of the day with two workouts each, one without
    csv = str(tmp_path / "history.csv")
    raw = readers.load_history(spark, table="no_such_table", csv=csv, raw=exports)
    assert raw.count() == 4  # the night without workout has no begin
    from pacelake.schemas import HISTORY

    sinks.write_csv(merged.select(*[f.name for f in HISTORY]), csv)
    again = readers.load_history(spark, table="no_such_table", csv=csv)
    assert sorted(r["sportType"] for r in again.collect()) == ["CYCLING", "CYCLING", "RUNNING", "RUNNING"]
    with pytest.raises(FileNotFoundError):
        readers.load_history(spark, table="no_such_table").count()


def test_tables(spark, tmp_path):
    df = spark.range(5).select(F.col("id").alias("user_id"), F.lit("2024-01-01 08:00:00").alias("start_time"))
    sinks.save_table(df, "sports.sessions", buckets=2)
    sinks.save_table(df.limit(3), "sports.sessions", buckets=2)
    loaded = readers.load_table(spark, "sports.sessions", {"start_time": "timestamp"})
    assert loaded.count() == 3 and dict(loaded.dtypes)["start_time"] == "timestamp"
    path = str(tmp_path / "visits.csv")
    sinks.table_to_csv(spark, "sports.sessions", path)
    assert sinks.csv_to_table(spark, path, df.schema, "sports") == "sports.visits"
    assert spark.table("sports.visits").count() == 3


def test_samples_per_workout(spark, tmp_path):
    df = spark.range(100).select(
        F.lit(1).alias("user_id"), (F.col("id") % 3).cast("string").alias("activity_id"),
        F.timestamp_seconds("id").alias("timestamp"), F.col("id").cast("double").alias("power"),
    )
    per_workout, spread = str(tmp_path / "w"), str(tmp_path / "s")
    sinks.write_samples(df, per_workout, per_workout=True)
    assert {p.name for p in (tmp_path / "w").iterdir() if p.is_dir()} == {f"activity_id={i}" for i in range(3)}
    sinks.write_samples(df, spread, folders=4)
    one = sinks.read_samples(spark, spread, "1", folders=4)
    assert one.count() == 33
    assert "PartitionFilters: [isnotnull(folder" in one._jdf.queryExecution().toString()
    assert sinks.read_samples(spark, per_workout, "1").count() == 33


def test_messages(spark):
    rows = [
        (1, "7", 0, "SESSION", {"sport": "running", "178": "500", "timestamp": "2024-01-01 09:00:00", "odd": "1"}),
        (1, "7", 1, "RECORD", {"heart_rate": "120"}),
        (1, "7", 2, "LENGTH", {"avg_speed": "1.5"}),
        (1, "7", 3, "EVENT", {"sport": "running"}),
    ]
    df = spark.createDataFrame(rows, "user_id long, activity_id string, seq long, mesg string, fields map<string,string>")
    s = messages.all_sessions(df).first()
    assert (s["sport"], s["178"], s["avg_power"], str(s["timestamp"])) == ("running", 500.0, None, "2024-01-01 09:00:00")
    full = messages.full_samples(df).orderBy("seq").collect()
    assert [(r["heart_rate"], r["avg_speed"], r["weight"]) for r in full] == [(120.0, None, None), (None, 1.5, None)]
    name = spark.sql("SELECT '/a/b.c/8123.fit' AS p").select(messages.activity_from_file(F.col("p"))).first()[0]
    assert name == "8123"


def test_json_rows_keep_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert json.loads(sinks.json_rows(df).first()[0]) == {"a": 1, "b": None}


def test_workouts_keep_file_order_beside_nested_fields(spark, exports):
    df = readers.read_workouts(spark, exports["workouts"], schema=None)
    assert cleaning.FILE_ORDER in df.columns
    kept = first_per_key(df, ["user_id", "beginTimestamp"], [cleaning.FILE_ORDER]).collect()
    assert [(r["sportType"], r["summary.laps.n"]) for r in kept] == [("RUNNING", 3)]


def test_unknown_daily_columns_stay(spark, exports, tmp_path):
    (tmp_path / "daily" / "c.json").write_text(json.dumps([{**DAY, "calendarDate": "2024-01-04", "restingHeartRate": 48}]))
    rows = readers.merge_exports(spark, **exports)
    assert "restingHeartRate" in rows.columns and "totalSteps" not in rows.columns


def test_csv_is_read_by_name(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType().add("user_id", "long").add("distance", "double")
    path = tmp_path / "rows.csv"
    path.write_text("distance,more,user_id\nNaN,x,1\n2.5,y,2\n")
    rows = readers.read_csv(spark, str(path), schema).orderBy("user_id").collect()
    assert [tuple(r) for r in rows] == [(1, None, "x"), (2, 2.5, "y")]
    path.write_text("distance\n1.0\n")
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(path), schema)
    (tmp_path / "empty.csv").write_text("")
    assert readers.read_csv(spark, str(tmp_path / "empty.csv"), schema).count() == 0


def test_a_wrong_table_is_not_replaced_by_other_data(spark, exports):
    from pyspark.errors import AnalysisException

    sinks.save_table(spark.range(1), "sports.unrelated")
    with pytest.raises(AnalysisException):
        readers.load_history(spark, table="sports.unrelated", raw=exports)


def test_malformed_cells_are_rescued(spark):
    given = spark.createDataFrame(
        [(1, "a", 1, "RECORD", {"heart_rate": "12x", "distance": "3.5"}), (1, "a", 2, "RECORD", {"heart_rate": None}), (1, "a", 3, "SET", {})],
        "user_id long, activity_id string, seq long, mesg string, fields map<string,string>",
    )
    rows = {r["seq"]: r for r in messages.project_messages(given, "RECORD", rescue=True).collect()}
    assert rows[1]["heart_rate"] is None and rows[1]["distance"] == 3.5 and rows[1][messages.RESCUED] == {"heart_rate": "12x"}
    assert rows[2][messages.RESCUED] is None
    assert [tuple(r) for r in messages.malformed_counts(given).collect()] == [("RECORD", "heart_rate", 1, "12x")]

"""Readers and writers over files that Spark derives from the supplied tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from checks.registry import query
from pacelake.operators import cleaning
from pacelake.schemas import SLEEP_FILE, WORKOUT_FILE
from pacelake.session import scratch_dir
from pacelake.sources import ledger, messages, readers, sinks


def _folder(v) -> str:
    return f"{scratch_dir(v.spark)}/files-{uuid.uuid4().hex}"


def _sleep_export(v):
    """Nights in the shape of the vendor's sleep files."""
    score = F.when(F.col("row_id") % 3 != 0, F.struct((F.col("row_id") % 100).cast("string").alias("qualityScore")))
    return v.sleep.select(
        "user_id", F.col("calendar_date").cast("string").alias("calendarDate"),
        F.col("start_sleep").cast("string").alias("sleepStartTimestampGMT"),
        F.col("end_sleep").cast("string").alias("sleepEndTimestampGMT"),
        F.col("deep_s").alias("deepSleepSeconds"), F.col("light_s").alias("lightSleepSeconds"),
        F.col("rem_s").alias("remSleepSeconds"), F.col("awake_s").alias("awakeSleepSeconds"),
        score.alias("sleepScores"),
    )


def _workout_export(v):
    """Workouts in the vendor's wrapper objects; every fifth file row lacks the list."""
    w = F.struct(
        "user_id", F.unix_millis(F.col("begin_ts").cast("timestamp")).alias("beginTimestamp"),
        F.col("sport_type").alias("sportType"), "distance", F.col("avg_speed").alias("avgSpeed"),
    )
    return v.workouts.select(F.when(F.col("row_id") % 5 != 0, F.array(w)).alias("summarizedActivitiesExport"))


@query("s1_sleep_files_cleaned", """
    SELECT user_id, calendar_date AS date, start_sleep, end_sleep, deep_s AS "deepSleepSeconds",
      light_s AS "lightSleepSeconds", rem_s AS "remSleepSeconds", awake_s AS "awakeSleepSeconds",
      CASE WHEN row_id % 3 <> 0 THEN CAST(row_id % 100 AS VARCHAR) END AS "qualityScore" FROM sleep_v""")
def _(v):
    path = _folder(v)
    _sleep_export(v).write.json(path)
    return cleaning.clean_sleep(readers.read_json_folder(v.spark, path, SLEEP_FILE, multi_line=False))


@query("s2_workout_files_cleaned", """
    SELECT user_id, date_trunc('milliseconds', begin_ts) AS begin, calendar_date AS date, sport_type AS sport,
      distance, avg_speed FROM workouts_v WHERE row_id % 5 <> 0""")
def _(v):
    path = _folder(v)
    _workout_export(v).write.json(path)
    out = cleaning.clean_workouts(readers.read_workouts(v.spark, path, WORKOUT_FILE, multi_line=False))
    return out.select(
        "user_id", F.col("beginTimestamp").alias("begin"), "date", F.col("sportType").alias("sport"), "distance",
        F.col("avgSpeed").alias("avg_speed"),
    )


@query("w2b_workouts_deduplicated", """
    SELECT user_id, date_trunc('milliseconds', begin_ts) AS begin, min(calendar_date) AS date
    FROM workouts_v WHERE row_id % 5 <> 0 GROUP BY 1, 2""")
def _(v):
    """Exports that overlap: every file is there twice."""
    path = _folder(v)
    _workout_export(v).write.json(path)
    _workout_export(v).write.mode("append").json(path)
    raw = readers.read_workouts(v.spark, path, WORKOUT_FILE, multi_line=False)
    out = cleaning.clean_workouts(raw, dedup=True)
    return out.select("user_id", F.col("beginTimestamp").alias("begin"), "date")


@query("s3_s8_csv_round_trip", "SELECT activity_id, start_time, sport, total_distance FROM sessions_v")
def _(v):
    df = v.sessions.select("activity_id", "start_time", "sport", "total_distance")
    path = _folder(v)
    sinks.write_csv(df, path)
    return readers.read_csv(v.spark, path, df.schema)


@query("s12_malformed_cells", """
    WITH p AS (SELECT seq, mesg, CASE WHEN seq % 10 = 0 THEN 'n/a' WHEN seq % 10 = 1 THEN NULL
        ELSE json_extract_string(fields, '$.heart_rate') END AS heart_rate,
      CASE WHEN seq % 15 = 0 THEN concat('w', seq % 90) ELSE json_extract_string(fields, '$.weight') END AS weight FROM values_v)
    SELECT mesg, 'heart_rate' AS key, count(*) AS n, min(heart_rate) AS example FROM p
    WHERE mesg = 'RECORD' AND heart_rate IS NOT NULL AND try_cast(heart_rate AS DOUBLE) IS NULL GROUP BY mesg
    UNION ALL SELECT mesg, 'weight', count(*), min(weight) FROM p
    WHERE mesg = 'SET' AND try_cast(weight AS DOUBLE) IS NULL GROUP BY mesg""")
def _(v):
    decoded = v.values.withColumn("fields", F.from_json("fields", "map<string,string>"))
    nth, old = F.col("seq") % 10, F.col("fields")
    rate = F.when(nth == 0, "n/a").when(nth != 1, old["heart_rate"])
    weight = F.when(F.col("seq") % 15 == 0, F.concat(F.lit("w"), (F.col("seq") % 90).cast("string"))).otherwise(old["weight"])
    spoilt = F.map_concat(
        F.map_filter(old, lambda k, _: ~k.isin("heart_rate", "weight")),
        F.create_map(F.lit("heart_rate"), rate, F.lit("weight"), weight),
    )
    return messages.malformed_counts(decoded.withColumn("fields", spoilt))


@query("s15_sessions_appended", """
    SELECT user_id, activity_id, seq, CAST(json_extract_string(fields, '$.max_heart_rate') AS DOUBLE) AS max_heart_rate
    FROM values_v WHERE mesg = 'SESSION'""")
def _(v):
    """Files arrive in two lots, and every run sees all files there are."""
    decoded = v.values.select("user_id", "activity_id", "seq", "mesg", F.from_json("fields", "map<string,string>").alias("fields"))
    path = _folder(v)
    places = {name: f"{path}/{name}" for name in ("source", "target", "ledger")}
    for lot in range(2):
        decoded.filter(F.pmod("user_id", F.lit(2)) == lot).write.mode("append").parquet(places["source"])
        ledger.append_sessions(v.spark, **places)
    out = ledger.read_sessions(v.spark, places["target"])
    return out.select("user_id", "activity_id", "seq", "max_heart_rate")


@query("s9_samples_per_workout", """
    SELECT activity_id, count(*) AS n, round(sum(CAST(json_extract_string(fields, '$.heart_rate') AS DOUBLE)), 2) AS heart_rate
    FROM messages_v WHERE mesg = 'RECORD' GROUP BY activity_id""")
def _(v):
    decoded = v.messages.withColumn("fields", F.from_json("fields", "map<string,string>"))
    path = _folder(v)
    sinks.write_samples(messages.samples(decoded), path, folders=16)
    out = sinks.read_samples(v.spark, path, folders=16).groupBy("activity_id")
    return out.agg(F.count("*").alias("n"), F.round(F.sum("heart_rate"), 2).alias("heart_rate"))


@query("s9_full_records", """
    SELECT activity_id, seq, CASE WHEN mesg = 'RECORD' THEN CAST(json_extract_string(fields, '$.heart_rate') AS DOUBLE) END AS heart_rate,
      CASE WHEN mesg = 'SET' THEN CAST(json_extract_string(fields, '$.weight') AS DOUBLE) END AS weight,
      CASE WHEN mesg = 'LENGTH' THEN CAST(json_extract_string(fields, '$.avg_speed') AS DOUBLE) END AS avg_speed
    FROM values_v WHERE mesg <> 'SESSION'""")
def _(v):
    decoded = v.values.withColumn("fields", F.from_json("fields", "map<string,string>"))
    path = _folder(v)
    sinks.write_samples(messages.full_samples(decoded), path, folders=16)
    return sinks.read_samples(v.spark, path, folders=16).select("activity_id", "seq", "heart_rate", "weight", "avg_speed")


@query("s10_json_rows", """
    SELECT row_id, CAST(row_id AS VARCHAR) AS id_in_json, sport_type AS sport_in_json FROM workouts_v""")
def _(v):
    text = sinks.json_rows(v.workouts.select("row_id", "sport_type"))
    return text.select(
        F.get_json_object("value", "$.row_id").cast("long").alias("row_id"),
        F.get_json_object("value", "$.row_id").alias("id_in_json"),
        F.get_json_object("value", "$.sport_type").alias("sport_in_json"),
    )


@query("s10_json_files", "SELECT row_id, distance, avg_speed FROM workouts_v")
def _(v):
    df = v.workouts.select("row_id", "distance", "avg_speed")
    path = _folder(v)
    sinks.write_json(df, path)
    return readers.read_json_folder(v.spark, path, df.schema, multi_line=False).drop(cleaning.FILE_ORDER)


@query("s14_activity_from_file", "SELECT row_id, CAST(row_id AS VARCHAR) AS activity_id FROM workouts_v")
def _(v):
    path = F.concat(F.lit("/exports/"), F.col("row_id").cast("string"), F.lit(".fit"))
    return v.workouts.select("row_id", messages.activity_from_file(path).alias("activity_id"))


@query("clean_daily_from_nested", """
    WITH d AS (SELECT user_id, calendar_date, min(row_id) AS row_id, arg_min(steps, row_id) AS steps FROM daily_v GROUP BY 1, 2)
    SELECT user_id, calendar_date AS "calendarDate", row_id, steps AS "hydration_sweatLossInML", steps + 1 AS "bodyBattery_Highest",
      CASE WHEN row_id % 2 = 0 THEN steps + 2 END AS "bodyBattery_Lowest", CAST(NULL AS DOUBLE) AS "allDayStress_awake" FROM d""")
def _(v):
    def stat(value):
        return F.struct(value.alias("statsValue"))

    high, low = stat(F.col("steps") + 1), stat(F.col("steps") + 2)
    stats = F.when(F.col("row_id") % 2 == 0, F.array(high, low)).otherwise(F.array(high))
    stress = F.array().cast(T.ArrayType(T.StructType([T.StructField("averageStressLevel", T.DoubleType())])))
    breath = F.lit(None).cast(
        "struct<avgWakingRespirationValue:double,highestRespirationValue:double,lowestRespirationValue:double>")
    raw = v.daily.select(
        "user_id", F.col("calendar_date").cast("string").alias("calendarDate"), "row_id",
        F.struct(F.col("steps").alias("sweatLossInML")).alias("hydration"), breath.alias("respiration"),
        F.struct(stats.alias("bodyBatteryStatList")).alias("bodyBattery"),
        F.struct(stress.alias("aggregatorList")).alias("allDayStress"), F.col("steps").alias("totalSteps"),
    )
    return cleaning.clean_daily(raw, "row_id").select(
        "user_id", "calendarDate", "row_id", "hydration_sweatLossInML", "bodyBattery_Highest", "bodyBattery_Lowest",
        "allDayStress_awake",
    )


@query("s4_s5_table_round_trip", """
    SELECT user_id, activity_id, start_time AS start_time, sport FROM sessions_v""")
def _(v):
    table = f"sessions_{uuid.uuid4().hex}"
    text = v.sessions.select("user_id", "activity_id", F.col("start_time").cast("string").alias("start_time"), "sport")
    sinks.save_table(text, table, buckets=8, path=_folder(v))
    return readers.load_table(v.spark, table, {"start_time": "timestamp_ntz"})


@query("s6_s7_table_and_csv", "SELECT row_id, distance, avg_speed FROM workouts_v")
def _(v):
    df = v.workouts.select("row_id", "distance", "avg_speed")
    table, stem = f"workouts_{uuid.uuid4().hex}", f"visits_{uuid.uuid4().hex}"
    sinks.save_table(df, table, path=_folder(v))
    path = f"{_folder(v)}/{stem}.csv"
    sinks.table_to_csv(v.spark, table, path)
    return v.spark.table(sinks.csv_to_table(v.spark, path, df.schema, table_path=_folder(v)))


@query("s11_history_from_exports", """
    SELECT s.user_id, s.calendar_date AS "calendarDate", s.start_sleep, date_trunc('milliseconds', w.begin_ts) AS "beginTimestamp",
      w.distance FROM sleep_v s JOIN workouts_v w ON s.user_id = w.user_id AND s.calendar_date = w.calendar_date
    WHERE w.row_id % 5 <> 0""")
def _(v):
    """No table and no CSV, so the raw exports are merged; nights without workout drop out."""
    sleep, workouts, daily = _folder(v), _folder(v), _folder(v)
    _sleep_export(v).write.json(sleep)
    _workout_export(v).write.json(workouts)
    v.daily.select("user_id", F.col("calendar_date").cast("string").alias("calendarDate")).write.json(daily)
    raw = {"sleep": sleep, "workouts": workouts, "daily": daily, "multi_line": False}
    out = readers.load_history(v.spark, table=f"none_{uuid.uuid4().hex}", csv=f"{sleep}/none.csv", raw=raw)
    return out.select("user_id", "calendarDate", "start_sleep", "beginTimestamp", "distance")


@query("s3_csv_by_name", """
    SELECT activity_id, start_time, sport, total_distance, activity_id % 7 AS lap FROM sessions_v""")
def _(v):
    """A header in another order than the schema, and a column the schema does not know."""
    df = v.sessions.select("activity_id", "start_time", "sport", "total_distance")
    path = _folder(v)
    lap = (F.col("activity_id") % 7).alias("lap")
    sinks.write_csv(v.sessions.select("total_distance", lap, "sport", "activity_id", "start_time"), path)
    return readers.read_csv(v.spark, path, df.schema).withColumn("lap", F.col("lap").cast("long"))


@query("s4_nan_to_null", """
    SELECT row_id, CASE WHEN row_id % 3 <> 0 THEN distance END AS distance, avg_speed FROM workouts_v""")
def _(v):
    """NaN in a stored table reads as NULL."""
    table = f"gaps_{uuid.uuid4().hex}"
    distance = F.when(F.col("row_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("distance")).alias("distance")
    sinks.save_table(v.workouts.select("row_id", distance, "avg_speed"), table, path=_folder(v))
    return readers.load_table(v.spark, table)


@query("j3_open_daily_columns", """
    WITH d AS (SELECT user_id, calendar_date, min(row_id) AS row_id FROM daily_v GROUP BY 1, 2)
    SELECT s.user_id, s.calendar_date AS "calendarDate", s.start_sleep, date_trunc('milliseconds', w.begin_ts) AS "beginTimestamp",
      w.distance, d.row_id % 40 AS "restingHeartRate", d.row_id AS distance_daily
    FROM sleep_v s JOIN workouts_v w ON s.user_id = w.user_id AND s.calendar_date = w.calendar_date
    LEFT JOIN d ON s.user_id = d.user_id AND s.calendar_date = d.calendar_date WHERE w.row_id % 5 <> 0""")
def _(v):
    """Daily fields outside the known ones come through, also one named like a workout's."""
    sleep, workouts, daily = _folder(v), _folder(v), _folder(v)
    _sleep_export(v).write.json(sleep)
    _workout_export(v).write.json(workouts)
    days = v.daily.groupBy("user_id", "calendar_date").agg(F.min("row_id").alias("distance"))
    days.select(
        "user_id", F.col("calendar_date").cast("string").alias("calendarDate"), "distance",
        (F.col("distance") % 40).alias("restingHeartRate"),
    ).write.json(daily)
    raw = {"sleep": sleep, "workouts": workouts, "daily": daily, "multi_line": False}
    out = readers.load_history(v.spark, raw=raw)
    return out.select(
        "user_id", "calendarDate", "start_sleep", "beginTimestamp", "distance", "restingHeartRate", "distance_daily")

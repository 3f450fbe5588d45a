"""De-duplication, joins, positions, windows of past rows, unions, message projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from pacelake.operators import cleaning, merge, ordering, reports, windows
from pacelake.sources import messages

SUMMARY = """count(pos) AS n, min(pos) AS lo, max(pos) AS hi, round(coalesce(sum(load), 0), 4) AS load"""


def _summary(df, *ids):
    """Per window: rows, first and last position, sum of load."""
    w = F.col("window")
    pos = F.transform(w, lambda r: r["pos"])
    load = F.aggregate(w, F.lit(0.0), lambda a, r: a + r["load"])
    return df.select(
        *ids, F.size(w).cast("long").alias("n"), F.array_min(pos).alias("lo"), F.array_max(pos).alias("hi"),
        F.round(load, 4).alias("load"),
    )


# -- de-duplication and order -------------------------------------------------

@query("w1_one_row_per_day", """
    SELECT user_id, calendar_date, row_id, steps FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, calendar_date ORDER BY row_id) AS rn FROM daily_v
      WHERE calendar_date >= DATE '2024-01-05') WHERE rn = 1""")
def _(v):
    out = cleaning.one_row_per_day(v.daily, "calendar_date", "row_id", "2024-01-05")
    return out.select("user_id", "calendar_date", "row_id", "steps")


@query("w2_one_sleep_per_span", """
    SELECT user_id, calendar_date, start_sleep, end_sleep, min(row_id) AS row_id FROM (
      SELECT * FROM sleep_v UNION ALL SELECT * REPLACE (row_id + 1000000 AS row_id) FROM sleep_v) GROUP BY 1, 2, 3, 4""")
def _(v):
    twice = v.sleep.unionByName(v.sleep.withColumn("row_id", F.col("row_id") + 1_000_000))
    out = cleaning.one_sleep_per_span(twice, "calendar_date", "start_sleep", "end_sleep", "row_id")
    return out.select("user_id", "calendar_date", "start_sleep", "end_sleep", "row_id")


@query("w2b_one_workout_per_begin", """
    SELECT user_id, begin_ts, min(row_id) AS row_id FROM workouts_v GROUP BY 1, 2""")
def _(v):
    return ordering.first_per_key(v.workouts, ["user_id", "begin_ts"], ["row_id"]).select("user_id", "begin_ts", "row_id")


@query("w3_last_sessions", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_time DESC, activity_id DESC) AS age
      FROM sessions_v WHERE sport = 'running'),
    k AS (SELECT * FROM r WHERE age <= 20)
    SELECT user_id, activity_id, row_number() OVER (PARTITION BY user_id ORDER BY age DESC) AS rank,
      total_distance / 1000 AS km, avg_heart_rate FROM k""")
def _(v):
    return reports.last_sessions(v.sessions, "running", 20)


@query("w4_newest_of_sport", """
    SELECT user_id, activity_id, age FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_time DESC, activity_id DESC) AS age
      FROM sessions_v WHERE sport = 'cycling') WHERE age <= 5""")
def _(v):
    rides = v.sessions.filter("sport = 'cycling'")
    out = ordering.newest_per_key(rides, ["user_id"], "start_time", "activity_id", 5)
    return out.select("user_id", "activity_id", "age")


@query("w5_sorted_by_time", "SELECT activity_id, start_time FROM sessions_v ORDER BY start_time, activity_id")
def _(v):
    return v.sessions.select("activity_id", "start_time").orderBy("start_time", "activity_id")


@query("w6_row_positions", """
    SELECT row_id, row_number() OVER (PARTITION BY user_id ORDER BY begin_ts, row_id) - 1 AS pos FROM history_v""")
def _(v):
    return ordering.number_rows(v.history, ["user_id"], ["begin_ts", "row_id"]).select("row_id", "pos")


@query("w6_row_positions_split_groups", """
    SELECT row_id, row_number() OVER (PARTITION BY user_id ORDER BY begin_ts, row_id) - 1 AS pos FROM history_v""")
def _(v):
    """The same positions on the path that athletes too large for one task take."""
    out = ordering.number_rows(v.history, ["user_id"], ["begin_ts", "row_id"], max_group_rows=0)
    return out.select("row_id", "pos")


@query("w7_newest_times", """
    SELECT user_id, max(begin_ts) AS newest,
      max(begin_ts) FILTER (WHERE begin_ts < TIMESTAMP '2024-01-20 00:00:00') AS newest_before
    FROM history_v GROUP BY user_id""")
def _(v):
    newest = ordering.newest_time(v.history, ["user_id"], "begin_ts")
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    before = ordering.newest_time(v.history, ["user_id"], "begin_ts", cut)
    return newest.join(before.withColumnRenamed("newest", "newest_before"), "user_id")


@query("w8_drop_first_row", """
    SELECT row_id FROM (
      SELECT row_id, row_number() OVER (PARTITION BY user_id ORDER BY begin_ts, row_id) AS rn FROM history_v)
    WHERE rn > 1""")
def _(v):
    return ordering.drop_first_row(v.history, ["user_id"], ["begin_ts", "row_id"]).select("row_id")


# -- joins ---------------------------------------------------------------------

@query("j1_sleep_with_workouts", """
    SELECT s.user_id, s.calendar_date, s.row_id AS sleep_id, w.row_id AS workout_id, w.distance
    FROM sleep_v s LEFT JOIN workouts_v w ON s.user_id = w.user_id AND s.calendar_date = w.calendar_date""")
def _(v):
    return merge.sleep_with_workouts(
        v.sleep.select("user_id", "calendar_date", F.col("row_id").alias("sleep_id")),
        v.workouts.select("user_id", "calendar_date", F.col("row_id").alias("workout_id"), "distance"),
        "calendar_date",
    )


@query("j2_with_daily", """
    WITH d AS (SELECT user_id, calendar_date, min(row_id) AS daily_id, arg_min(steps, row_id) AS steps
      FROM daily_v GROUP BY 1, 2)
    SELECT w.row_id, d.daily_id, d.steps FROM workouts_v w
    LEFT JOIN d ON w.user_id = d.user_id AND w.calendar_date = d.calendar_date""")
def _(v):
    daily = cleaning.one_row_per_day(v.daily, "calendar_date", "row_id")
    daily = daily.select("user_id", "calendar_date", F.col("row_id").alias("daily_id"), "steps")
    return merge.with_daily(v.workouts, daily, "calendar_date").select("row_id", "daily_id", "steps")


@query("j3_merge_history", """
    WITH d AS (SELECT user_id, calendar_date, min(row_id) AS daily_id, arg_min(steps, row_id) AS steps
      FROM daily_v GROUP BY 1, 2)
    SELECT s.user_id, s.calendar_date, s.row_id AS sleep_id, w.row_id AS workout_id, w.begin_ts, d.daily_id, d.steps
    FROM sleep_v s
    LEFT JOIN workouts_v w ON s.user_id = w.user_id AND s.calendar_date = w.calendar_date
    LEFT JOIN d ON s.user_id = d.user_id AND s.calendar_date = d.calendar_date""")
def _(v):
    sleep = cleaning.one_sleep_per_span(v.sleep, "calendar_date", "start_sleep", "end_sleep", "row_id")
    sleep = sleep.select("user_id", F.col("calendar_date").alias("date"), F.col("row_id").alias("sleep_id"))
    workouts = v.workouts.select(
        "user_id", F.col("calendar_date").alias("date"), F.col("row_id").alias("workout_id"), "begin_ts"
    )
    daily = cleaning.one_row_per_day(v.daily, "calendar_date", "row_id")
    return merge.merge_history(
        sleep, workouts,
        daily.select("user_id", F.col("calendar_date").alias("calendarDate"), F.col("row_id").alias("daily_id"), "steps"),
    ).withColumnRenamed("calendarDate", "calendar_date")


@query("j4_sleep_and_workouts", """
    SELECT s.row_id AS sleep_id, w.row_id AS workout_id FROM sleep_v s
    JOIN workouts_v w ON s.user_id = w.user_id AND s.calendar_date = w.calendar_date""")
def _(v):
    out = merge.sleep_with_workouts(
        v.sleep.select("user_id", "calendar_date", F.col("row_id").alias("sleep_id")),
        v.workouts.select("user_id", "calendar_date", F.col("row_id").alias("workout_id")),
        "calendar_date", "inner",
    )
    return out.select("sleep_id", "workout_id")


POSITIONAL = """
    WITH h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY begin_ts, row_id) - 1 AS pos FROM history_v),
    s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_time, activity_id) - 1 AS i FROM sessions_v)
    SELECT s.activity_id, {summary}
    FROM s LEFT JOIN h ON h.user_id = s.user_id AND h.pos BETWEEN s.i - {n} AND s.i - 1
      AND h.begin_ts < date_trunc('second', s.start_time)
    WHERE s.i >= {n} GROUP BY s.activity_id"""


@query("j5_training_windows_20", POSITIONAL.format(n=20, summary=SUMMARY))
def _(v):
    return _summary(windows.training_windows(v.history, v.sessions, ["load"], n=20), "activity_id")


@query("j5_training_windows_60", POSITIONAL.format(n=60, summary=SUMMARY))
def _(v):
    return _summary(windows.training_windows(v.history, v.sessions, ["load"], n=60), "activity_id")


@query("j5_training_windows_split_groups", POSITIONAL.format(n=20, summary=SUMMARY))
def _(v):
    out = windows.training_windows(v.history, v.sessions, ["load"], n=20, max_group_rows=0)
    return _summary(out, "activity_id")


@query("j5_training_windows_asof", f"""
    WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_time, activity_id) - 1 AS i
      FROM sessions_v),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY begin_ts, row_id) - 1 AS pos FROM history_v),
    j AS (SELECT s.activity_id, h.pos, h.load,
        row_number() OVER (PARTITION BY s.activity_id ORDER BY h.pos DESC) AS rn
      FROM s LEFT JOIN p h ON h.user_id = s.user_id AND h.begin_ts < date_trunc('second', s.start_time)
      WHERE s.i >= 20)
    SELECT activity_id, {SUMMARY} FROM j WHERE rn <= 20 GROUP BY activity_id""")
def _(v):
    out = windows.training_windows(v.history, v.sessions, ["load"], n=20, mode="asof")
    return _summary(out, "activity_id")


@query("j6_window_for_date", """
    SELECT user_id, row_id, age FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY begin_ts DESC, row_id DESC) AS age
      FROM history_v WHERE begin_ts < TIMESTAMP '2024-01-25 12:00:00') WHERE age BETWEEN 2 AND 61""")
def _(v):
    date = F.lit("2024-01-25 12:00:00").cast("timestamp_ntz")
    return windows.window_for_date(v.history, date).select("user_id", "row_id", "age")


LAST_DAYS = f"""
    WITH h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY begin_ts, row_id) - 1 AS pos FROM history_v),
    a AS (SELECT user_id, d AS days_back, date_trunc('second', max(begin_ts) - to_days(d)) AS anchor
      FROM history_v, (SELECT CAST(unnest(generate_series(0, 4)) AS INT) AS d) GROUP BY user_id, d),
    j AS (SELECT a.user_id, a.days_back, h.pos, h.load,
        row_number() OVER (PARTITION BY a.user_id, a.days_back ORDER BY h.pos DESC) AS rn
      FROM a LEFT JOIN h ON h.user_id = a.user_id AND h.begin_ts < a.anchor)
    SELECT user_id, days_back, count(pos) AS n, min(pos) AS lo, max(pos) AS hi, round(coalesce(sum(load), 0), 4) AS load
    FROM j WHERE rn BETWEEN 2 AND 21 GROUP BY user_id, days_back"""


@query("j7_windows_for_last_days", LAST_DAYS)
def _(v):
    out = windows.windows_for_last_days(v.history, ["load"], 5, n=20)
    return _summary(out, "user_id", "days_back")


@query("j7_windows_for_last_days_split_groups", LAST_DAYS)
def _(v):
    out = windows.windows_for_last_days(v.history, ["load"], 5, n=20, max_group_rows=0)
    return _summary(out, "user_id", "days_back")


@query("j8_rows_per_model", """
    SELECT activity_id, m.model_name FROM sessions_v, (SELECT DISTINCT sport AS model_name FROM sessions_v) m""")
def _(v):
    models = v.sessions.select(F.col("sport").alias("model_name")).distinct()
    return merge.rows_per_model(v.sessions.select("activity_id"), models)


# -- messages and unions --------------------------------------------------------

def _messages(v):
    return v.messages.withColumn("fields", F.from_json("fields", "map<string,string>"))


def _kind(kind):
    return f"""
    SELECT seq, CAST(json_extract_string(fields, '$.heart_rate') AS DOUBLE) AS heart_rate,
      CAST(json_extract_string(fields, '$.power') AS DOUBLE) AS power,
      CAST(NULL AS DOUBLE) AS distance
    FROM messages_v WHERE mesg = '{kind}'"""


@query("s12_record_messages", _kind("RECORD"))
def _(v):
    out = messages.project_messages(_messages(v), "RECORD")
    return out.select("seq", "heart_rate", "power", "distance")


@query("s12_session_messages", """
    SELECT seq, activity_id, CAST(NULL AS DOUBLE) AS max_heart_rate, CAST(NULL AS VARCHAR) AS sport
    FROM messages_v WHERE mesg = 'SESSION'""")
def _(v):
    out = messages.project_messages(_messages(v), "SESSION")
    return out.select("seq", "activity_id", "max_heart_rate", "sport")


@query("s12_set_messages", "SELECT seq, CAST(NULL AS DOUBLE) AS weight FROM messages_v WHERE mesg = 'SET'")
def _(v):
    return messages.project_messages(_messages(v), "SET").select("seq", "weight")


@query("s12_length_messages", "SELECT seq, CAST(NULL AS DOUBLE) AS avg_speed FROM messages_v WHERE mesg = 'LENGTH'")
def _(v):
    return messages.project_messages(_messages(v), "LENGTH").select("seq", "avg_speed")


@query("s13_wide_record_messages", _kind("RECORD").replace("AS distance", "AS stance_time"))
def _(v):
    out = messages.project_messages(_messages(v), "RECORD", wide=True)
    return out.select("seq", "heart_rate", "power", "stance_time")


@query("s13_wide_session_messages", """
    SELECT seq, activity_id, CAST(NULL AS DOUBLE) AS avg_vam, CAST(NULL AS VARCHAR) AS sport
    FROM messages_v WHERE mesg = 'SESSION'""")
def _(v):
    out = messages.all_sessions(_messages(v), wide=True)
    return out.select("seq", "activity_id", "avg_vam", "sport")


VALUES = {
    "s12_session_values": ("SESSION", False, {"max_heart_rate": "DOUBLE", "sport": "VARCHAR"}),
    "s12_set_values": ("SET", False, {"weight": "DOUBLE"}),
    "s12_length_values": ("LENGTH", False, {"avg_speed": "DOUBLE"}),
    "s13_wide_record_values": ("RECORD", True, {"heart_rate": "DOUBLE", "distance": "DOUBLE", "stance_time": "DOUBLE"}),
    "s13_wide_session_values": ("SESSION", True, {"max_heart_rate": "DOUBLE", "sport": "VARCHAR", "avg_vam": "DOUBLE"}),
}


def _values(v):
    return v.values.withColumn("fields", F.from_json("fields", "map<string,string>"))


def _register(name, kind, wide, keys):
    cells = ", ".join(f"CAST(json_extract_string(fields, '$.{k}') AS {t}) AS {k}" for k, t in keys.items())

    @query(name, f"SELECT seq, activity_id, {cells} FROM values_v WHERE mesg = '{kind}'")
    def _(v):
        return messages.project_messages(_values(v), kind, wide).select("seq", "activity_id", *keys)


for _name, _what in VALUES.items():
    _register(_name, *_what)


@query("s15_all_sessions", "SELECT activity_id, count(*) AS sessions FROM messages_v WHERE mesg = 'SESSION' GROUP BY 1")
def _(v):
    return messages.all_sessions(_messages(v)).groupBy("activity_id").agg(F.count("*").alias("sessions"))


@query("u1_full_samples", """
    SELECT seq, CASE WHEN mesg = 'RECORD' THEN CAST(json_extract_string(fields, '$.heart_rate') AS DOUBLE) END
        AS heart_rate, CAST(NULL AS DOUBLE) AS weight
    FROM messages_v WHERE mesg IN ('RECORD', 'LENGTH', 'SET')""")
def _(v):
    return messages.full_samples(_messages(v)).select("seq", "heart_rate", "weight")


@query("u2_tagged_union", """
    SELECT 'prediction' AS source, user_id, round(avg(total_calories), 4) AS total_calories, NULL AS start_time
    FROM sessions_v GROUP BY user_id
    UNION ALL
    SELECT 'real', user_id, round(total_calories, 4), strftime(start_time, '%Y-%m-%d %H:%M:%S')
    FROM sessions_v WHERE CAST(start_time AS DATE) = DATE '2024-01-20'""")
def _(v):
    predicted = v.sessions.groupBy("user_id").agg(F.round(F.avg("total_calories"), 4).alias("total_calories"))
    predicted = predicted.withColumn("start_time", F.lit(None).cast("string"))
    real = v.sessions.filter(F.to_date("start_time") == F.lit("2024-01-20").cast("date"))
    real = real.withColumns({
        "start_time": F.date_format("start_time", "yyyy-MM-dd HH:mm:ss"),
        "total_calories": F.round("total_calories", 4),
    })
    return merge.tag_union(prediction=predicted, real=real)

"""Scalars, reports and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from pacelake.functions import cyclic, scalars as S
from pacelake.operators import profile, reports
from pacelake.plans.display import summarise_session, summarise_predictions
from pacelake.schemas import BENEFIT_LABELS, CROSS_TABLE_SPORTS

LABELS = " ".join(f"WHEN {k} THEN '{v}'" for k, v in BENEFIT_LABELS.items())
SECONDS = (
    "((CAST(floor((epoch_us(end_time) - epoch_us(start_time)) / 1000000) AS BIGINT) % 86400 + 86400) % 86400)"
)

AVG = "(round_even(enhanced_avg_speed * CAST(3.6 AS DOUBLE) * 100.0, 0) / 100.0)"
MAX = "(round_even(enhanced_max_speed * CAST(3.6 AS DOUBLE) * 100.0, 0) / 100.0)"
KM = f"(round_even({AVG} * {SECONDS} / 3600.0 * 100.0, 0) / 100.0)"


# -- reports -----------------------------------------------------------------

@query("a1_workouts_per_month", """
    SELECT CAST(date_trunc('month', end_time) AS DATE) AS month, count(*) AS workouts
    FROM sessions_v GROUP BY 1""")
def _(v):
    return reports.workouts_per_month(v.sessions, end="end_time")


@query("a2_workouts_per_sport", """
    SELECT sport, count(*) AS workouts FROM sessions_v WHERE sport IS NOT NULL GROUP BY sport
    ORDER BY workouts DESC, sport""")
def _(v):
    return reports.workouts_per_sport(v.sessions)


@query("a3_distance_by_year_month", """
    SELECT CAST(year(end_time) AS INT) AS year, CAST(month(end_time) AS INT) AS month,
      round(coalesce(sum(total_distance), 0), 2) AS distance
    FROM sessions_v GROUP BY 1, 2""")
def _(v):
    out = reports.distance_by_year_month(v.sessions, end="end_time")
    return out.withColumn("distance", F.round("distance", 2))


@query("a4_distance_by_day", """
    SELECT CAST(day(start_time) AS INT) AS day, round(coalesce(sum(total_distance), 0), 2) AS distance
    FROM sessions_v WHERE start_time >= '2024-01-01' AND start_time < '2024-02-01' GROUP BY 1""")
def _(v):
    return reports.distance_by_day(v.sessions, 2024, 1).withColumn("distance", F.round("distance", 2))


@query("a5_calories_and_km_by_month", """
    SELECT CAST(month(end_time) AS INT) AS month, round(coalesce(sum(total_calories), 0), 2) AS calories,
      round(coalesce(sum(total_distance / 1000), 0), 4) AS km
    FROM sessions_v GROUP BY 1""")
def _(v):
    out = reports.calories_and_km_by_month(v.sessions, end="end_time")
    return out.withColumns({"calories": F.round("calories", 2), "km": F.round("km", 4)})


@query("a5_calories_and_km_by_year_month", """
    SELECT CAST(year(end_time) AS INT) AS year, CAST(month(end_time) AS INT) AS month,
      round(coalesce(sum(total_calories), 0), 2) AS calories,
      round(coalesce(sum(total_distance / 1000), 0), 4) AS km
    FROM sessions_v GROUP BY 1, 2""")
def _(v):
    out = reports.calories_and_km_by_month(v.sessions, end="end_time", by_year=True)
    return out.withColumns({"calories": F.round("calories", 2), "km": F.round("km", 4)})


@query("a6_speed_trend", """
    WITH m AS (
      SELECT sport, CAST(date_trunc('month', end_time) AS DATE) AS month,
        round_even(avg(enhanced_avg_speed * 3.6) * 100.0, 0) / 100.0 AS avg_kmh
      FROM sessions_v WHERE enhanced_avg_speed > 0 AND sport IN ('running', 'cycling', 'swimming')
      GROUP BY 1, 2),
    s AS (
      SELECT sport, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month
      FROM m GROUP BY sport)
    SELECT s.sport, s.month, m.avg_kmh FROM s LEFT JOIN m USING (sport, month)""")
def _(v):
    return reports.speed_trend(v.sessions, end="end_time")


@query("a7_workouts_per_day", """
    SELECT CAST(end_time AS DATE) AS day, count(activity_id) AS workouts FROM sessions_v GROUP BY 1""")
def _(v):
    return reports.workouts_per_day(v.sessions, end="end_time")


@query("a8_day_sport_table", f"""
    SELECT CAST(end_time AS DATE) AS day,
      {', '.join(f"count(*) FILTER (WHERE sport = '{s}') AS {s}" for s in CROSS_TABLE_SPORTS)}
    FROM sessions_v GROUP BY 1""")
def _(v):
    return reports.day_sport_table(v.sessions, end="end_time")


@query("a9_max_heart_rate_by_sport", """
    SELECT sport, round(avg(max_heart_rate), 6) AS mean_max_heart_rate FROM sessions_v GROUP BY sport""")
def _(v):
    out = reports.mean_by_sport(v.sessions)
    return out.withColumn("mean_max_heart_rate", F.round("mean_max_heart_rate", 6))


@query("a16_compare_with_history", """
    WITH r AS (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY end_time DESC, activity_id DESC) AS rn
      FROM sessions_v WHERE sport = 'running'),
    h AS (
      SELECT user_id, avg(total_calories) AS total_calories, avg(avg_heart_rate) AS avg_heart_rate,
        avg(enhanced_avg_speed) AS enhanced_avg_speed
      FROM r WHERE rn <= 30 GROUP BY user_id),
    p AS (
      SELECT user_id, total_calories, avg_heart_rate, enhanced_avg_speed FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY end_time DESC, activity_id DESC) AS rn
        FROM sessions_v) WHERE rn = 1),
    hl AS (SELECT user_id, 'total_calories' AS feature, total_calories AS historical_average FROM h
      UNION ALL SELECT user_id, 'avg_heart_rate', avg_heart_rate FROM h
      UNION ALL SELECT user_id, 'enhanced_avg_speed', enhanced_avg_speed FROM h),
    pl AS (SELECT user_id, 'total_calories' AS feature, total_calories AS predicted FROM p
      UNION ALL SELECT user_id, 'avg_heart_rate', avg_heart_rate FROM p
      UNION ALL SELECT user_id, 'enhanced_avg_speed', enhanced_avg_speed FROM p)
    SELECT pl.user_id, pl.feature, pl.predicted, round(hl.historical_average, 6) AS historical_average
    FROM pl LEFT JOIN hl ON pl.user_id = hl.user_id AND pl.feature = hl.feature""")
def _(v):
    from pacelake.operators.ordering import newest_per_key

    features = ["total_calories", "avg_heart_rate", "enhanced_avg_speed"]
    predicted = newest_per_key(v.sessions, ["user_id"], "end_time", "activity_id", 1)
    out = reports.compare_with_history(predicted, v.sessions, features, "running", 30, time="end_time")
    return out.withColumn("historical_average", F.round("historical_average", 6))


# -- profiles ----------------------------------------------------------------

@query("a10_histogram_20", """
    WITH b AS (SELECT min(total_calories) AS lo, max(total_calories) AS hi FROM sessions_v),
    c AS (SELECT least(CAST(floor((total_calories - lo) / ((hi - lo) / 20)) AS INT) + 1, 20) AS bin,
        count(*) AS n FROM sessions_v, b GROUP BY 1),
    s AS (SELECT CAST(unnest(generate_series(1, 20)) AS INT) AS bin)
    SELECT s.bin, round(lo + (s.bin - 1) * ((hi - lo) / 20), 6) AS low, coalesce(n, 0) AS n
    FROM b, s LEFT JOIN c ON s.bin = c.bin""")
def _(v):
    return profile.histogram(v.sessions, "total_calories", 20).withColumn("low", F.round("low", 6))


@query("a10_histogram_35_with_nulls", """
    WITH b AS (SELECT min(total_distance) AS lo, max(total_distance) AS hi FROM sessions_v),
    c AS (SELECT least(CAST(floor((total_distance - lo) / ((hi - lo) / 35)) AS INT) + 1, 35) AS bin,
        count(*) AS n FROM sessions_v, b WHERE total_distance IS NOT NULL GROUP BY 1),
    s AS (SELECT CAST(unnest(generate_series(1, 35)) AS INT) AS bin)
    SELECT s.bin, round(lo + (s.bin - 1) * ((hi - lo) / 35), 6) AS low, coalesce(n, 0) AS n
    FROM b, s LEFT JOIN c ON s.bin = c.bin""")
def _(v):
    return profile.histogram(v.sessions, "total_distance", 35).withColumn("low", F.round("low", 6))


NUMERIC = [
    "total_distance", "enhanced_avg_speed", "enhanced_max_speed", "avg_heart_rate", "max_heart_rate",
    "total_calories", "avg_cadence", "benefit", "stamina_begin", "avg_power",
]


@query("a11_describe", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
      min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
      round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max FROM sessions_v""" for c in NUMERIC))
def _(v):
    out = profile.describe(v.sessions, NUMERIC)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


@query("a12_null_share", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 8) AS null_share
    FROM sessions_v""" for c in NUMERIC))
def _(v):
    return profile.null_share(v.sessions, NUMERIC).withColumn("null_share", F.round("null_share", 8))


@query("a12_null_percent_of_fixed_rows", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", round(count(*) FILTER (WHERE {c} IS NULL) / 6724.0 * 100, 6) AS null_share
    FROM sessions_v""" for c in NUMERIC))
def _(v):
    out = profile.null_share(v.sessions, NUMERIC, divisor=6724)
    return out.withColumn("null_share", F.round("null_share", 6))


@query("a13_correlation", " UNION ALL ".join(f"""
    SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM sessions_v"""
    for a in NUMERIC for b in NUMERIC))
def _(v):
    return profile.correlation(v.sessions, NUMERIC).withColumn("r", F.round("r", 6))


@query("a14_mean_sleep_hours", """
    SELECT round(avg((deep_s + light_s + rem_s + awake_s) / 3600.0), 6) AS mean_sleep_h FROM sleep_v""")
def _(v):
    out = profile.mean_sleep_hours(v.sleep, ["deep_s", "light_s", "rem_s", "awake_s"])
    return out.withColumn("mean_sleep_h", F.round("mean_sleep_h", 6))


@query("a15_distinct_sports", "SELECT DISTINCT sport FROM sessions_v WHERE sport IS NOT NULL")
def _(v):
    return profile.distinct_sports(v.sessions)


@query("a15_count_sports", "SELECT count(DISTINCT sport) AS sports FROM sessions_v")
def _(v):
    return profile.count_sports(v.sessions)


@query("a17_drop_sparse_columns", """
    SELECT activity_id, total_distance, avg_cadence, benefit FROM sessions_v""")
def _(v):
    wide = v.sessions.select("activity_id", "total_distance", "avg_cadence", "benefit", "avg_power")
    return profile.drop_sparse(wide)


@query("a18_drop_empty_columns", "SELECT activity_id, avg_power FROM sessions_v")
def _(v):
    swims = F.when(F.col("sport") == "rowing", F.col("avg_power"))
    return profile.drop_empty(v.sessions.select("activity_id", "avg_power", swims.alias("rowing_power")))


# -- scalars -----------------------------------------------------------------

@query("p1_drop_columns", """
    SELECT user_id, calendar_date, start_sleep, end_sleep, deep_s, light_s, rem_s FROM sleep_v""")
def _(v):
    return v.sleep.drop("row_id", "awake_s", "not_there")


@query("p2_ordered_projection", "SELECT sport, end_time, start_time, user_id FROM sessions_v")
def _(v):
    return v.sessions.select("sport", "end_time", "start_time", "user_id")


@query("p3_days_from", "SELECT user_id, row_id, steps FROM daily_v WHERE calendar_date >= DATE '2024-01-10'")
def _(v):
    kept = v.daily.filter(F.col("calendar_date") >= F.lit("2024-01-10").cast("date"))
    return kept.select("user_id", "row_id", "steps")


@query("p4_nested_or_null", """
    SELECT row_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
      CAST(NULL AS DOUBLE) AS missing FROM daily_v""")
def _(v):
    nested = F.from_json("props", "k DOUBLE, missing STRUCT<m: DOUBLE>")
    return v.daily.select(
        "row_id", S.nested_or_null(nested, "k").alias("k"), S.nested_or_null(nested, "missing", "m").alias("missing")
    )


@query("p4_json_number", """
    SELECT row_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM daily_v""")
def _(v):
    return v.daily.select("row_id", S.json_number("props", "$.k").alias("k"))


@query("p5_element_or_null", """
    SELECT row_id, steps AS first, CASE WHEN row_id % 2 = 0 THEN steps * 2 END AS second,
      CAST(NULL AS DOUBLE) AS third FROM daily_v""")
def _(v):
    one = F.struct(F.col("steps").alias("statsValue"))
    two = F.struct((F.col("steps") * 2).alias("statsValue"))
    values = F.when(F.col("row_id") % 2 == 0, F.array(one, two)).otherwise(F.array(one))
    return v.daily.select(
        "row_id",
        *[S.element_or_null(values, i, "statsValue").alias(n) for i, n in enumerate(("first", "second", "third"))],
    )


@query("p6_parse_times", "SELECT row_id, calendar_date AS day, start_sleep AS at FROM sleep_v")
def _(v):
    text = v.sleep.select(
        "row_id", F.date_format("calendar_date", "yyyy-MM-dd").alias("d"), F.col("start_sleep").cast("string").alias("t")
    )
    return text.select("row_id", F.to_date("d").alias("day"), F.col("t").cast("timestamp_ntz").alias("at"))


@query("p7_epoch_millis", """
    SELECT row_id, date_trunc('milliseconds', begin_ts) AS at, CAST(begin_ts AS DATE) AS day FROM workouts_v""")
def _(v):
    ms = F.unix_millis(F.col("begin_ts").cast("timestamp"))
    return v.workouts.select("row_id", S.millis_to_timestamp(ms).alias("at"), S.millis_to_day(ms).alias("day"))


@query("p8_millis_duration", "SELECT row_id, CAST(row_id % 7200 AS DOUBLE) AS seconds FROM workouts_v")
def _(v):
    interval = S.millis_duration((F.col("row_id") % 7200) * 1000)
    seconds = F.extract(F.lit("HOUR"), interval) * 3600 + F.extract(F.lit("MINUTE"), interval) * 60 \
        + F.extract(F.lit("SECOND"), interval)
    return v.workouts.select("row_id", seconds.cast("double").alias("seconds"))


@query("p9_sport_filter", """
    SELECT activity_id, sport FROM sessions_v WHERE sport IN ('cycling', 'running', 'swimming', 'walking')""")
def _(v):
    from pacelake.schemas import MODEL_SPORTS

    return v.sessions.filter(F.col("sport").isin(*MODEL_SPORTS)).select("activity_id", "sport")


@query("p10_full_stamina", """
    SELECT activity_id, CASE WHEN sport IN ('swimming', 'walking') THEN 100.0 ELSE stamina_begin END AS stamina
    FROM sessions_v""")
def _(v):
    return v.sessions.select("activity_id", S.full_stamina("sport", "stamina_begin").alias("stamina"))


@query("p11_rename", 'SELECT activity_id, benefit AS "Primary_benefit", sport AS "Sport" FROM sessions_v')
def _(v):
    cols = v.sessions.select("activity_id", "benefit", "sport")
    return cols.withColumnsRenamed({"benefit": "Primary_benefit", "sport": "Sport"})


@query("p12_p13_units", f"""
    SELECT activity_id, {AVG} AS kmh, round(total_distance / 1000, 6) AS km
    FROM sessions_v""")
def _(v):
    return v.sessions.select(
        "activity_id", S.kmh("enhanced_avg_speed").alias("kmh"), F.round(S.kilometres("total_distance"), 6).alias("km")
    )


@query("p14_p15_duration_and_distance", f"""
    SELECT activity_id, {SECONDS} AS seconds, {SECONDS} // 3600 AS hours, ({SECONDS} % 3600) // 60 AS minutes,
      concat({SECONDS} // 3600, 'h', ({SECONDS} % 3600) // 60) AS duration,
      {KM} AS km
    FROM sessions_v""")
def _(v):
    s = v.sessions.withColumn("seconds", S.duration_seconds("start_time", "end_time"))
    return s.select(
        "activity_id", "seconds", S.duration_hours("seconds").alias("hours"),
        S.duration_minutes("seconds").alias("minutes"), S.duration_text("seconds").alias("duration"),
        S.estimated_km(S.kmh("enhanced_avg_speed"), "seconds").alias("km"),
    )


@query("p16_benefit_label", f"""
    SELECT activity_id, CASE CAST(benefit AS INT) {LABELS} END AS label FROM sessions_v""")
def _(v):
    return v.sessions.select("activity_id", S.benefit_label("benefit").alias("label"))


@query("p17_benefit_text", f"""
    SELECT activity_id, CASE WHEN sport = 'walking' THEN 'Tempo' WHEN benefit IS NULL THEN NULL
      ELSE CASE CAST(benefit AS INT) {LABELS} ELSE '8' END END AS label FROM sessions_v""")
def _(v):
    mixed = F.when(F.col("sport") == "walking", "Tempo").otherwise((F.col("benefit") + 0.25).cast("string"))
    return v.sessions.select("activity_id", S.benefit_text(mixed).alias("label"))


@query("p18_calendar_parts", """
    SELECT activity_id, CAST(year(end_time) AS INT) AS year, CAST(month(end_time) AS INT) AS month,
      CAST(day(end_time) AS INT) AS day, CAST(date_trunc('month', end_time) AS DATE) AS period,
      CAST(end_time AS DATE) AS date FROM sessions_v""")
def _(v):
    e = "end_time"
    return v.sessions.select(
        "activity_id", F.year(e).alias("year"), F.month(e).alias("month"), F.dayofmonth(e).alias("day"),
        S.month_start(e).alias("period"), F.to_date(e).alias("date"),
    )


@query("p19_one_month", """
    SELECT activity_id FROM sessions_v WHERE year(start_time) = 2024 AND month(start_time) = 1""")
def _(v):
    return v.sessions.filter(S.in_month("start_time", 2024, 1)).select("activity_id")


@query("p20_moving", "SELECT activity_id, enhanced_avg_speed FROM sessions_v WHERE enhanced_avg_speed > 0")
def _(v):
    return reports.moving(v.sessions).select("activity_id", "enhanced_avg_speed")


ANGLE = "(2 * pi() * ((hour({0}) * 60 + minute({0})) / 1440.0))"


@query("p21_cyclic_encode", f"""
    SELECT activity_id, round(sin({ANGLE.format('start_time')}), 6) AS s,
      round(cos({ANGLE.format('start_time')}), 6) AS c FROM sessions_v""")
def _(v):
    s, c = cyclic.encode_time("start_time")
    return v.sessions.select("activity_id", F.round(s, 6).alias("s"), F.round(c, 6).alias("c"))


@query("p22_cyclic_sleep", f"""
    SELECT row_id, round(sin({ANGLE.format('start_sleep')}), 6) AS start_sleep_sin,
      round(cos({ANGLE.format('start_sleep')}), 6) AS start_sleep_cos,
      round(sin({ANGLE.format('end_sleep')}), 6) AS end_sleep_sin,
      round(cos({ANGLE.format('end_sleep')}), 6) AS end_sleep_cos FROM sleep_v""")
def _(v):
    out = cyclic.encode_times(v.sleep.select("row_id", "start_sleep", "end_sleep"), ["start_sleep", "end_sleep"])
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("p23_cyclic_session", f"""
    SELECT activity_id, round(sin({ANGLE.format('end_time')}), 6) AS end_time_sin,
      round(cos({ANGLE.format('end_time')}), 6) AS end_time_cos,
      round(sin({ANGLE.format('start_time')}), 6) AS start_time_sin,
      round(cos({ANGLE.format('start_time')}), 6) AS start_time_cos FROM sessions_v""")
def _(v):
    cols = ["end_time", "start_time"]
    out = cyclic.encode_times(v.sessions.select("activity_id", *cols), cols)
    return out.select("activity_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("p24_cyclic_decode", """
    SELECT activity_id, printf('%d:%02d:00', hour(start_time), minute(start_time)) AS t FROM sessions_v""")
def _(v):
    s, c = cyclic.encode_time("start_time")
    return v.sessions.select("activity_id", cyclic.decode_time(s, c, snap=True).alias("t"))


@query("p25_fill_speed", """
    SELECT activity_id, coalesce(enhanced_avg_speed, 0.0) AS a,
      coalesce(enhanced_max_speed, enhanced_avg_speed, 0.0) AS m FROM sessions_v""")
def _(v):
    a, m = S.fill_speed("enhanced_avg_speed", "enhanced_max_speed")
    return v.sessions.select("activity_id", a.alias("a"), m.alias("m"))


@query("p26_time_text", """
    SELECT activity_id, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS text,
      date_trunc('second', start_time) AS second FROM sessions_v""")
def _(v):
    return v.sessions.select("activity_id", S.time_text("start_time").alias("text"), S.whole_second("start_time").alias("second"))


@query("p27_parse_free_text", """
    SELECT activity_id, date_trunc('minute', start_time) AS at FROM sessions_v""")
def _(v):
    iso = F.date_format("start_time", "yyyy-MM-dd HH:mm")
    slashed = F.date_format("start_time", "dd/MM/yyyy HH:mm")
    text = F.when(F.col("activity_id") % 2 == 0, slashed).otherwise(iso)
    at = S.parse_time(text, ["dd/MM/yyyy HH:mm", "yyyy-MM-dd HH:mm"]).cast("timestamp_ntz")
    return v.sessions.select("activity_id", at.alias("at"))


@query("p28_sleep_hours", """
    SELECT row_id, round((deep_s + light_s + rem_s + awake_s) / 3600.0, 6) AS h FROM sleep_v""")
def _(v):
    return v.sleep.select("row_id", F.round(S.sleep_hours("deep_s", "light_s", "rem_s", "awake_s"), 6).alias("h"))


@query("p29_session_summary", f"""
    SELECT activity_id, total_calories AS calories, upper(sport) AS sport,
      {KM} AS distance,
      max_heart_rate, avg_heart_rate, {AVG} AS avg_speed,
      {MAX} AS max_speed, {SECONDS} // 3600 AS hours,
      ({SECONDS} % 3600) // 60 AS minutes, end_time AS "timestamp", start_time
    FROM sessions_v""")
def _(v):
    return summarise_session(v.sessions.withColumnRenamed("end_time", "timestamp"), ["activity_id"])


@query("p30_display_table", f"""
    SELECT activity_id, sport AS "Sport",
      CASE WHEN benefit IS NULL THEN NULL ELSE CASE CAST(benefit AS INT) {LABELS} ELSE '8' END END AS "Primary benefit",
      avg_heart_rate AS "Average Heart Rate", max_heart_rate AS "Max Heart Rate",
      {AVG} AS "Average Speed",
      {MAX} AS "Max Speed",
      {KM} AS "Distance",
      start_time AS "Start time", end_time AS "End time",
      concat({SECONDS} // 3600, 'h', ({SECONDS} % 3600) // 60) AS "Duration", total_calories AS "Calories"
    FROM sessions_v""")
def _(v):
    named = v.sessions.withColumnsRenamed({"end_time": "timestamp", "benefit": "188"})
    return summarise_predictions(named, ["activity_id"])


@query("p31_elapsed", """
    SELECT activity_id, round((epoch_us(start_time) - min(epoch_us(start_time)) OVER (PARTITION BY user_id)) / 1e6, 6)
      AS elapsed_s FROM sessions_v""")
def _(v):
    out = reports.with_elapsed(v.sessions, "start_time", ["user_id"])
    return out.select("activity_id", F.round("elapsed_s", 6).alias("elapsed_s"))


@query("p32_cadence_speed_points", """
    SELECT avg_cadence, enhanced_avg_speed, sport FROM sessions_v
    WHERE avg_cadence IS NOT NULL AND enhanced_avg_speed IS NOT NULL""")
def _(v):
    return reports.cadence_speed_points(v.sessions)


POINTS = [
    "distance", "avg_speed", "max_speed", "total_distance", "enhanced_avg_speed", "enhanced_max_speed", "avg_heart_rate",
    "max_heart_rate", "total_calories", "avg_cadence", "benefit", "stamina_begin", "avg_power", "deep_s", "light_s", "awake_s",
]


@query("p33_sleep_against_features", f"""
    WITH j AS (SELECT s.row_id AS sleep_id, w.row_id AS workout_id, (deep_s + light_s + rem_s + awake_s) / 3600.0 AS y,
        {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in POINTS)}
      FROM sleep_v s JOIN workouts_v w ON s.user_id = w.user_id AND s.calendar_date = w.calendar_date
      JOIN sessions_v e ON e.activity_id = w.row_id)
    {' UNION ALL '.join(f"SELECT sleep_id, workout_id, round(y, 6) AS y, '{c}' AS feature, round({c}, 6) AS x FROM j" for c in POINTS)}""")
def _(v):
    nights = v.sleep.withColumnRenamed("row_id", "sleep_id")
    joined = nights.join(v.workouts.withColumnRenamed("row_id", "workout_id"), ["user_id", "calendar_date"])
    joined = joined.join(v.sessions.withColumnRenamed("activity_id", "workout_id").drop("user_id"), "workout_id")
    y = S.sleep_hours("deep_s", "light_s", "rem_s", "awake_s")
    out = reports.xy_points(joined, y, POINTS, ["sleep_id", "workout_id"])
    return out.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query("p33_sweat_against_calories", """
    SELECT d.row_id, e.activity_id, round(d.steps, 6) AS y, 'total_calories' AS feature, round(e.total_calories, 6) AS x
    FROM daily_v d JOIN sessions_v e ON d.user_id = e.user_id AND d.calendar_date = CAST(e.start_time AS DATE)""")
def _(v):
    """The day's value stands for the sweat loss."""
    worked = v.sessions.withColumn("calendar_date", F.to_date("start_time"))
    joined = v.daily.join(worked, ["user_id", "calendar_date"])
    out = reports.xy_points(joined, F.col("steps"), ["total_calories"], ["row_id", "activity_id"])
    return out.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@query("p34_last_rows_where", """
    SELECT activity_id, sport FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_time DESC, activity_id DESC) AS rn
      FROM sessions_v) WHERE rn <= 50 AND sport = 'walking'""")
def _(v):
    return reports.last_rows_where(v.sessions, 50, F.col("sport") == "walking").select("activity_id", "sport")

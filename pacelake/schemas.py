"""Table schemas, key lists and label maps."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Names and codes the exported files use.
# ---------------------------------------------------------------------------

BENEFIT_LABELS = {
    0: "None",
    1: "Recovery",
    2: "Base",
    3: "Tempo",
    4: "Threshold",
    5: "VO2max",
    6: "Anaerobic",
    7: "Speed",
}

MODEL_SPORTS = ["cycling", "running", "swimming", "walking"]
CROSS_TABLE_SPORTS = ["cycling", "running", "training", "swimming", "walking"]
SPEED_TREND_SPORTS = ["running", "cycling", "swimming"]

SESSION_KEYS = [
    "178", "188", "205", "206", "207",
    "avg_cadence", "avg_heart_rate", "avg_power", "avg_step_length", "avg_stroke_distance",
    "enhanced_avg_speed", "enhanced_max_speed", "max_cadence", "max_heart_rate", "max_power",
    "max_running_cadence", "normalized_power", "num_active_lengths", "num_lengths",
    "pool_length", "pool_length_unit", "sport", "start_time", "sub_sport", "timestamp",
    "total_anaerobic_training_effect", "total_ascent", "total_calories", "total_descent",
    "total_distance", "total_strokes", "total_training_effect", "training_load_peak",
    "training_stress_score",
]
RECORD_KEYS = [
    "137", "138", "90", "accumulated_power", "cadence", "distance", "enhanced_speed",
    "heart_rate", "power", "timestamp",
]
LENGTH_KEYS = ["avg_speed", "avg_swimming_cadence", "start_time", "timestamp", "total_strokes"]
SET_KEYS = [
    "category", "duration", "repetitions", "set_type", "start_time", "timestamp", "weight",
    "weight_display_unit",
]
MESSAGE_KEYS = {
    "SESSION": SESSION_KEYS,
    "RECORD": RECORD_KEYS,
    "SET": SET_KEYS,
    "LENGTH": LENGTH_KEYS,
}
TEXT_KEYS = {
    "category", "pool_length_unit", "set_type", "sport", "sub_sport", "weight_display_unit",
    "event", "event_type", "sport_profile_name", "trigger", "activity_type", "developer_fields",
}
TIME_KEYS = {"start_time", "timestamp"}

# Wide per-sport key lists of the sample messages.
RUNNING_RECORD_KEYS = [
    "90", "107", "134", "137", "138", "140", "143", "144", "accumulated_power",
    "activity_type", "cadence", "cycle_length16", "developer_fields", "distance",
    "enhanced_altitude", "enhanced_respiration_rate", "enhanced_speed", "fractional_cadence",
    "heart_rate", "position_lat", "position_long", "power", "stance_time",
    "stance_time_balance", "stance_time_percent", "step_length", "temperature", "timestamp",
    "vertical_oscillation", "vertical_ratio",
]
CYCLING_RECORD_KEYS = [
    "90", "107", "134", "137", "138", "144", "accumulated_power", "cadence", "distance",
    "enhanced_altitude", "enhanced_respiration_rate", "enhanced_speed", "fractional_cadence",
    "heart_rate", "left_pedal_smoothness", "left_torque_effectiveness", "position_lat",
    "position_long", "power", "right_pedal_smoothness", "right_torque_effectiveness",
    "temperature", "timestamp",
]
WALKING_RECORD_KEYS = [
    "107", "135", "136", "141", "143", "cadence", "cycle_length16", "developer_fields",
    "distance", "enhanced_altitude", "enhanced_speed", "fractional_cadence", "heart_rate",
    "position_lat", "position_long", "timestamp",
]
ALL_RECORD_KEYS = sorted({*RUNNING_RECORD_KEYS, *CYCLING_RECORD_KEYS, *WALKING_RECORD_KEYS})

# Union of the session keys seen over running, cycling, walking, swimming and strength.
ALL_SESSION_KEYS = [
    "78", "79", "80", "81", "106", "138", "151", "152", "178", "184", "188", "192", "193",
    "196", "203", "204", "205", "206", "207", "211", "212", "215", "216", "avg_cadence",
    "avg_flow", "avg_fractional_cadence", "avg_heart_rate", "avg_left_pedal_smoothness",
    "avg_left_torque_effectiveness", "avg_power", "avg_running_cadence", "avg_speed",
    "avg_stance_time", "avg_stance_time_balance", "avg_stance_time_percent",
    "avg_step_length", "avg_stroke_distance", "avg_temperature", "avg_vam",
    "avg_vertical_oscillation", "avg_vertical_ratio", "developer_fields", "end_position_lat",
    "end_position_long", "enhanced_avg_respiration_rate", "enhanced_avg_speed",
    "enhanced_max_respiration_rate", "enhanced_max_speed", "enhanced_min_respiration_rate",
    "event", "event_type", "first_lap_index", "intensity_factor", "max_cadence",
    "max_fractional_cadence", "max_heart_rate", "max_power", "max_running_cadence",
    "max_speed", "max_temperature", "message_index", "min_temperature", "nec_lat", "nec_long",
    "normalized_power", "num_active_lengths", "num_laps", "num_lengths", "pool_length",
    "pool_length_unit", "sport", "sport_profile_name", "start_position_lat",
    "start_position_long", "start_time", "sub_sport", "swc_lat", "swc_long",
    "threshold_power", "timestamp", "total_anaerobic_training_effect", "total_ascent",
    "total_calories", "total_cycles", "total_descent", "total_distance",
    "total_elapsed_time", "total_fractional_ascent", "total_fractional_descent",
    "total_grit", "total_strides", "total_strokes", "total_timer_time",
    "total_training_effect", "total_work", "training_load_peak", "training_stress_score",
    "trigger",
]

WORKOUT_COLUMNS = [
    "beginTimestamp", "activityTrainingLoad", "activityType", "aerobicTrainingEffect",
    "aerobicTrainingEffectMessage", "anaerobicTrainingEffect",
    "anaerobicTrainingEffectMessage", "avgBikeCadence", "avgHr", "avgPower", "avgRunCadence",
    "avgSpeed", "calories", "caloriesConsumed", "distance", "duration", "maxHr", "maxPower",
    "maxRunCadence", "maxSpeed", "moderateIntensityMinutes", "normPower", "sportType",
    "trainingEffectLabel", "trainingStressScore", "vigorousIntensityMinutes",
]
WORKOUT_TEXT_COLUMNS = {
    "activityType", "sportType", "trainingEffectLabel", "aerobicTrainingEffectMessage",
    "anaerobicTrainingEffectMessage",
}

SLEEP_DROP = [
    "sleepResultType", "napList", "sleepWindowConfirmationType", "retro", "spo2SleepSummary",
    "averageRespiration", "lowestRespiration", "highestRespiration", "restlessMomentCount",
    "awakeCount", "unmeasurableSeconds", "avgSleepStress",
]
SLEEP_PHASES = ["deepSleepSeconds", "lightSleepSeconds", "remSleepSeconds", "awakeSleepSeconds"]

DAILY_DROP = [
    # identifiers, bookkeeping and goals
    "userProfilePK", "uuid", "durationInMilliseconds", "dailyStepGoal", "netCalorieGoal",
    "wellnessStartTimeGmt", "wellnessEndTimeGmt", "wellnessStartTimeLocal",
    "wellnessEndTimeLocal", "userIntensityMinutesGoal", "userFloorsAscendedGoal",
    "includesWellnessData", "includesActivityData", "includesCalorieConsumedData",
    "includesSingleMeasurement", "includesContinuousMeasurement", "includesAllDayPulseOx",
    "includesSleepPulseOx", "source", "version", "isVigorousDay", "restingHeartRateTimestamp",
    "averageMonitoringEnvironmentAltitude", "moderateIntensityMinutes",
    "vigorousIntensityMinutes",
    # nested fields whose parts are taken out first
    "respiration", "bodyBattery", "hydration", "allDayStress", "bodyBatteryFeedback",
    # several names for the same calories
    "burnedKilocalories", "consumedKilocalories", "wellnessKilocalories",
    "remainingKilocalories", "wellnessTotalKilocalories", "wellnessActiveKilocalories",
    "bmrKilocalories",
    # known only at the end of the day, so they would leak
    "totalSteps", "minHeartRate", "maxHeartRate", "currentDayRestingHeartRate",
    # always empty
    "averageSpo2Value", "lowestSpo2Value", "latestSpo2Value", "latestSpo2ValueReadingTimeGmt",
    "latestSpo2ValueReadingTimeLocal", "restingCaloriesFromActivity", "totalPushes",
    "pushDistance", "jetLagDay", "jetLagTripName", "jetLagTripPk", "dailyTotalFromEpochData",
]
DAILY_FIRST_DAY = "2019-01-01"

# Columns the two encoders leave out or treat apart.
HISTORY_EXCLUDE = [
    "avgBikeCadence", "avgPower", "caloriesConsumed", "maxPower", "normPower",
    "trainingStressScore",
]
HISTORY_ZERO_FILL = [
    "avgRunCadence", "moderateIntensityMinutes", "vigorousIntensityMinutes", "distance",
]
HISTORY_SPEED = ("avgSpeed", "maxSpeed")
HISTORY_CATEGORIES = ["sportType", "trainingEffectLabel"]
HISTORY_TIMES = ["start_sleep", "end_sleep", "beginTimestamp"]
SESSION_EXCLUDE = [
    "avg_stroke_distance", "num_active_lengths", "num_lengths", "max_running_cadence",
    "pool_length", "max_cadence", "avg_step_length", "normalized_power", "avg_power",
    "total_strokes", "training_stress_score", "avg_cadence", "max_power", "total_distance",
    "total_descent", "total_ascent",
]
SESSION_SPEED = ("enhanced_avg_speed", "enhanced_max_speed")
SESSION_STAMINA = "205"
SESSION_STAMINA_FILL = 100.0
SESSION_BENEFIT = "188"
SESSION_TIMES = ["timestamp", "start_time"]
IMPUTE_NEIGHBOURS = 4
SPARSE_SHARE = 0.6
WINDOW_ROWS = 60

DISPLAY_CODES = {
    "188": "Primary_benefit",
    "178": "Sweat_loss",
    "206": "Ending_potential_stamina",
    "207": "Min_stamina",
    "205": "Beginning_potential_stamina",
}
DISPLAY_HEADINGS = {
    "sport": "Sport",
    "Primary_benefit": "Primary benefit",
    "avg_heart_rate": "Average Heart Rate",
    "max_heart_rate": "Max Heart Rate",
    "enhanced_avg_speed": "Average Speed",
    "enhanced_max_speed": "Max Speed",
    "total_distance": "Distance",
    "start_time": "Start time",
    "timestamp": "End time",
    "duration": "Duration",
    "total_calories": "Calories",
}

# ---------------------------------------------------------------------------
# Schemas of the exported files. ``user_id`` is the athlete key of this build.
# ---------------------------------------------------------------------------


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


_D, _L, _S = T.DoubleType(), T.LongType(), T.StringType()

SLEEP_FILE = _struct(
    user_id=_L, calendarDate=_S, sleepStartTimestampGMT=_S, sleepEndTimestampGMT=_S,
    **dict.fromkeys(SLEEP_PHASES, _L), sleepScores=_struct(qualityScore=_S),
)

WORKOUT = T.StructType([
    T.StructField("user_id", _L),
    *[
        T.StructField(c, _L if c == "beginTimestamp" else _S if c in WORKOUT_TEXT_COLUMNS else _D)
        for c in WORKOUT_COLUMNS
    ],
])
WORKOUT_FILE = _struct(summarizedActivitiesExport=T.ArrayType(WORKOUT))

DAILY_FILE = _struct(
    user_id=_L, calendarDate=_S,
    hydration=_struct(sweatLossInML=_D),
    respiration=_struct(
        avgWakingRespirationValue=_D, highestRespirationValue=_D, lowestRespirationValue=_D
    ),
    bodyBattery=_struct(bodyBatteryStatList=T.ArrayType(_struct(statsValue=_D))),
    allDayStress=_struct(aggregatorList=T.ArrayType(_struct(averageStressLevel=_D))),
    totalDistanceMeters=_D,
)

MESSAGES = _struct(
    user_id=_L, activity_id=_S, seq=_L, mesg=_S, fields=T.MapType(_S, _S)
)


def message_type(key: str) -> T.DataType:
    """Type of one decoded message field."""
    if key in TIME_KEYS:
        return T.TimestampNTZType()
    return _S if key in TEXT_KEYS else _D


SESSIONS = T.StructType(
    [T.StructField("user_id", _L), T.StructField("activity_id", _S)]
    + [T.StructField(k, message_type(k)) for k in SESSION_KEYS]
)
HISTORY_DAILY_COLUMNS = [
    "hydration_sweatLossInML", "respiration_avgWakingRespirationValue",
    "respiration_highestRespirationValue", "respiration_lowestRespirationValue",
    "bodyBattery_Highest", "bodyBattery_Lowest", "allDayStress_awake", "allDayStress_asleep",
]
HISTORY = T.StructType(
    [T.StructField("user_id", _L), T.StructField("calendarDate", T.DateType()),
     T.StructField("start_sleep", T.TimestampNTZType()),
     T.StructField("end_sleep", T.TimestampNTZType())]
    + [T.StructField(c, _L) for c in SLEEP_PHASES]
    + [T.StructField("qualityScore", _S)]
    + [T.StructField(
        c, T.TimestampNTZType() if c == "beginTimestamp"
        else _S if c in WORKOUT_TEXT_COLUMNS else _D) for c in WORKOUT_COLUMNS]
    + [T.StructField("totalDistanceMeters", _D)]
    + [T.StructField(c, _D) for c in HISTORY_DAILY_COLUMNS]
)
HISTORY_CASTS = {"start_sleep": "timestamp", "end_sleep": "timestamp", "beginTimestamp": "timestamp"}
SESSION_CASTS = {"timestamp": "timestamp", "start_time": "timestamp"}

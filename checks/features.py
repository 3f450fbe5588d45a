"""Feature encoders over the stand-in sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.registry import query
from pacelake.operators import features as X, profile
from pacelake.operators.impute import fit_neighbour_imputer
from pacelake.operators.sparse import SparseOneHot
from pacelake.schemas import BENEFIT_LABELS
from pacelake.session import scratch_dir

COLUMNS = ["total_distance", "enhanced_avg_speed", "avg_heart_rate", "avg_cadence", "max_heart_rate", "total_calories"]
LABELS = " ".join(f"WHEN {k} THEN '{v}'" for k, v in BENEFIT_LABELS.items())


def _imputed(block: str, columns: list[str] = COLUMNS, lacking: list[str] = COLUMNS[:4], digits: int = 6) -> str:
    gaps = " + ".join(f"CASE WHEN a.{c} IS NOT NULL AND b.{c} IS NOT NULL THEN (a.{c} - b.{c}) * (a.{c} - b.{c}) ELSE 0.0 END" for c in columns)
    shared = " + ".join(f"CASE WHEN a.{c} IS NOT NULL AND b.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in columns)
    same = " AND ".join(f"a.{b} = b.{b}" for b in block.split(", "))
    cells = " UNION ALL ".join(f"""
      SELECT * FROM (SELECT rid, '{c}' AS f, x_{c} AS x, row_number() OVER (PARTITION BY rid ORDER BY d, did) AS rn
        FROM pairs WHERE x_{c} IS NOT NULL AND y_{c} IS NULL) WHERE rn <= 4""" for c in lacking)
    mean = f"SELECT {block}, {', '.join(f'avg({c}) AS {c}' for c in columns)} FROM sessions_v GROUP BY {block}"
    out = ", ".join(
        f"round(coalesce(s.{c}, n.{c}, m.{c}, (SELECT avg({c}) FROM sessions_v)), {digits}) AS {c}" for c in columns)
    near = ", ".join(
        f"avg(x) FILTER (WHERE f = '{c}') AS {c}" if c in lacking else f"CAST(NULL AS DOUBLE) AS {c}" for c in columns)
    on = " AND ".join(f"s.{b} = m.{b}" for b in block.split(", "))
    return f"""
    WITH pairs AS (
      SELECT a.activity_id AS rid, b.activity_id AS did, ({gaps}) * {len(columns)} / ({shared}) AS d,
        {', '.join(f'b.{c} AS x_{c}, a.{c} AS y_{c}' for c in lacking)}
      FROM sessions_v a JOIN sessions_v b ON {same}
      WHERE ({' OR '.join(f'a.{c} IS NULL' for c in lacking)}) AND ({shared}) > 0),
    near AS (SELECT rid, {near} FROM ({cells}) GROUP BY rid),
    means AS ({mean})
    SELECT s.activity_id, {out} FROM sessions_v s LEFT JOIN near n ON s.activity_id = n.rid
    LEFT JOIN means m ON {on}"""


def _fill(v, block, **options):
    model = fit_neighbour_imputer(v.sessions, COLUMNS, "activity_id", block, **options)
    out = model.transform(v.sessions)
    return out.select("activity_id", *[F.round(c, 6).alias(c) for c in COLUMNS])


@query("f3_neighbour_imputation", _imputed("user_id, sport"))
def _(v):
    return _fill(v, ["user_id", "sport"])


@query("f3_neighbour_imputation_per_athlete", _imputed("user_id"))
def _(v):
    return _fill(v, ["user_id"])


@query("f3_neighbour_imputation_large_athletes", _imputed("user_id"))
def _(v):
    """The same values on the tiled path, which athletes too large for one task take."""
    return _fill(v, ["user_id"], tile_rows=24)


@query("f3_neighbour_imputation_text_ids", _imputed("user_id, sport"))
def _(v):
    """Ids as text; padded, so that their order is that of the numbers."""
    named = v.sessions.withColumn("activity_id", F.lpad(F.col("activity_id").cast("string"), 12, "0"))
    out = fit_neighbour_imputer(named, COLUMNS, "activity_id", ["user_id", "sport"]).transform(named)
    return out.select(F.col("activity_id").cast("long").alias("activity_id"), *[F.round(c, 6).alias(c) for c in COLUMNS])


_KINDS = {
    "numeric": ["avg_cadence", "avg_heart_rate", "benefit", "enhanced_avg_speed", "enhanced_max_speed", "max_heart_rate",
                "stamina_begin", "total_calories", "total_distance"],
    "time": ["end_time", "start_time"], "other": ["sport"],
}


@query("f1_f2_columns_by_type", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{kind}' AS kind, count({c}) AS known, count(DISTINCT {c}) AS different FROM sessions_v"
    for kind, columns in _KINDS.items() for c in columns))
def _(v):
    """Both kinds of timestamp; each column is read under the kind that it was given."""
    df, ids = v.sessions.withColumn("end_time", F.col("end_time").cast("timestamp")), ["user_id", "activity_id", "avg_power"]
    kinds = {
        **dict.fromkeys(profile.numeric_columns(df, ids), "numeric"),
        **dict.fromkeys(profile.time_columns(df, ids), "time"),
        **dict.fromkeys(profile.other_columns(df, ids), "other"),
    }
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.count(c).alias("known"), F.count_distinct(c).alias("different"))
        for c, k in kinds.items()
    ])
    return df.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*")


@query("f4_missing_indicators", """
    SELECT activity_id, CAST(total_distance IS NULL AS DOUBLE) AS missing_total_distance,
      CAST(avg_heart_rate IS NULL AS DOUBLE) AS missing_avg_heart_rate FROM sessions_v""")
def _(v):
    cols = X.columns_with_nulls(v.sessions, ["total_distance", "avg_heart_rate", "max_heart_rate"])
    return X.missing_indicators(v.sessions, cols).select("activity_id", *map(X.indicator, cols))


@query("f5_constant_fill", """
    SELECT activity_id, coalesce(stamina_begin, 100.0) AS stamina_begin, coalesce(benefit, 0.0) AS benefit FROM sessions_v""")
def _(v):
    out = v.sessions.select("activity_id", "stamina_begin", "benefit")
    return out.fillna({"stamina_begin": 100.0, "benefit": 0.0})


@query("f6_most_frequent_fill", """
    WITH m AS (SELECT CASE WHEN activity_id % 4 = 0 THEN NULL ELSE sport END AS sport, activity_id FROM sessions_v),
    t AS (SELECT sport FROM m WHERE sport IS NOT NULL GROUP BY sport ORDER BY count(*) DESC, sport LIMIT 1)
    SELECT activity_id, coalesce(sport, (SELECT sport FROM t)) AS sport FROM m""")
def _(v):
    holes = v.sessions.select("activity_id", F.when(F.col("activity_id") % 4 != 0, F.col("sport")).alias("sport"))
    return holes.fillna(X.most_frequent(holes, ["sport"]))


def _scaled(c: str, s: str = "sessions_v") -> str:
    return (f"(SELECT quantile_cont({c}, 0.5) FROM {s}) AS m_{c}, (SELECT CASE WHEN quantile_cont({c}, 0.75) = "
            f"quantile_cont({c}, 0.25) THEN 1 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END FROM {s}) AS r_{c}")


@query("f7_robust_scale", f"""
    SELECT activity_id, {', '.join(f'round((s.{c} - m_{c}) / r_{c}, 6) AS {c}' for c in COLUMNS)}
    FROM sessions_v s, (SELECT {', '.join(_scaled(c) for c in COLUMNS)}) q""")
def _(v):
    out = X.RobustScaler.fit(v.sessions, COLUMNS).transform(v.sessions)
    return out.select("activity_id", *[F.round(c, 6).alias(c) for c in COLUMNS])


@query("f7_robust_scale_bracketed", f"""
    SELECT activity_id, {', '.join(f'round((s.{c} - m_{c}) / r_{c}, 6) AS {c}' for c in COLUMNS)}
    FROM sessions_v s, (SELECT {', '.join(_scaled(c) for c in COLUMNS)}) q""")
def _(v):
    """The same statistics on the path that columns with very many values take."""
    from pacelake.operators.quantiles import exact_quantiles

    found = exact_quantiles(v.sessions, COLUMNS, profile.QUARTILES, max_values=500)
    scaler = X.RobustScaler({c: [q[1], (q[2] - q[0]) or 1.0] for c, q in found.items()})
    return scaler.transform(v.sessions).select("activity_id", *[F.round(c, 6).alias(c) for c in COLUMNS])


@query("f8_inverse_robust_scale", f"SELECT activity_id, {', '.join(f'round({c}, 6) AS {c}' for c in COLUMNS)} FROM sessions_v")
def _(v):
    scaler = X.RobustScaler.fit(v.sessions, COLUMNS)
    out = scaler.inverse_transform(scaler.transform(v.sessions))
    return out.select("activity_id", *[F.round(c, 6).alias(c) for c in COLUMNS])


SPORTS = ["cycling", "running", "swimming", "training", "walking"]


@query("f9_one_hot", f"""
    SELECT activity_id, {', '.join(f"CASE WHEN sport = '{s}' THEN 1.0 ELSE 0.0 END AS sport_{s}" for s in SPORTS)}
    FROM sessions_v""")
def _(v):
    df = v.sessions.select("activity_id", "sport")
    return X.OneHot.fit(df, ["sport"]).transform(df)


@query("f9_one_hot_two_values", """
    SELECT activity_id, CASE WHEN CASE WHEN activity_id % 2 = 0 THEN 'even' ELSE 'odd' END = 'odd' THEN 1.0 ELSE 0.0 END
      AS parity_odd FROM sessions_v""")
def _(v):
    parity = F.when(F.col("activity_id") % 2 == 0, "even").otherwise("odd")
    df = v.sessions.select("activity_id", parity.alias("parity"))
    return X.OneHot.fit(df, ["parity"]).transform(df)


@query("f9_f10_sparse_one_hot", """
    SELECT activity_id, count(*) OVER () AS size, row_number() OVER (ORDER BY CAST(activity_id AS VARCHAR)) - 1 AS place,
      concat('a', activity_id) AS back FROM sessions_v""")
def _(v):
    """A category for every activity, far more than dense columns could hold."""
    df = v.sessions.select("activity_id", F.concat(F.lit("a"), F.col("activity_id").cast("string")).alias("back"))
    coder = SparseOneHot.fit(df, ["back"])
    cells = F.unwrap_udt("back_hot")
    coded = coder.transform(df)
    shown = coded.withColumns({"size": cells["size"].cast("long"), "place": F.get(cells["indices"], F.lit(0)).cast("long")})
    return coder.inverse_transform(shown)


@query("f10_inverse_one_hot", """
    SELECT activity_id, CASE WHEN activity_id % 10 = 0 THEN NULL ELSE sport END AS sport FROM sessions_v""")
def _(v):
    df = v.sessions.select("activity_id", "sport")
    hot = X.OneHot.fit(df, ["sport"])
    coded = hot.transform(df)
    names = hot.names("sport")
    blank = coded.withColumns({n: F.when(F.col("activity_id") % 10 == 0, 0.0).otherwise(F.col(n) * 0.7) for n in names})
    return hot.inverse_transform(blank)


@query("f11_benefit_one_hot", f"""
    WITH b AS (SELECT activity_id, CASE CAST(coalesce(benefit, 0) AS INT) {LABELS} END AS label FROM sessions_v)
    SELECT activity_id, {', '.join(f'''CASE WHEN label = '{s}' THEN 1.0 ELSE 0.0 END AS "benefit_{s}"''' for s in BENEFIT_LABELS.values())}
    FROM b""")
def _(v):
    settings = X.Settings(
        keys=[], row_id="activity_id", block=["user_id"], exclude=[], constant={}, speed=[], one_hot=[], times=[],
        benefit="benefit", sparse_share=1.0,
    )
    model = X.fit_encoder(v.sessions.select("user_id", "activity_id", "benefit"), settings)
    return model.transform(v.sessions).drop("user_id")


def _named(v):
    """Sessions under the column names the session encoder knows."""
    return v.sessions.withColumnsRenamed({"end_time": "timestamp", "benefit": "188", "stamina_begin": "205"})


def _history(v):
    """Workouts joined to the night before them, under the history's column names."""
    nights = v.sleep.groupBy("user_id", "calendar_date").agg(
        F.min("start_sleep").alias("start_sleep"), F.min("end_sleep").alias("end_sleep"),
        F.min("deep_s").alias("deepSleepSeconds"), F.min("rem_s").alias("remSleepSeconds"),
    )
    renamed = {
        "begin_ts": "beginTimestamp", "sport_type": "sportType", "avg_speed": "avgSpeed", "max_speed": "maxSpeed",
    }
    return v.workouts.join(nights, ["user_id", "calendar_date"]).withColumnsRenamed(renamed)


def _q(e: str, table: str) -> str:
    return f"(SELECT quantile_cont({e}, 0.5) FROM {table}), (SELECT quantile_cont({e}, 0.75) - quantile_cont({e}, 0.25) FROM {table})"


@query("f12_history_encoder", """
    WITH n AS (SELECT user_id, calendar_date, min(start_sleep) AS start_sleep, min(end_sleep) AS end_sleep
      FROM sleep_v GROUP BY 1, 2),
    h AS (SELECT w.row_id, w.sport_type, coalesce(distance, 0.0) AS distance, coalesce(avg_speed, 0.0) AS a,
        coalesce(max_speed, avg_speed, 0.0) AS m, begin_ts, start_sleep
      FROM workouts_v w JOIN n ON w.user_id = n.user_id AND w.calendar_date = n.calendar_date),
    q AS (SELECT quantile_cont(distance, 0.5) AS d50, quantile_cont(distance, 0.75) - quantile_cont(distance, 0.25) AS dr,
        quantile_cont(a, 0.5) AS a50, quantile_cont(a, 0.75) - quantile_cont(a, 0.25) AS ar,
        quantile_cont(m, 0.5) AS m50, quantile_cont(m, 0.75) - quantile_cont(m, 0.25) AS mr FROM h)
    SELECT row_id, round((distance - d50) / dr, 6) AS distance, round((a - a50) / ar, 6) AS "avgSpeed",
      round((m - m50) / mr, 6) AS "maxSpeed", CASE WHEN sport_type = 'purchase' THEN 1.0 ELSE 0.0 END AS "sportType_purchase",
      round(sin(2 * pi() * ((hour(begin_ts) * 60 + minute(begin_ts)) / 1440.0)), 6) AS "beginTimestamp_sin"
    FROM h, q""")
def _(v):
    history = _history(v)
    out = X.fit_history_encoder(history, "row_id").transform(history)
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in (
        "distance", "avgSpeed", "maxSpeed", "sportType_purchase", "beginTimestamp_sin")])


F13 = f"""
    WITH f AS (SELECT activity_id, coalesce(enhanced_avg_speed, 0.0) AS a,
        coalesce(enhanced_max_speed, enhanced_avg_speed, 0.0) AS m, coalesce(stamina_begin, 100.0) AS s, max_heart_rate AS h,
        CASE CAST(coalesce(benefit, 0) AS INT) {LABELS} END AS label, avg_heart_rate, sport FROM sessions_v),
    q AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS {c}50, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}r' for c in 'amsh')} FROM f)
    SELECT activity_id, round((a - a50) / ar, 6) AS enhanced_avg_speed, round((m - m50) / mr, 6) AS enhanced_max_speed,
      round((s - s50) / sr, 6) AS stamina, round((h - h50) / hr, 6) AS max_heart_rate,
      CASE WHEN label = 'Tempo' THEN 1.0 ELSE 0.0 END AS tempo, CASE WHEN sport = 'walking' THEN 1.0 ELSE 0.0 END AS walking,
      CAST(avg_heart_rate IS NULL AS DOUBLE) AS missing_avg_heart_rate FROM f, q"""


def _session_columns(out):
    return out.select("activity_id", *[F.round(F.col(c), 6).alias(n) for c, n in (
        ("enhanced_avg_speed", "enhanced_avg_speed"), ("enhanced_max_speed", "enhanced_max_speed"),
        ("205", "stamina"), ("max_heart_rate", "max_heart_rate"), ("188_Tempo", "tempo"),
        ("sport_walking", "walking"), ("missing_avg_heart_rate", "missing_avg_heart_rate"))])


@query("f13_session_encoder", F13)
def _(v):
    sessions = _named(v)
    return _session_columns(X.fit_session_encoder(sessions, "activity_id").transform(sessions))


NEIGHBOUR = ["avg_heart_rate", "max_heart_rate", "total_calories"]


@query("f13_imputed_columns", f"""
    WITH f AS ({_imputed("user_id", NEIGHBOUR, NEIGHBOUR[:1], 12)})
    SELECT activity_id, {', '.join(f'round((f.{c} - m_{c}) / r_{c}, 5) AS {c}' for c in NEIGHBOUR)},
      round((CAST(s.avg_heart_rate IS NULL AS DOUBLE)), 5) AS missing_avg_heart_rate
    FROM f JOIN (SELECT activity_id, avg_heart_rate FROM sessions_v) s USING (activity_id),
      (SELECT {', '.join(_scaled(c, "f") for c in NEIGHBOUR)}) q""")
def _(v):
    """Every column that neighbours fill, imputed and then scaled by statistics of the imputed column."""
    sessions = _named(v)
    model = X.fit_session_encoder(sessions, "activity_id")
    out = model.transform(sessions)
    return out.select("activity_id", *[F.round(c, 5).alias(c) for c in [*model.neighbour_columns, *map(X.indicator, model.indicator_columns)]])


@query("f16_stored_session_encoder", F13)
def _(v):
    sessions = _named(v)
    path = f"{scratch_dir(v.spark)}/encoder-{uuid.uuid4().hex}"
    X.fit_session_encoder(sessions, "activity_id").save(path, v.spark)
    return _session_columns(X.EncoderModel.load(path, v.spark).transform(sessions))


@query("f14_inverse_session_encoder", f"""
    SELECT activity_id, round(coalesce(enhanced_avg_speed, 0.0), 6) AS enhanced_avg_speed, max_heart_rate, sport,
      CASE CAST(coalesce(benefit, 0) AS INT) {LABELS} END AS benefit,
      round(coalesce(stamina_begin, 100.0), 6) AS stamina FROM sessions_v""")
def _(v):
    sessions = _named(v)
    model = X.fit_session_encoder(sessions, "activity_id")
    out = model.inverse_transform(model.transform(sessions), keep=["activity_id"])
    return out.select(
        "activity_id", F.round("enhanced_avg_speed", 6).alias("enhanced_avg_speed"), F.round("max_heart_rate", 6).alias("max_heart_rate"),
        "sport", F.col("188").alias("benefit"), F.round("205", 6).alias("stamina"),
    )


def _clock(c):
    return f"CAST(hour({c}) AS VARCHAR) || ':' || lpad(CAST(minute({c}) AS VARCHAR), 2, '0') || ':00'"


@query("f14_inverse_times", f"""
    SELECT activity_id, {_clock('start_time')} AS start_time, {_clock('end_time')} AS end_time, TRUE AS cut_within_a_minute
    FROM sessions_v""")
def _(v):
    sessions = _named(v)
    model = X.fit_session_encoder(sessions, "activity_id")
    encoded = model.transform(sessions, keep=["activity_id"])
    back = model.inverse_transform(encoded, keep=["activity_id"], snap=True)
    cut = model.inverse_transform(encoded, keep=["activity_id"])

    def seconds(c):
        parts = F.split(c, ":")
        return sum(F.get(parts, F.lit(i)).cast("long") * unit for i, unit in enumerate((3600, 60, 1)))

    times = cut.select("activity_id", F.col("start_time").alias("s"), F.col("timestamp").alias("t"))
    gap = F.greatest(*[
        F.abs(F.pmod(seconds(F.col(snapped)) - seconds(F.col(plain)) + 43200, F.lit(86400)) - 43200)
        for snapped, plain in (("start_time", "s"), ("timestamp", "t"))
    ])
    both = back.join(times, "activity_id")
    return both.select("activity_id", "start_time", F.col("timestamp").alias("end_time"), (gap <= 60).alias("cut_within_a_minute"))


@query("f15_plain_session_encoder", """
    WITH q AS (SELECT quantile_cont(max_heart_rate, 0.5) AS m, quantile_cont(max_heart_rate, 0.75) - quantile_cont(max_heart_rate, 0.25) AS r
      FROM sessions_v)
    SELECT activity_id, round((max_heart_rate - m) / r, 6) AS max_heart_rate, CASE WHEN sport = 'running' THEN 1.0 ELSE 0.0 END AS running
    FROM sessions_v, q""")
def _(v):
    sessions = _named(v)
    out = X.fit_plain_session_encoder(sessions, "activity_id").transform(sessions)
    return out.select("activity_id", F.round("max_heart_rate", 6).alias("max_heart_rate"), F.col("sport_running").alias("running"))

"""Forecast queries: with a plain predictor where SQL can follow, with learners otherwise."""

from __future__ import annotations

import uuid
from dataclasses import replace

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from checks.features import LABELS, SPORTS, _history, _named
from checks.registry import query
from pacelake.operators import forecast as M, linear, windows
from pacelake.operators.ordering import newest_per_key
from pacelake.schemas import BENEFIT_LABELS, MODEL_SPORTS
from pacelake.session import scratch_dir

WINDOW = 60
CONFIG = M.Config(window_rows=WINDOW, mode="asof")
SPORT_CONFIG = replace(CONFIG, window_rows=10)
"""The stand-in athletes have fewer than 60 sessions of one sport, so none of these would have a whole window before it."""

_MODELS: dict[tuple[str, str], M.ForecastModel] = {}


# -- with the mean of the window as predictor -------------------------------------------

NAIVE = """
    WITH h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY begin_ts, row_id) - 1 AS pos FROM history_v),"""


def _naive(framed, *keys):
    mean = windows.summarise(framed, 1)
    return mean.select(*keys, F.round(F.get("window_mean", F.lit(0)), 4).alias("total_calories"))


def _loads(v):
    return windows.feature_vector(v.history, ["load"])


@query("m1_flat_matrix", """
    WITH h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY begin_ts, row_id) - 1 AS pos FROM history_v),
    s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_time, activity_id) - 1 AS i FROM sessions_v)
    SELECT s.activity_id, 20 AS width, 20 - count(h.pos) AS padded, round(coalesce(sum(load), 0), 4) AS total,
      round(coalesce(arg_max(load, pos), 0), 4) AS last
    FROM s LEFT JOIN h ON h.user_id = s.user_id AND h.pos BETWEEN s.i - 20 AND s.i - 1
      AND h.begin_ts < date_trunc('second', s.start_time)
    WHERE s.i >= 20 GROUP BY s.activity_id""")
def _(v):
    framed = windows.training_windows(_loads(v), v.sessions, ["x"], n=20)
    out = windows.flat_matrix(framed, 1, 20)
    total = F.aggregate("matrix", F.lit(0.0), lambda a, e: a + e)
    return out.select(
        "activity_id", F.size("matrix").alias("width"), F.col("padded_rows").cast("long").alias("padded"),
        F.round(total, 4).alias("total"), F.round(F.element_at("matrix", -1), 4).alias("last"),
    )


@query("m7_hold_out_newest", """
    WITH s AS (SELECT activity_id, row_number() OVER (PARTITION BY user_id ORDER BY start_time, activity_id) - 1 AS pos,
      count(*) OVER (PARTITION BY user_id) AS n FROM sessions_v)
    SELECT activity_id, pos >= floor(n * 0.9) AS held_out FROM s""")
def _(v):
    return M.hold_out_newest(v.sessions).select("activity_id", "held_out")


@query("m8_evaluate", """
    WITH p AS (SELECT activity_id, total_calories, sport, 300.0 AS guess, 'running' AS sport_guess FROM sessions_v)
    SELECT 'calories' AS target, 'mse' AS metric, round(avg((total_calories - guess) * (total_calories - guess)), 4) AS value FROM p
    UNION ALL SELECT 'calories', 'mae', round(avg(abs(total_calories - guess)), 4) FROM p
    UNION ALL SELECT 'sport', 'accuracy', round(avg(CAST(sport = sport_guess AS DOUBLE)), 4) FROM p""")
def _(v):
    guessed = v.sessions.withColumns({"guess": F.lit(300.0), "sport_guess": F.lit("running")})
    out = M.evaluate(guessed, {"calories": ("total_calories", "guess")}, {"sport": ("sport", "sport_guess")})
    return out.withColumn("value", F.round("value", 4))


@query("m9_m11_compare_for_date_plain", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY begin_ts DESC, row_id DESC) AS age
      FROM history_v WHERE begin_ts < TIMESTAMP '2024-01-25 00:00:00')
    SELECT 'prediction' AS source, user_id, round(avg(load), 4) AS total_calories FROM r WHERE age BETWEEN 2 AND 21 GROUP BY user_id
    UNION ALL SELECT 'real', user_id, total_calories FROM sessions_v WHERE CAST(start_time AS DATE) = DATE '2024-01-25'""")
def _(v):
    date = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    rows = windows.window_for_date(_loads(v), date, n=20)
    predicted = _naive(M.collect_window(rows), "user_id")
    return M.compare_for_date(predicted, v.sessions, date)


@query("m10_m12_compare_for_last_days_plain", f"""{NAIVE}
    w AS (SELECT user_id, max(begin_ts) AS newest FROM history_v GROUP BY user_id),
    a AS (SELECT user_id, d AS days_back, date_trunc('second', newest - to_days(d)) AS anchor
      FROM w, (SELECT CAST(unnest(generate_series(0, 6)) AS INT) AS d)),
    j AS (SELECT a.user_id, a.days_back, h.load, row_number() OVER (PARTITION BY a.user_id, a.days_back ORDER BY h.pos DESC) AS rn
      FROM a LEFT JOIN h ON h.user_id = a.user_id AND h.begin_ts < a.anchor),
    c AS (SELECT h.user_id, max(h.begin_ts) AS since FROM h JOIN w ON h.user_id = w.user_id
      AND h.begin_ts < date_trunc('second', w.newest - to_days(7)) GROUP BY h.user_id)
    SELECT 'predictions' AS source, user_id, round(coalesce(avg(load), 0), 4) AS total_calories
    FROM j WHERE rn BETWEEN 2 AND 21 GROUP BY user_id, days_back
    UNION ALL SELECT 'reals', s.user_id, s.total_calories FROM sessions_v s JOIN c ON s.user_id = c.user_id
      AND date_trunc('second', s.start_time) >= date_trunc('second', c.since)""")
def _(v):
    framed = windows.windows_for_last_days(_loads(v), ["x"], 7, n=20)
    predicted = _naive(framed, "user_id")
    return M.compare_for_last_days(predicted, v.history, v.sessions, 7, begin="begin_ts")


# -- with learners (no SQL twin) ----------------------------------------------------------


def _model(v) -> M.ForecastModel:
    """The plain model over the whole tables, trained once per session and data folder."""
    key = (v.spark.sparkContext.applicationId, v.sf_dir)
    if key not in _MODELS:
        _MODELS[key] = M.train(_history(v), _named(v), CONFIG)
    return _MODELS[key]


def _matrix(v):
    model = _model(v)
    return M.training_matrix(_history(v), _named(v), model.history_encoder, model.session_encoder, CONFIG)


PAST = """
    WITH n AS (SELECT DISTINCT user_id, calendar_date FROM sleep_v),
    h AS (SELECT w.user_id, w.row_id, w.begin_ts, coalesce(w.distance, 0.0) AS distance
      FROM workouts_v w JOIN n ON w.user_id = n.user_id AND w.calendar_date = n.calendar_date)"""


@query("m1_training_matrix", f"""{PAST},
    q AS (SELECT quantile_cont(distance, 0.5) AS mid, quantile_cont(distance, 0.75) - quantile_cont(distance, 0.25) AS wide FROM h),
    s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_time, activity_id) - 1 AS session_no FROM sessions_v),
    r AS (SELECT s.user_id, s.activity_id, s.session_no, s.sport, h.row_id, (distance - mid) / wide AS d,
        row_number() OVER (PARTITION BY s.activity_id ORDER BY h.begin_ts DESC, h.row_id DESC) AS rn
      FROM q, s LEFT JOIN h ON h.user_id = s.user_id AND h.begin_ts < date_trunc('second', s.start_time)
      WHERE s.session_no >= {WINDOW})
    SELECT user_id, activity_id, session_no, CAST(count(row_id) AS INT) AS window_rows,
      CASE WHEN sport = 'running' THEN 1.0 ELSE 0.0 END AS sport_running,
      round(coalesce(avg(d), 0), 6) AS distance_mean, round(coalesce(arg_min(d, rn), 0), 6) AS distance_last
    FROM r WHERE rn <= {WINDOW} GROUP BY user_id, activity_id, session_no, sport""")
def _(v):
    out = _matrix(v)
    columns = _model(v).history_encoder.feature_columns
    cells, at = vector_to_array("features"), columns.index("distance")
    return out.select(
        "user_id", "activity_id", "session_no", "window_rows", "sport_running",
        F.round(F.get(cells, F.lit(at)), 6).alias("distance_mean"),
        F.round(F.get(cells, F.lit(len(columns) + at)), 6).alias("distance_last"),
    )


@query("m2_fit_and_predict_encoded")
def _(v):
    return _model(v).predict_encoded(_matrix(v).select("user_id", "activity_id", "features"))


@query("m3_huber_loss")
def _(v):
    learners = M.fit_learners(_matrix(v), ["max_heart_rate", "total_calories"], M.huber_loss)
    rows = [F.struct(F.lit(t).alias("target"), F.lit(float(m.intercept)).alias("intercept")) for t, m in learners.items()]
    return v.sessions.groupBy("sport").agg(F.count("*").alias("n")).select("sport", "n", F.explode(F.array(*rows)).alias("r")).select("sport", "n", "r.*")


@query("m4_separate_sport_classifier")
def _(v):
    heads = M.train(_history(v), _named(v), replace(CONFIG, softmax_heads=True))
    return heads.predict_for_last_days(_history(v), 1)


def _around(index, classes):
    """A place on a circle for each class, with some noise by activity."""
    angle = index.cast("double") * (2 * np.pi / classes)
    noise = F.pmod(F.col("activity_id") * 7919, F.lit(100)) / 500
    return F.cos(angle) + noise, F.sin(angle) - noise


@query("m4_two_softmax_heads", f"""
    SELECT activity_id, sport, CASE CAST(coalesce(benefit, 0) AS INT) {LABELS} END AS benefit FROM sessions_v
    WHERE coalesce(benefit, 0) < 8""")
def _(v):
    """Two heads from one pass; code 8 has no label that a head could learn."""
    encoder = _model(v).session_encoder
    hot = encoder.one_hot
    sport = F.array_position(F.array(*map(F.lit, SPORTS)), F.col("sport"))
    seen = F.array(*_around(sport, len(SPORTS)), *_around(F.coalesce("188", F.lit(0.0)), len(BENEFIT_LABELS)))
    given = _named(v).filter(F.coalesce("188", F.lit(0.0)) < 8).select("activity_id", array_to_vector(seen).alias("features"))
    targets = [n for c in hot.values for n in hot.names(c)]
    fitted, _ = M.fit_linear(encoder.transform(_named(v)).join(given, "activity_id"), targets, hot)
    out = hot.inverse_transform(linear.predict_each({"heads": fitted}, given))
    return out.select("activity_id", "sport", F.col("188").alias("benefit"))


@query("m1_planted_lag", f"""{NAIVE}
    s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_time, activity_id) - 1 AS i FROM sessions_v),
    r AS (SELECT s.activity_id, h.load, row_number() OVER (PARTITION BY s.activity_id ORDER BY h.pos DESC) AS rn
      FROM s LEFT JOIN h ON h.user_id = s.user_id AND h.begin_ts < date_trunc('second', s.start_time) WHERE s.i >= {WINDOW})
    SELECT activity_id, round(5 + 3 * coalesce(max(load) FILTER (WHERE rn = 17), 0)
      - 2 * coalesce(max(load) FILTER (WHERE rn = 42), 0), 3) AS predicted FROM r GROUP BY activity_id""")
def _(v):
    """What a workout owes to two single days long before: only whole windows can show it."""
    framed = windows.training_windows(_loads(v), v.sessions, ["x"], n=WINDOW, mode="asof")
    rows = windows.flat_matrix(framed, 1, WINDOW).select("activity_id", F.col("matrix").alias("features"))
    ago = {days: F.get("features", F.lit(WINDOW - days)) for days in (17, 42)}
    rows = rows.withColumn("owed", 5 + 3 * ago[17] - 2 * ago[42])
    fitted = linear.ridge(linear.grams(rows, ["owed"])[0], ["predicted"], 0.0)
    return linear.predict_each({"flat": fitted}, rows.select("activity_id", "features")).select(
        "activity_id", F.round("predicted", 3).alias("predicted"))


@query("m2_many_targets_at_once", """
    SELECT row_id, k AS target, round(k * load - (k % 5) * coalesce(avg_speed, 0.0) + k, 4) AS predicted
    FROM history_v, (SELECT unnest(range(1, 25)) AS k)""")
def _(v):
    speed = F.coalesce("avg_speed", F.lit(0.0))
    numbers = [str(k) for k in range(1, 25)]
    rows = v.history.select("row_id", F.array("load", speed).alias("features"), *[
        (int(k) * F.col("load") - int(k) % 5 * speed + int(k)).alias(k) for k in numbers
    ])
    fitted = linear.ridge(linear.grams(rows, numbers)[0], numbers, 0.0)
    out = linear.predict_each({"all": fitted}, rows.select("row_id", "features")).drop("model_name")
    found = out.unpivot("row_id", numbers, "target", "predicted")
    return found.select("row_id", F.col("target").cast("long").alias("target"), F.round("predicted", 4).alias("predicted"))


@query("m7_rounds_stop_early", """
    SELECT target, TRUE AS error_is_that_of_predictions, TRUE AS best_round_is_least, TRUE AS stopped_in_time
    FROM (SELECT unnest(['far', 'near', 'noise']) AS target) WHERE (SELECT count(*) FROM history_v) > 0""")
def _(v):
    """Held-out rows follow the rest, follow it less, or not at all."""
    speed, held = F.coalesce("avg_speed", F.lit(0.0)), (F.col("row_id") % 10 == 0).cast("int")
    targets, patience = ["near", "far", "noise"], 10
    shaken = F.pmod(F.col("row_id") * 104729, F.lit(1000)) / 10.0
    rows = v.history.select("row_id", held.alias("held_out"), F.array("load", speed).alias("features"), *[x.alias(t) for t, x in zip(
        targets, (2 * F.col("load") + 3 * speed, (2 - held * 1.5) * F.col("load") + shaken, shaken))])
    found = linear.grams(rows, targets, part="held_out")
    fitted, rounds = linear.descend(found[0], found[1], targets, rounds=50, patience=patience)
    guessed = linear.predict_each({"": replace(fitted, rows=[f"{t}_guess" for t in targets])}, rows.filter("held_out = 1"))
    def flags(t):
        curve, best = rounds.errors[t], rounds.best[t]
        error = F.avg((F.col(t) - F.col(f"{t}_guess")) ** 2)
        return F.struct(
            F.lit(t).alias("target"), (F.abs(error - curve[best]) <= 1e-6 * (1 + error)).alias("error_is_that_of_predictions"),
            F.lit(curve[best] == min(curve)).alias("best_round_is_least"),
            F.lit(len(curve) - 1 <= min(50, best + patience)).alias("stopped_in_time"),
        )
    return guessed.agg(F.array(*map(flags, targets)).alias("r")).select(F.explode("r").alias("r")).select("r.*")


@query("m5_model_per_sport")
def _(v):
    models = M.train_per_sport(_history(v), _named(v), SPORT_CONFIG)
    return M.per_model(models, _history(v))


@query("m5_models_predict_their_sport", f"""{PAST}
    SELECT DISTINCT user_id, sport, sport AS model_name FROM h,
      (SELECT unnest([{', '.join(f"'{s}'" for s in MODEL_SPORTS)}]) AS sport)""")
def _(v):
    models = M.train_per_sport(_history(v), _named(v), SPORT_CONFIG)
    return M.per_model(models, _history(v)).select("user_id", "sport", "model_name")


@query("m6_m14_train_save_load")
def _(v):
    path = f"{scratch_dir(v.spark)}/model-{uuid.uuid4().hex}"
    _model(v).save(path, v.spark)
    return M.ForecastModel.load(path, v.spark).next_activity(_history(v))


def _same(one, other):
    """Per athlete, whether two predictions agree in every column."""
    def packed(df, name):
        return df.select("user_id", F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]).alias(name))

    both = packed(one, "a").join(packed(other, "b"), "user_id")
    return both.select("user_id", F.col("a").eqNullSafe(F.col("b")).alias("same"))


@query("m14_loaded_model_predicts_the_same", f"{PAST} SELECT DISTINCT user_id, TRUE AS same FROM h")
def _(v):
    path = f"{scratch_dir(v.spark)}/model-{uuid.uuid4().hex}"
    _model(v).save(path, v.spark)
    loaded = M.ForecastModel.load(path, v.spark)
    return _same(_model(v).next_activity(_history(v)), loaded.next_activity(_history(v)))


@query("m9_m10_same_anchor", f"""{PAST},
    w AS (SELECT user_id, max(begin_ts) AS newest FROM h GROUP BY user_id)
    SELECT user_id, TRUE AS same FROM h JOIN w USING (user_id) WHERE begin_ts < date_trunc('second', newest)
    GROUP BY user_id HAVING count(*) >= 2""")
def _(v):
    history = _history(v)
    newest = history.groupBy("user_id").agg(F.max("beginTimestamp").alias("newest"))
    dated = _model(v).predict_for_date(history.join(newest, "user_id"), F.col("newest"))
    return _same(dated, _model(v).next_activity(history))


def _planted(v):
    """History rows with a linear label, and the same label with every twentieth row far off."""
    features = array_to_vector(F.array("load", F.coalesce("avg_speed", F.lit(0.0))))
    truth = 2 * F.col("load") - 5 * F.coalesce("avg_speed", F.lit(0.0)) + 7
    far = F.when(F.col("row_id") % 20 == 0, 5000.0).otherwise(0.0)
    return v.history.select("row_id", features.alias("features"), truth.alias("plain"), (truth + far).alias("spoilt"))


def _planted_predictions(v):
    """``a`` and ``b``: least squares over the label and over the spoilt one; ``c``: Huber loss over the spoilt one."""
    rows = _planted(v)
    squares = M.fit_learners(rows, ["plain", "spoilt"])
    huber = M.fit_learners(rows, ["spoilt"], M.huber_loss)
    for name, learner in (("a", squares["plain"]), ("b", squares["spoilt"]), ("c", huber["spoilt"])):
        rows = learner.setPredictionCol(name).transform(rows)
    return rows


@query("m2_m3_planted_relation", "SELECT row_id, TRUE AS squares_near, TRUE AS huber_near_despite_outliers FROM history_v")
def _(v):
    near = {"squares_near": "a", "huber_near_despite_outliers": "c"}
    rows = _planted_predictions(v)
    return rows.select("row_id", *[(F.abs(F.col(c) - F.col("plain")) < 5).alias(name) for name, c in near.items()])


@query("m3_huber_resists_outliers", "SELECT count(*) AS n, TRUE AS tenfold_closer FROM history_v")
def _(v):
    squares, huber = (F.avg(F.abs(F.col(c) - F.col("plain"))) for c in "bc")
    return _planted_predictions(v).agg(F.count("*").alias("n"), (squares > 10 * huber).alias("tenfold_closer"))


@query("m4_separable_sports", "SELECT activity_id, sport FROM sessions_v")
def _(v):
    encoder = _model(v).session_encoder
    hot = encoder.one_hot
    seen = F.array(*[F.col(c) for c in hot.names("sport")], F.col("max_heart_rate"))
    rows = encoder.transform(_named(v)).withColumn("features", array_to_vector(seen))
    found = M.fit_sport_classifier(rows, hot).transform(rows)
    sports = F.array(*[F.lit(s) for s in hot.values["sport"]])
    return found.select("activity_id", F.get(sports, F.col("sport_index").cast("int")).alias("sport"))


@query("m7_boosted_trees_with_early_stop")
def _(v):
    marked = M.hold_out_newest(_matrix(v), 0.1)
    learners = M.fit_learners(marked, ["max_heart_rate"], lambda: M.boosted_trees(5))
    out = learners["max_heart_rate"].transform(marked.filter("held_out"))
    return out.select("user_id", "activity_id", "max_heart_rate", "prediction")


@query("m9_predict_for_date")
def _(v):
    return _model(v).predict_for_date(_history(v), F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))


@query("m10_predict_for_last_days")
def _(v):
    return _model(v).predict_for_last_days(_history(v), 5)


@query("m11_compare_for_date")
def _(v):
    date = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    return M.compare_for_date(_model(v).predict_for_date(_history(v), date), _named(v), date)


@query("m12_compare_for_last_days")
def _(v):
    predicted = _model(v).predict_for_last_days(_history(v), 5).drop("days_back")
    return M.compare_for_last_days(predicted, _history(v), _named(v), 5)


@query("m13_next_activity_per_model")
def _(v):
    model = _model(v)
    matrix, targets = _matrix(v), model.session_encoder.feature_columns
    gram = linear.grams(matrix, targets)[0]
    others = {
        name: replace(model, linear=linear.ridge(gram, targets, penalty)) for name, penalty in (("firm", 0.5), ("stiff", 50.0))
    }
    return M.per_model({"plain": model} | others, _history(v))


MODELS = {"mean": (0.0, [1.0, 0.0, 0.0]), "last": (0.0, [0.0, 1.0, 0.0]), "rising": (10.0, [1.0, 0.0, 2.0])}
_SHARES = " UNION ALL ".join(
    f"SELECT '{name}' AS model_name, {a} AS a, {w[0]} AS wm, {w[1]} AS wl, {w[2]} AS wt" for name, (a, w) in MODELS.items())


@query("m13_compare_models", f"""{NAIVE}
    w AS (SELECT user_id, max(begin_ts) AS newest FROM history_v GROUP BY user_id),
    j AS (SELECT w.user_id, h.load, row_number() OVER (PARTITION BY w.user_id ORDER BY h.pos DESC) AS rn
      FROM w LEFT JOIN h ON h.user_id = w.user_id AND h.begin_ts < date_trunc('second', w.newest)),
    k AS (SELECT user_id, load, rn, count(load) OVER (PARTITION BY user_id) AS n,
        row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) AS nth FROM j WHERE rn BETWEEN 2 AND 21),
    f AS (SELECT user_id, coalesce(avg(load), 0) AS m, coalesce(arg_min(load, rn), 0) AS l,
        coalesce(sum(load) FILTER (WHERE nth > n // 2) / greatest(max(n) - max(n) // 2, 1), 0)
        - coalesce(sum(load) FILTER (WHERE nth <= n // 2) / greatest(max(n) // 2, 1), 0) AS t FROM k GROUP BY user_id),
    models AS ({_SHARES}),
    c AS (SELECT h.user_id, max(h.begin_ts) AS since FROM h JOIN w ON h.user_id = w.user_id
      AND h.begin_ts < date_trunc('second', w.newest - to_days(1)) GROUP BY h.user_id)
    SELECT 'predictions' AS source, user_id, model_name, round(a + wm * m + wl * l + wt * t, 4) AS total_calories FROM f, models
    UNION ALL SELECT 'reals', s.user_id, model_name, round(s.total_calories, 4) FROM sessions_v s JOIN c ON s.user_id = c.user_id
      AND date_trunc('second', s.start_time) >= date_trunc('second', c.since), models""")
def _(v):
    tables = {
        name: linear.LinearTargets(["total_calories"], np.array([a]), np.array([w])) for name, (a, w) in MODELS.items()
    }
    framed = windows.summarise(windows.windows_for_last_days(_loads(v), ["x"], 1, n=20), 1)
    ready = framed.select("user_id", F.concat("window_mean", "window_last", "window_trend").alias("features"))
    predicted = linear.predict_each(tables, ready)
    out = M.compare_models(predicted, v.history, v.sessions, 1, begin="begin_ts")
    return out.withColumn("total_calories", F.round("total_calories", 4))


@query("m13_compare_next")
def _(v):
    predicted = _model(v).next_activity(_history(v))
    return M.compare_for_last_days(predicted, _history(v), _named(v), 1)


@query("w7_newest_row", """
    SELECT user_id, row_id FROM (SELECT user_id, row_id, row_number() OVER (PARTITION BY user_id ORDER BY begin_ts DESC, row_id DESC) AS rn
      FROM history_v) WHERE rn = 1""")
def _(v):
    return newest_per_key(v.history, ["user_id"], "begin_ts", "row_id", 1).select("user_id", "row_id")

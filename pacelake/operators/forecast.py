"""Forecast of an athlete's next workout from the window of history rows before it.

Windows are cut from encoded history and reduced to mean, last value and trend per feature, or laid out
flat, row after row. By default all encoded session columns are fitted from one pass over these, categories as numbers
or as softmax heads; other learners are fitted per column. Predictions are decoded with the session encoder.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pacelake.functions import scalars as S
from pacelake.operators import linear, windows
from pacelake.operators.features import EncoderModel, OneHot, fit_transform, history_settings, session_settings
from pacelake.operators.merge import rows_per_model, tag_union
from pacelake.operators.ordering import newest_time, number_rows
from pacelake.schemas import MODEL_SPORTS, SESSION_STAMINA, SESSION_TIMES, WINDOW_ROWS
from pacelake.session import staged

USER = "user_id"
MAX_MODELS = 1000
PARALLEL_FITS = 4  # independent fits over one stored matrix


def squared_loss() -> LinearRegression:
    """Least squares in one pass over the data."""
    return LinearRegression(solver="normal", regParam=1e-3)


def huber_loss() -> LinearRegression:
    """Robust loss, with a scale estimated from the data."""
    return LinearRegression(loss="huber", epsilon=1.35, regParam=1e-3, maxIter=50)


def boosted_trees(rounds: int = 50) -> GBTRegressor:
    """Trees that stop early on the rows marked ``held_out``."""
    return GBTRegressor(maxIter=rounds, maxDepth=4, validationIndicatorCol="held_out", seed=7)


@dataclass
class Config:
    window_rows: int = WINDOW_ROWS
    mode: str = "reference"
    history_id: str = "row_id"
    session_id: str = "activity_id"
    begin: str = "beginTimestamp"
    start: str = "start_time"
    classify_sport: bool = False
    softmax_heads: bool = False
    flat: bool = False
    rounds: int = 50
    patience: int = 10
    history_options: dict = field(default_factory=dict)
    session_options: dict = field(default_factory=dict)


# -- training matrix -------------------------------------------------------------------


def _encode_history(encoder: EncoderModel, history: DataFrame, cfg: Config, keep: Sequence[str] = ()) -> DataFrame:
    """History rows with their encoded features as one array ``x``, and other columns to keep."""
    return _as_vectors(encoder, encoder.transform(history, keep=[cfg.begin, *keep]), cfg, keep)


def _as_vectors(encoder: EncoderModel, encoded: DataFrame, cfg: Config, keep: Sequence[str] = ()) -> DataFrame:
    return windows.feature_vector(encoded, encoder.feature_columns).select(USER, cfg.history_id, cfg.begin, *keep, "x")


def encode_history(encoder: EncoderModel, history: DataFrame, cfg: Config) -> DataFrame:
    """The encoded history from a table, so that the neighbour search runs once."""
    return staged(_encode_history(encoder, history, cfg))


def _with_features(framed: DataFrame, width: int, cfg: Config) -> DataFrame:
    """Add ``features`` and ``window_rows`` to rows with a ``window``."""
    if cfg.flat:
        flat = windows.flat_matrix(framed.withColumn("window_rows", F.size("window")), width, cfg.window_rows)
        return flat.withColumn("features", array_to_vector("matrix")).drop("matrix", "padded_rows")
    summary = windows.summarise(framed, width)
    return summary.withColumn("features", array_to_vector(F.concat("window_mean", "window_last", "window_trend")))


def _feature_count(encoder: EncoderModel, cfg: Config) -> int:
    """Length of ``features``."""
    return len(encoder.feature_columns) * (cfg.window_rows if cfg.flat else 3)


def training_matrix(
    history: DataFrame, sessions: DataFrame, history_encoder: EncoderModel, session_encoder: EncoderModel, cfg: Config,
    past: DataFrame | None = None, targets: DataFrame | None = None,
) -> DataFrame:
    """One row per session with enough history before it: ``features`` and target columns.

    ``past`` is the history as ``encode_history`` gives it and ``targets`` the encoded sessions, if these are there already.
    """
    if past is None:
        past = encode_history(history_encoder, staged(history), cfg)
    if targets is None:
        targets = staged(session_encoder.transform(sessions, keep=[cfg.start]))
    framed = windows.training_windows(
        past, targets, ["x"], begin=cfg.begin, row_id=cfg.history_id, start=cfg.start,
        session_id=cfg.session_id, n=cfg.window_rows, mode=cfg.mode,
    )
    out = _with_features(framed, len(history_encoder.feature_columns), cfg)
    return out.select(
        USER, cfg.session_id, cfg.start, "session_no", "window_rows", "features",
        *[F.col(f"`{c}`") for c in session_encoder.feature_columns],
    )


def hold_out_newest(
    df: DataFrame, share: float = 0.1, time: str = "start_time", row_id: str = "activity_id"
) -> DataFrame:
    """Mark the newest share of each athlete's rows as ``held_out``."""
    numbered = number_rows(df, [USER], [time, row_id], "_pos")
    sizes = df.groupBy(USER).agg(F.count("*").alias("_n"))
    first = F.floor(F.col("_n") * F.lit(1 - share))
    return numbered.join(sizes, USER).withColumn("held_out", F.col("_pos") >= first).drop("_pos", "_n")


# -- model -------------------------------------------------------------------------------


@dataclass
class ForecastModel:
    config: Config
    history_encoder: EncoderModel
    session_encoder: EncoderModel
    learners: dict[str, Model]
    sport_learner: LogisticRegressionModel | None = None
    linear: linear.LinearTargets | None = None
    rounds: linear.Rounds | None = None

    def predict_encoded(self, df: DataFrame) -> DataFrame:
        """One predicted column per encoded target; ``features`` stay only for learners per column."""
        if self.linear is not None:
            return linear.predict_each({"": self.linear}, df).drop("model_name")
        for target, learner in self.learners.items():
            df = learner.setPredictionCol(target).transform(df)
        if self.sport_learner is not None:
            df = _one_hot_of_index(self.sport_learner.transform(df), self.session_encoder.one_hot)
        return df

    def ready(self, windowed: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Columns to keep, and ``features`` of rows with a ``window``."""
        return _with_features(windowed, len(self.history_encoder.feature_columns), self.config).select(*keep, "features")

    def recent_windows(self, history: DataFrame, days: int) -> DataFrame:
        """(user, days_back, window): encoded windows seen from each of the last days."""
        cfg = self.config
        names = {"begin": cfg.begin, "row_id": cfg.history_id, "n": cfg.window_rows}
        past = encode_history(self.history_encoder, staged(windows.recent_rows(history, days, **names)), cfg)
        return windows.windows_for_anchors(past, windows.day_anchors(past, days, cfg.begin), ["x"], **names)

    def predict(self, windowed: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Decoded prediction for each row with a ``window``."""
        ready = self.ready(windowed, keep)
        return self.session_encoder.inverse_transform(self.predict_encoded(ready), keep)

    def predict_for_date(self, history: DataFrame, date: Column) -> DataFrame:
        """Next workout of every athlete, seen from one date; only rows of a window are encoded."""
        cfg = self.config
        # the athlete's own column of that name, if any, steps aside for the age of a row
        rows = windows.window_for_date(
            history.withColumnRenamed("age", "_own_age"), date,
            begin=cfg.begin, row_id=cfg.history_id, n=cfg.window_rows,
        ).withColumnRenamed("age", "_age").withColumnRenamed("_own_age", "age")
        past = _encode_history(self.history_encoder, staged(rows), cfg, ["_age"]).withColumnRenamed("_age", "age")
        return self.predict(collect_window(past), [USER])

    def predict_for_last_days(self, history: DataFrame, days: int = 30) -> DataFrame:
        """Next workout seen from each of the last days before the newest history row; only rows
        that a window can hold are encoded, once."""
        return self.predict(self.recent_windows(history, days), [USER, "days_back"])

    def next_activity(self, history: DataFrame) -> DataFrame:
        return self.predict_for_last_days(history, 1).drop("days_back")

    # -- storage ---------------------------------------------------------------------

    def save(self, path: str, spark: SparkSession) -> None:
        """Learners, both encoders and the settings under one folder."""
        self.history_encoder.save(f"{path}/history_encoder", spark)
        self.session_encoder.save(f"{path}/session_encoder", spark)
        names = list(self.learners)
        for i, name in enumerate(names):
            self.learners[name].write().overwrite().save(f"{path}/learners/{i}")
        if self.sport_learner is not None:
            self.sport_learner.write().overwrite().save(f"{path}/sport_learner")
        if self.linear is not None:
            self.linear.save(f"{path}/linear", spark)
        state = {
            "config": vars(self.config), "targets": names, "sport": self.sport_learner is not None,
            "linear": self.linear is not None, "rounds": asdict(self.rounds) if self.rounds else None,
        }
        text = spark.createDataFrame([(json.dumps(state),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{path}/forecast")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> ForecastModel:
        state = json.loads(spark.read.text(f"{path}/forecast").first()[0])
        return cls(
            Config(**state["config"]),
            EncoderModel.load(f"{path}/history_encoder", spark),
            EncoderModel.load(f"{path}/session_encoder", spark),
            {t: DefaultParamsReader.loadParamsInstance(f"{path}/learners/{i}", spark) for i, t in enumerate(state["targets"])},
            LogisticRegressionModel.load(f"{path}/sport_learner") if state["sport"] else None,
            linear.LinearTargets.load(f"{path}/linear", spark) if state.get("linear") else None,
            linear.Rounds(**state["rounds"]) if state.get("rounds") else None,
        )


def collect_window(rows: DataFrame) -> DataFrame:
    """(user, window) from rows with ``age``; at most one window of rows per athlete."""
    item = F.struct((-F.col("age")).alias("pos"), "x")
    return rows.groupBy(USER).agg(F.array_sort(F.collect_list(item)).alias("window"))


def _one_hot_of_index(df: DataFrame, hot: OneHot) -> DataFrame:
    found = hot.values["sport"]
    out = {
        name: (F.col("sport_index") == F.lit(float(found.index(v)))).cast("double")
        for v, name in zip(hot.shown("sport"), hot.names("sport"))
    }
    return df.withColumns(out)


def fit_sport_classifier(matrix: DataFrame, hot: OneHot) -> LogisticRegressionModel:
    """One multinomial classifier in place of a regression per sport column."""
    found = hot.values["sport"]
    index = F.lit(0.0)  # with two sports the first has no column of its own
    for v, name in zip(hot.shown("sport"), hot.names("sport")):
        index = F.when(F.col(f"`{name}`") == 1.0, F.lit(float(found.index(v)))).otherwise(index)
    labelled = matrix.select("features", index.alias("label"))
    learner = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=50, predictionCol="sport_index")
    return learner.fit(staged(labelled))


def fit_learners(
    matrix: DataFrame, targets: Sequence[str], learner: Callable = squared_loss, cut: bool = True
) -> dict[str, Model]:
    """One distributed fit per target column over the same rows, which are computed once."""
    if cut:
        matrix = staged(matrix)
    extra = ["held_out"] if "held_out" in matrix.columns else []

    def fit(target: str) -> Model:
        labelled = matrix.select("features", F.col(f"`{target}`").cast("double").alias("label"), *extra)
        return learner().fit(labelled.filter("label IS NOT NULL"))

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return dict(zip(targets, pool.map(inheritable_thread_target(fit), targets)))


def fit_linear(
    matrix: DataFrame, targets: Sequence[str], hot: OneHot | None = None, cfg: Config | None = None, width: int | None = None
) -> tuple[linear.LinearTargets, linear.Rounds | None]:
    """All targets from one pass over the matrix; ``width`` is the number of features, if that is known.

    With a column ``held_out`` the numbers are learnt in rounds that stop early on those rows, which no fit
    learns from. With ``hot`` its categories come as softmax heads.
    """
    cfg = cfg or Config()
    marked = "held_out" in matrix.columns
    found = linear.grams(matrix, targets, part="held_out" if marked else None, width=width)
    empty = linear.Gram(np.zeros_like(next(iter(found.values())).products), next(iter(found.values())).width)
    train = found.get(0, empty)
    heads = []
    for column in hot.values if hot is not None else []:
        names = hot.names(column)
        if names:
            hidden = f"{column}_{hot.values[column][0]}" if len(hot.values[column]) == 2 else None
            heads.append(linear.softmax_head(train, targets, names, hidden))
    classes = {name for head in heads for name in head.targets}
    numbers, rounds = linear.ridge(train, targets), None
    if marked and 1 in found:
        numbers, rounds = linear.descend(train, found[1], targets, cfg.rounds, cfg.patience)
    rows = [i for i, t in enumerate(targets) if t not in classes]
    numbers = linear.LinearTargets([targets[i] for i in rows], numbers.intercepts[rows], numbers.coefficients[rows])
    return linear.joined(numbers, *heads), rounds


def _fit_history(history: DataFrame, cfg: Config) -> tuple[EncoderModel, DataFrame]:
    # The history may be a join; the fit reads it often, and the imputer keeps it for later rows.
    encoder, encoded = fit_transform(staged(history), history_settings(cfg.history_id, **cfg.history_options), [cfg.begin])
    return encoder, _as_vectors(encoder, encoded, cfg)


def train(
    history: DataFrame, sessions: DataFrame, config: Config | None = None,
    learner: Callable | None = None, hold_out: float | None = None,
    encoded: tuple[EncoderModel, DataFrame] | None = None,
) -> ForecastModel:
    """Fit both encoders, cut the windows, fit all targets from one pass, or each by ``learner``.

    ``hold_out`` is the newest share of each athlete's sessions that early stopping looks at.
    ``encoded`` is a fitted history encoder with the history it encoded, to share among models.
    """
    cfg = config or Config()
    history_encoder, past = encoded or _fit_history(history, cfg)
    session_encoder, encoded_sessions = fit_transform(
        sessions, session_settings(cfg.session_id, **cfg.session_options), [cfg.start])
    matrix = training_matrix(history, sessions, history_encoder, session_encoder, cfg, past, encoded_sessions)
    targets = session_encoder.feature_columns
    one_pass = learner is None and not cfg.classify_sport
    if hold_out is not None:
        matrix = hold_out_newest(staged(matrix), hold_out, cfg.start, cfg.session_id)
    elif not one_pass:
        matrix = staged(matrix)  # learners per column read it once each
    if one_pass:
        hot = session_encoder.one_hot if cfg.softmax_heads else None
        fitted, rounds = fit_linear(matrix, targets, hot, cfg, _feature_count(history_encoder, cfg))
        return ForecastModel(cfg, history_encoder, session_encoder, {}, None, fitted, rounds)
    learner = learner or squared_loss
    sport_learner = None
    if cfg.classify_sport and len(session_encoder.one_hot.values.get("sport", [])) > 1:
        sport_columns = set(session_encoder.one_hot.names("sport"))
        sport_learner = fit_sport_classifier(matrix, session_encoder.one_hot)
        targets = [t for t in targets if t not in sport_columns]
    return ForecastModel(
        cfg, history_encoder, session_encoder, fit_learners(matrix, targets, learner, cut=False), sport_learner
    )


def train_per_sport(
    history: DataFrame, sessions: DataFrame, config: Config | None = None,
    sports: Sequence[str] = MODEL_SPORTS, learner: Callable | None = None,
) -> dict[str, ForecastModel]:
    """One model per sport, each over that sport's sessions only; the history is encoded once."""
    cfg = replace(config or Config(), classify_sport=False)
    encoded = _fit_history(history, cfg)
    out = {}
    for sport in sports:
        own = sessions.filter(F.col("sport") == sport)
        if SESSION_STAMINA in own.columns:
            own = own.withColumn(SESSION_STAMINA, S.full_stamina("sport", f"`{SESSION_STAMINA}`"))
        out[sport] = train(history, own, cfg, learner, encoded=encoded)
    return out


def train_and_save(spark: SparkSession, history: DataFrame, sessions: DataFrame, path: str, **options) -> ForecastModel:
    """The whole training job; the model comes back as it was stored."""
    train(history, sessions, **options).save(path, spark)
    return ForecastModel.load(path, spark)


# -- comparison ---------------------------------------------------------------------------


BENEFIT = "188"


def _readable(sessions: DataFrame, predicted: DataFrame, times: Sequence[str]) -> DataFrame:
    """Real sessions with the columns and types of the prediction; codes become labels as there."""
    have = set(sessions.columns)

    def shown(name: str, kind: str) -> Column:
        column = F.col(f"`{name}`")
        if name not in have:
            return F.lit(None).cast(kind).alias(name)
        if name in times:
            column = S.time_text(column)
        elif name == BENEFIT and kind == "string":
            column = S.benefit_text(column)
        return column.cast(kind).alias(name)

    return sessions.select(*[shown(name, kind) for name, kind in predicted.dtypes])


def compare_for_date(
    predicted: DataFrame, sessions: DataFrame, date: Column, start: str = "start_time",
    times: Sequence[str] = SESSION_TIMES,
) -> DataFrame:
    """Prediction beside the real sessions of that calendar day, if there were any."""
    real = sessions.filter(F.to_date(start) == F.to_date(date))
    return tag_union(prediction=predicted, real=_readable(real, predicted, times))


def compare_for_last_days(
    predicted: DataFrame, history: DataFrame, sessions: DataFrame, days: int = 30,
    begin: str = "beginTimestamp", start: str = "start_time", times: Sequence[str] = SESSION_TIMES,
) -> DataFrame:
    """Predictions beside the real sessions of the same days.

    Real sessions count from the newest history row that is older than ``days`` days
    before the newest one.
    """
    newest = newest_time(history, [USER], begin)
    limit = S.whole_second(F.col("newest") - F.make_dt_interval(days=F.lit(days)))
    limits = newest.select(USER, limit.alias("_limit"))
    older = history.select(USER, begin).join(limits, USER)
    since = newest_time(older, [USER], begin, F.col("_limit")).select(USER, S.whole_second("newest").alias("_since"))
    real = sessions.join(since, USER).filter(S.whole_second(start) >= F.col("_since")).drop("_since")
    return tag_union(predictions=predicted, reals=_readable(real, predicted, times))


def predict_models(models: dict[str, ForecastModel], history: DataFrame, days: int = 1) -> DataFrame:
    """Predictions of several models for the last days, with ``days_back`` and ``model_name``.

    Models that share a history encoder and window get their windows once and are applied in one pass.
    """
    if len(models) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models")
    shared: dict[tuple, dict[str, ForecastModel]] = {}
    for name, model in models.items():
        cfg = model.config
        together = (id(model.history_encoder), cfg.window_rows, cfg.flat) if model.linear is not None else (name,)
        shared.setdefault(together, {})[name] = model
    keys, parts = [USER, "days_back"], []
    for group in shared.values():
        one = next(iter(group.values()))
        ready = one.ready(one.recent_windows(history, days), keys)
        if one.linear is not None:
            encoded = staged(linear.predict_each({name: model.linear for name, model in group.items()}, ready))
        for name, model in group.items():
            own = encoded.filter(F.col("model_name") == name) if one.linear is not None else model.predict_encoded(ready)
            parts.append(model.session_encoder.inverse_transform(own, keys).withColumn("model_name", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def per_model(models: dict[str, ForecastModel], history: DataFrame) -> DataFrame:
    """Next workout by each of several models, tagged with the model's name."""
    return predict_models(models, history, 1).drop("days_back")


def compare_models(
    predicted: DataFrame, history: DataFrame, sessions: DataFrame, days: int = 1, **names
) -> DataFrame:
    """Each model's predictions beside the real sessions of the same days, every row with the model's name.

    ``predicted`` has ``model_name``; real rows repeat per model, of which there are few.
    """
    models, plain = predicted.select("model_name").distinct(), predicted.drop("model_name")
    reals = compare_for_last_days(plain.limit(0), history, sessions, days, **names)
    tagged = predicted.withColumn("source", F.lit("predictions"))
    return tagged.select("source", *[F.col(f"`{c}`") for c in plain.columns], "model_name").unionByName(
        rows_per_model(reals, models)
    )


def evaluate(df: DataFrame, pairs: dict[str, tuple[str, str]], classes: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(target, metric, value): squared and absolute error per number, accuracy per class."""
    rows = []

    def add(target: str, metric: str, value: Column) -> None:
        rows.append(F.struct(F.lit(target).alias("target"), F.lit(metric).alias("metric"), value.alias("value")))

    for target, (truth, guess) in pairs.items():
        gap = F.col(truth) - F.col(guess)
        add(target, "mse", F.avg(gap * gap))
        add(target, "mae", F.avg(F.abs(gap)))
    for target, (truth, guess) in (classes or {}).items():
        add(target, "accuracy", F.avg((F.col(truth) == F.col(guess)).cast("double")))
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")



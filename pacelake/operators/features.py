"""Fitted encoders: impute, scale, one-hot, time of day; and back to readable values.

``fit`` runs a few aggregate passes and keeps small statistics; ``transform`` and
``inverse_transform`` are column expressions over any number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pacelake.functions import cyclic, scalars as S
from pacelake.operators import profile
from pacelake.operators.impute import NeighbourImputer, fit_neighbour_imputer
from pacelake.operators.quantiles import exact_quantiles
from pacelake.schemas import (
    BENEFIT_LABELS, HISTORY_CATEGORIES, HISTORY_EXCLUDE, HISTORY_SPEED, HISTORY_TIMES, HISTORY_ZERO_FILL,
    IMPUTE_NEIGHBOURS, SESSION_BENEFIT, SESSION_EXCLUDE, SESSION_SPEED, SESSION_STAMINA,
    SESSION_STAMINA_FILL, SESSION_TIMES, SPARSE_SHARE,
)
from pacelake.session import staged

MAX_CATEGORIES = 1000


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


# -- robust scaling ---------------------------------------------------------------


@dataclass
class RobustScaler:
    """(x - median) / (p75 - p25) per column; the divisor is 1 where the range is 0."""

    stats: dict[str, list[float]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> RobustScaler:
        found = exact_quantiles(df, columns, profile.QUARTILES)
        return cls({c: [q[1], (q[2] - q[0]) or 1.0] for c, q in found.items() if q[1] is not None})

    @classmethod
    def fit_approximate(cls, df: DataFrame, columns: Sequence[str], accuracy: int = 10_000) -> RobustScaler:
        """One sketch pass, for tables where a small error in the quartiles does not matter."""
        sketch = [F.percentile_approx(_col(c), profile.QUARTILES, accuracy) for c in columns]
        found = dict(zip(columns, df.agg(*sketch).first()))
        return cls({c: [q[1], float(q[2] - q[0]) or 1.0] for c, q in found.items() if q is not None})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (_col(c) - F.lit(m)) / F.lit(r) for c, (m, r) in self.stats.items()})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: _col(c) * F.lit(r) + F.lit(m) for c, (m, r) in self.stats.items()})


# -- categories --------------------------------------------------------------------


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, v, n) over the non-null values of several columns, in one pass."""
    long = df.select(*[_col(c).cast("string").alias(c) for c in columns]).unpivot([], [_col(c) for c in columns], "column", "v")
    return long.filter("v IS NOT NULL").groupBy("column", "v").agg(F.count("*").alias("n"))


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column; the smallest one on a tie."""
    if not columns:
        return {}
    best = value_counts(df, columns).groupBy("column").agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("v"))
    return {r["column"]: r["v"] for r in best.collect()}


@dataclass
class OneHot:
    """0/1 column per category. With exactly two, the first has none; unknown is all 0."""

    values: dict[str, list[str]]
    fill: dict[str, str] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], fill: bool = True, limit: int = MAX_CATEGORIES) -> OneHot:
        """Sorted categories and the fill value. More than ``limit`` is an error, not a cut."""
        if not columns:
            return cls({})
        most = limit * len(columns)
        found = value_counts(df, columns).limit(most + 1).collect()
        values = {c: sorted(r["v"] for r in found if r["column"] == c) for c in columns}
        if len(found) > most or max(map(len, values.values())) > limit:
            raise ValueError(f"more than {limit} categories; one column each is not sensible")
        usual = {}
        for c in columns if fill else ():
            ranked = [(-r["n"], r["v"]) for r in found if r["column"] == c]
            usual[c] = min(ranked)[1] if ranked else None
        return cls(values, {c: v for c, v in usual.items() if v is not None})

    def shown(self, column: str) -> list[str]:
        found = self.values[column]
        return found[1:] if len(found) == 2 else found

    def names(self, column: str) -> list[str]:
        return [f"{column}_{v}" for v in self.shown(column)]

    def transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c in self.values:
            known = _col(c).cast("string")
            if c in self.fill:
                known = F.coalesce(known, F.lit(self.fill[c]))
            for v, name in zip(self.shown(c), self.names(c)):
                out[name] = F.when(known == v, F.lit(1.0)).otherwise(F.lit(0.0))
        return df.withColumns(out).drop(*self.values)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """Category of the largest value; NULL where all are 0."""
        out = {}
        for c, found in self.values.items():
            names = self.names(c)
            if not names:
                out[c] = F.lit(None).cast("string")
            elif len(found) == 2:
                out[c] = F.when(_col(names[0]) > 0.5, F.lit(found[1])).otherwise(F.lit(found[0]))
            else:
                cells = F.array(*[_col(n) for n in names])
                best = F.get(F.array(*map(F.lit, found)), F.array_position(cells, F.array_max(cells)).cast("int") - 1)
                out[c] = F.when(~F.forall(cells, lambda x: x == 0), best)
        return df.withColumns(out).drop(*[n for c in self.values for n in self.names(c)])


def missing_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add a 0/1 column per named column that tells where it is missing."""
    return df.withColumns({indicator(c): _col(c).isNull().cast("double") for c in columns})


def indicator(column: str) -> str:
    return f"missing_{column}"


def columns_with_nulls(df: DataFrame, columns: Sequence[str]) -> list[str]:
    if not columns:
        return []
    counts = df.agg(*[F.count_if(_col(c).isNull()) for c in columns]).first()
    return [c for c, n in zip(columns, counts) if n]


# -- the two encoders ----------------------------------------------------------------


@dataclass
class Settings:
    """What an encoder does with which columns."""

    keys: list[str]
    row_id: str
    block: list[str]
    exclude: list[str]
    constant: dict[str, float]
    speed: list[str]
    one_hot: list[str]
    times: list[str]
    benefit: str | None = None
    indicators: bool = False
    sparse_share: float = SPARSE_SHARE
    neighbours: int = IMPUTE_NEIGHBOURS
    max_categories: int = MAX_CATEGORIES


@dataclass
class EncoderModel:
    settings: Settings
    neighbour_columns: list[str]
    indicator_columns: list[str]
    imputer: NeighbourImputer | None
    scaler: RobustScaler
    one_hot: OneHot

    @property
    def numeric_columns(self) -> list[str]:
        """Scaled columns in output order, without indicators."""
        s = self.settings
        return [c for c in [*self.neighbour_columns, *s.speed, *s.constant] if c in self.scaler.stats]

    @property
    def feature_columns(self) -> list[str]:
        hot = [n for c in self.one_hot.values for n in self.one_hot.names(c)]
        times = [f"{c}_{part}" for c in self.settings.times for part in ("sin", "cos")]
        return [*self.numeric_columns, *map(indicator, self.indicator_columns), *hot, *times]

    def fill(self, df: DataFrame) -> DataFrame:
        """Numeric columns without missing values, indicators added, not yet scaled."""
        out = missing_indicators(df, self.indicator_columns)
        if self.imputer is not None:
            out = self.imputer.transform(out)
        return _fill_constants(out, self.settings)

    def _wanted(self, columns: Sequence[str], keep: Sequence[str]) -> tuple[list[str], list[str]]:
        """Columns that come out as they are, and those of them that are features too."""
        s = self.settings
        wanted = list(dict.fromkeys(c for c in [*s.keys, s.row_id, *s.block, *keep] if c in columns))
        used = {*self.neighbour_columns, *s.constant, *s.speed, *self.one_hot.values, *s.times}
        return wanted, [c for c in wanted if c in used]

    def _taken(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        s = self.settings
        wanted, extra = self._wanted(df.columns, keep)
        used = [*self.neighbour_columns, *s.constant, *s.speed, *self.one_hot.values, *s.times]
        return df.select(*dict.fromkeys([*wanted, *used]), *[_col(c).alias(f"_keep_{c}") for c in extra])

    def _encoded(self, filled: DataFrame, keep: Sequence[str]) -> DataFrame:
        """The rest of ``transform``, for rows that are filled already."""
        s = self.settings
        wanted, extra = self._wanted(filled.columns, keep)
        out = self.one_hot.transform(_label_benefit(self.scaler.transform(filled), s))
        out = cyclic.encode_times(out, s.times)
        kept = [_col(f"_keep_{c}").alias(c) if c in extra else _col(c) for c in wanted]
        return out.select(*kept, *[_col(c) for c in self.feature_columns])

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return self._encoded(self.fill(self._taken(df, keep)), keep)

    def inverse_transform(self, df: DataFrame, keep: Sequence[str] = (), snap: bool = False) -> DataFrame:
        """Encoded rows, such as predictions, as readable columns.

        Only the last step of each column is undone: imputed and filled values stay, the
        benefit stays a label, times come as text, indicators go. ``snap`` rounds times to whole
        seconds, where truncation could lose up to a minute to the last bit.
        """
        s = self.settings
        out = RobustScaler({c: self.scaler.stats[c] for c in self.numeric_columns}).inverse_transform(df)
        out = cyclic.decode_times(self.one_hot.inverse_transform(out), s.times, snap)
        return out.select(*keep, *[_col(c) for c in [*self.numeric_columns, *self.one_hot.values, *s.times]])

    # -- storage -----------------------------------------------------------------

    def save(self, path: str, spark: SparkSession) -> None:
        """Statistics as one JSON row, donors as Parquet."""
        import json

        state = {
            "settings": asdict(self.settings), "neighbour_columns": self.neighbour_columns,
            "indicator_columns": self.indicator_columns, "scaler": self.scaler.stats,
            "one_hot": asdict(self.one_hot), "has_imputer": self.imputer is not None,
        }
        text = spark.createDataFrame([(json.dumps(state),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{path}/statistics")
        if self.imputer is not None:
            self.imputer.donors.write.mode("overwrite").parquet(f"{path}/donors")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> EncoderModel:
        import json

        state = json.loads(spark.read.text(f"{path}/statistics").first()[0])
        settings = Settings(**state["settings"])
        imputer = None
        if state["has_imputer"]:
            imputer = NeighbourImputer(
                spark.read.parquet(f"{path}/donors"), state["neighbour_columns"], settings.block,
                settings.row_id, settings.neighbours,
            )
        return cls(
            settings, state["neighbour_columns"], state["indicator_columns"], imputer,
            RobustScaler(state["scaler"]), OneHot(**state["one_hot"]),
        )


def _fill_constants(df: DataFrame, s: Settings) -> DataFrame:
    out = {c: F.coalesce(_col(c).cast("double"), F.lit(float(v))) for c, v in s.constant.items()}
    if s.speed:
        average, maximum = s.speed
        out[average], out[maximum] = S.fill_speed(_col(average), _col(maximum))
    return df.withColumns(out)


def _label_benefit(df: DataFrame, s: Settings) -> DataFrame:
    """Missing benefit counts as code 0; codes become labels before one-hot."""
    if s.benefit is None:
        return df
    return df.withColumn(s.benefit, S.benefit_label(F.coalesce(_col(s.benefit).cast("double"), F.lit(0.0)), BENEFIT_LABELS))


def fit_encoder(df: DataFrame, settings: Settings) -> EncoderModel:
    """Fit all parts of an encoder on one table."""
    return _fit_filled(df, settings, None)[0]


def fit_transform(df: DataFrame, settings: Settings, keep: Sequence[str] = ()) -> tuple[EncoderModel, DataFrame]:
    """A fitted encoder and the table it was fitted on as ``transform`` gives it; neighbours are searched once for both."""
    model, filled = _fit_filled(df, settings, keep)
    return model, model._encoded(filled, keep)


def _fit_filled(df: DataFrame, settings: Settings, keep: Sequence[str] | None) -> tuple[EncoderModel, DataFrame]:
    """The encoder and its filled table, with what ``_encoded`` needs of it, or without ``keep`` only the scaled columns."""
    names = [*settings.keys, settings.row_id, *settings.block]
    total, nulls = profile.null_counts(df.drop(*names))
    sparse = {c for c, n in nulls.items() if n >= total * settings.sparse_share}
    present = [c for c in df.columns if c not in sparse]
    s = replace(
        settings,
        constant={c: v for c, v in settings.constant.items() if c in present},
        speed=settings.speed if set(settings.speed) <= set(present) else [],
        one_hot=[c for c in settings.one_hot if c in present],
        times=[c for c in settings.times if c in present],
        benefit=settings.benefit if settings.benefit in present else None,
    )
    apart = [*names, *settings.exclude, *s.constant, *settings.speed, *s.one_hot, settings.benefit or ""]
    neighbour = profile.numeric_columns(df.select(*present), apart)
    imputer = None
    if neighbour:
        imputer = fit_neighbour_imputer(df, neighbour, s.row_id, s.block, k=s.neighbours)
    marked = [c for c in neighbour if nulls[c]] if s.indicators else []
    categories = [s.benefit, *s.one_hot] if s.benefit else s.one_hot
    hot = OneHot.fit(_label_benefit(df, s), categories, limit=s.max_categories)
    hot.fill.pop(s.benefit, None)
    model = EncoderModel(s, neighbour, marked, imputer, RobustScaler({}), hot)
    scaled = [*neighbour, *s.speed, *s.constant, *map(indicator, marked)]
    if keep is not None:
        filled = model.fill(model._taken(df, keep))
    else:
        filled = model.fill(df).select(*[_col(c) for c in scaled]) if scaled else df
    if imputer is not None:
        filled = staged(filled)  # read often; neighbours are searched once
    return replace(model, scaler=RobustScaler.fit(filled, scaled)), filled


def fit_history_encoder(df: DataFrame, row_id: str, block: Sequence[str] = ("user_id",), **changes) -> EncoderModel:
    """Encoder of the merged history: neighbours, zero fill, speeds, two categories, times."""
    return fit_encoder(df, history_settings(row_id, block, **changes))


def history_settings(row_id: str, block: Sequence[str] = ("user_id",), **changes) -> Settings:
    settings = Settings(
        keys=["user_id"], row_id=row_id, block=list(block), exclude=list(HISTORY_EXCLUDE),
        constant=dict.fromkeys(HISTORY_ZERO_FILL, 0.0), speed=list(HISTORY_SPEED),
        one_hot=list(HISTORY_CATEGORIES), times=list(HISTORY_TIMES),
    )
    return replace(settings, **changes)


def fit_session_encoder(df: DataFrame, row_id: str, block: Sequence[str] = ("user_id",), **changes) -> EncoderModel:
    """Encoder of the sessions, the one whose output is predicted and decoded."""
    return fit_encoder(df, session_settings(row_id, block, **changes))


def session_settings(row_id: str, block: Sequence[str] = ("user_id",), **changes) -> Settings:
    settings = Settings(
        keys=["user_id"], row_id=row_id, block=list(block), exclude=list(SESSION_EXCLUDE),
        constant={SESSION_STAMINA: SESSION_STAMINA_FILL}, speed=list(SESSION_SPEED),
        one_hot=["sport"], times=list(SESSION_TIMES), benefit=SESSION_BENEFIT,
        indicators=True, sparse_share=1.0,
    )
    return replace(settings, **changes)


def fit_plain_session_encoder(df: DataFrame, row_id: str, block: Sequence[str] = ("user_id",), **changes) -> EncoderModel:
    """Earlier form: speeds and benefit as ordinary numbers, no indicators."""
    dropped = [c for c in SESSION_EXCLUDE if c not in ("total_distance", "total_descent", "total_ascent")]
    return fit_session_encoder(
        df, row_id, block, **{"exclude": dropped, "speed": [], "benefit": None, "indicators": False, **changes}
    )

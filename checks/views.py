"""Stand-in athlete tables: views over ``events``, one expression text for both engines."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

SPORT = (
    "CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'cycling' "
    "WHEN 'purchase' THEN 'swimming' WHEN 'signup' THEN 'walking' ELSE 'training' END"
)

VIEWS: dict[str, tuple[list[str], str | None]] = {
    "sessions_v": ([
        "user_id",
        "event_id AS activity_id",
        "ts AS start_time",
        "ts + INTERVAL '1' SECOND * CAST(600 + (event_id * 37) % 7200 AS INT) AS end_time",
        f"{SPORT} AS sport",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(value * 100 AS DOUBLE) END AS total_distance",
        "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(1.5 AS DOUBLE) + value / 100 END AS enhanced_avg_speed",
        "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(2.0 AS DOUBLE) + value / 80 END AS enhanced_max_speed",
        "CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(90 + event_id % 80 AS DOUBLE) END AS avg_heart_rate",
        "CAST(120 + event_id % 75 AS DOUBLE) AS max_heart_rate",
        "CAST(50 AS DOUBLE) + value * 3 AS total_calories",
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(60 + event_id % 40 AS DOUBLE) END AS avg_cadence",
        "CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(event_id % 9 AS DOUBLE) END AS benefit",
        "CASE WHEN event_type = 'purchase' THEN NULL ELSE CAST(100 - event_id % 30 AS DOUBLE) END AS stamina_begin",
        "CASE WHEN event_id % 4 = 0 THEN CAST(60 + event_id % 40 AS DOUBLE) END AS avg_power",
    ], None),
    "sleep_v": ([
        "user_id",
        "CAST(ts AS DATE) AS calendar_date",
        "event_id AS row_id",
        "ts AS start_sleep",
        "ts + INTERVAL '1' SECOND * CAST(18000 + event_id % 14400 AS INT) AS end_sleep",
        "CAST(3600 + event_id % 3600 AS BIGINT) AS deep_s",
        "CAST(9000 + event_id % 5000 AS BIGINT) AS light_s",
        "CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(event_id % 5400 AS BIGINT) END AS rem_s",
        "CAST(event_id % 900 AS BIGINT) AS awake_s",
    ], "event_type = 'view'"),
    "workouts_v": ([
        "user_id",
        "CAST(ts AS DATE) AS calendar_date",
        "event_id AS row_id",
        "ts AS begin_ts",
        "event_type AS sport_type",
        "value AS distance",
        "CASE WHEN event_id % 6 = 0 THEN NULL ELSE value / 50 END AS avg_speed",
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 40 END AS max_speed",
    ], "event_type IN ('click', 'purchase')"),
    "daily_v": ([
        "user_id", "CAST(ts AS DATE) AS calendar_date", "event_id AS row_id", "props", "value AS steps",
    ], "event_type IN ('signup', 'error')"),
    "history_v": ([
        "user_id", "event_id AS row_id", "ts AS begin_ts", "value AS load",
        "CASE WHEN event_id % 6 = 0 THEN NULL ELSE value / 50 END AS avg_speed",
    ], "event_type <> 'error'"),
    "messages_v": ([
        "user_id",
        "CAST(user_id AS STRING) AS activity_id",
        "event_id AS seq",
        "CASE event_type WHEN 'click' THEN 'RECORD' WHEN 'view' THEN 'SESSION' "
        "WHEN 'purchase' THEN 'SET' WHEN 'signup' THEN 'LENGTH' ELSE 'OTHER' END AS mesg",
        "CONCAT('{\"heart_rate\":', CAST(90 + event_id % 80 AS STRING), "
        "CASE WHEN event_id % 3 = 0 THEN '' ELSE CONCAT(',\"power\":', "
        "CAST(100 + event_id % 200 AS STRING)) END, '}') AS fields",
    ], None),
    "values_v": ([
        "user_id",
        "CAST(user_id AS STRING) AS activity_id",
        "event_id AS seq",
        "CASE event_id % 4 WHEN 0 THEN 'RECORD' WHEN 1 THEN 'SESSION' WHEN 2 THEN 'SET' ELSE 'LENGTH' END AS mesg",
        "CONCAT('{\"heart_rate\":', CAST(90 + event_id % 80 AS STRING), ',\"max_heart_rate\":', "
        "CAST(120 + event_id % 75 AS STRING), CASE WHEN event_id % 7 = 0 THEN '' ELSE CONCAT(',\"sport\":\"', event_type, '\"') END, "
        "',\"weight\":', CAST(event_id % 90 AS STRING), '.5,\"avg_speed\":', CAST(event_id % 9 AS STRING), "
        "'.25,\"stance_time\":', CAST(200 + event_id % 60 AS STRING), ',\"avg_vam\":', CAST(event_id % 30 AS STRING), "
        "'.5,\"distance\":', CAST(event_id % 5000 AS STRING), '.75}') AS fields",
    ], None),
}


class Views:
    """The stand-in views as DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/events.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if f"{name}_v" not in VIEWS:
            raise AttributeError(name)
        exprs, where = VIEWS[f"{name}_v"]
        rows = self.events.filter(where) if where else self.events
        return rows.selectExpr(*exprs)


def with_views(sql: str) -> str:
    """Put the used views in front of a SQL text as common table expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = []
    for v in used:
        exprs, where = VIEWS[v]
        ctes.append(f"{v} AS (SELECT {', '.join(exprs)} FROM events{' WHERE ' + where if where else ''})")
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {body[5:]}"
    return f"WITH {', '.join(ctes)} {body}"

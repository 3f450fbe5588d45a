"""Readers of exported files and stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

from pacelake.functions.scalars import null_if_nan
from pacelake.operators import cleaning
from pacelake.operators.merge import merge_history
from pacelake.schemas import (
    DAILY_FILE, HISTORY, HISTORY_CASTS, SESSION_CASTS, SESSIONS, SLEEP_FILE, WORKOUT_FILE,
)


NOT_FOUND = {"TABLE_OR_VIEW_NOT_FOUND", "PATH_NOT_FOUND", "SCHEMA_NOT_FOUND"}


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of floating columns as NULL, on which fills and quantiles rely."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, T.FractionalType) and not isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({c: null_if_nan(F.col(f"`{c}`")) for c in floating})


def open_schema(known: T.StructType, found: T.StructType) -> T.StructType:
    """The known fields with their types, then whatever else the files hold."""
    return T.StructType([*known.fields, *[f for f in found.fields if f.name not in known.names]])


def read_json_folder(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True
) -> DataFrame:
    """Rows of every ``*.json`` below a folder, columns united, in a known file order.

    Exports hold one array per file, which one task reads whole; ``multi_line=False``
    reads line-delimited files, which Spark can split. Folders named ``user_id=..``
    give the athlete key.
    """
    reader = spark.read.option("multiLine", multi_line).option("pathGlobFilter", "*.json")
    rows = (reader.schema(schema) if schema else reader).json(path)
    return nan_to_null(cleaning.with_file_order(rows))


def read_open_json_folder(spark: SparkSession, path: str, known: T.StructType, multi_line: bool = True) -> DataFrame:
    """Like :func:`read_json_folder`, with the columns outside ``known`` kept as they are found.

    Finding them reads the files once more.
    """
    found = spark.read.option("multiLine", multi_line).option("pathGlobFilter", "*.json").json(path).schema
    return read_json_folder(spark, path, open_schema(known, found), multi_line)


def flatten_structs(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Nested structs, but for those in ``keep``, as plain columns with dotted names."""

    def leaves(fields: Sequence[T.StructField], path: tuple[str, ...] = ()):
        for f in fields:
            if isinstance(f.dataType, T.StructType) and (path or f.name not in keep):
                yield from leaves(f.dataType.fields, (*path, f.name))
            else:
                yield (*path, f.name)

    return df.select(*[
        F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in leaves(df.schema.fields)
    ])


def read_workouts(
    spark: SparkSession, path: str, schema: T.StructType | None = WORKOUT_FILE, multi_line: bool = True
) -> DataFrame:
    """One row per workout; files without the wrapper list add no rows."""
    files = read_json_folder(spark, path, schema, multi_line)
    if "summarizedActivitiesExport" not in files.columns:
        raise ValueError(f"no workout list in {path}")
    rows = files.select(F.posexplode("summarizedActivitiesExport").alias("_at", "w"), cleaning.FILE_ORDER)
    order = F.struct(F.col(cleaning.FILE_ORDER).alias("file"), F.col("_at").alias("at")).alias(cleaning.FILE_ORDER)
    return nan_to_null(flatten_structs(rows.select("w.*", order), keep=[cleaning.FILE_ORDER]))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with header, columns found by name in any order.

    Time columns are those the schema types as timestamps. Columns outside the schema follow
    with inferred types; one of the schema that the file lacks is an error. Files without any
    line give no rows.
    """
    reader = spark.read.option("header", True)
    header = reader.csv(path).columns if not _is_blank(spark, path) else schema.names
    lacking = [c for c in schema.names if c not in header]
    if lacking:
        raise ValueError(f"no columns {lacking} in {path}")
    known = {f.name: f for f in schema}
    if set(header) - set(known):
        known = {f.name: f for f in spark.read.option("header", True).option("inferSchema", True).csv(path).schema} | known
    in_file = T.StructType([known[c] for c in header])
    rows = spark.read.option("header", True).option("enforceSchema", False).schema(in_file).csv(path)
    extra = [c for c in header if c not in schema.names]
    return nan_to_null(rows.select(*[F.col(f"`{c}`") for c in [*schema.names, *extra]]))


def _is_blank(spark: SparkSession, path: str) -> bool:
    return not spark.read.text(path).head(1)


def load_table(spark: SparkSession, table: str, casts: dict[str, str] | None = None) -> DataFrame:
    """A stored table with some columns cast."""
    df = spark.table(table)
    return nan_to_null(df.withColumns({c: F.col(c).cast(t) for c, t in (casts or {}).items()}))


def _first_source(*sources) -> DataFrame:
    problems = []
    for name, read in sources:
        try:
            return read()
        except AnalysisException as problem:
            if problem.getCondition() not in NOT_FOUND:
                raise  # the source is there, but wrong; other data must not stand in for it
            problems.append(f"{name}: {problem}")
    raise FileNotFoundError("; ".join(problems))


def load_history(
    spark: SparkSession, table: str | None = None, csv: str | None = None, raw: dict[str, str] | None = None
) -> DataFrame:
    """Merged history from the first source there is: table, CSV, or the raw exports.

    ``raw`` names the folders ``sleep``, ``workouts`` and ``daily``. Rows without a
    workout are dropped. No order is stored; operators order for themselves.
    """
    sources = []
    if table:
        sources.append((table, lambda: load_table(spark, table, HISTORY_CASTS)))
    if csv:
        sources.append((csv, lambda: read_csv(spark, csv, HISTORY)))
    if raw:
        sources.append(("raw", lambda: merge_exports(spark, **raw)))
    return _first_source(*sources).dropna(subset=["beginTimestamp"])


def load_sessions(spark: SparkSession, table: str | None = None, csv: str | None = None) -> DataFrame:
    """Device sessions from a table, else from CSV."""
    sources = []
    if table:
        sources.append((table, lambda: load_table(spark, table, SESSION_CASTS)))
    if csv:
        sources.append((csv, lambda: read_csv(spark, csv, SESSIONS)))
    return _first_source(*sources)


def merge_exports(spark: SparkSession, sleep: str, workouts: str, daily: str, multi_line: bool = True) -> DataFrame:
    """Raw export folders, cleaned and merged to one history."""
    return merge_history(
        cleaning.clean_sleep(read_json_folder(spark, sleep, SLEEP_FILE, multi_line)),
        cleaning.clean_workouts(read_workouts(spark, workouts, multi_line=multi_line)),
        cleaning.clean_daily(read_open_json_folder(spark, daily, DAILY_FILE, multi_line)),
    )

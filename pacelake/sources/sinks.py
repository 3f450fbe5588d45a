"""Writers: tables, CSV, JSON and workout samples."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pacelake.sources.readers import load_table, read_csv


def save_table(df: DataFrame, table: str, buckets: int = 0, path: str | None = None) -> None:
    """Create the schema if missing and replace the table.

    With ``buckets``, rows are bucketed by athlete, so later windows and joins on the
    athlete need no shuffle. ``path`` puts the files there instead of the warehouse.
    """
    if "." in table:
        df.sparkSession.sql(f"CREATE SCHEMA IF NOT EXISTS {table.rsplit('.', 1)[0]}")
    writer = df.write.mode("overwrite")
    if buckets:
        writer = writer.bucketBy(buckets, "user_id")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def csv_to_table(
    spark: SparkSession, path: str, schema: T.StructType, database: str | None = None, table_path: str | None = None
) -> str:
    """CSV to a table named after the file stem."""
    name = PurePosixPath(path.rstrip("/")).stem
    table = f"{database}.{name}" if database else name
    save_table(read_csv(spark, path, schema), table, path=table_path)
    return table


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; times keep their microseconds."""
    writer = df.write.mode("overwrite").option("header", True)
    writer.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)


def table_to_csv(spark: SparkSession, table: str, path: str, casts: dict[str, str] | None = None) -> None:
    write_csv(load_table(spark, table, casts), path)


def write_samples(df: DataFrame, path: str, per_workout: bool = False, folders: int = 256) -> None:
    """Samples as Parquet, near each other per workout.

    ``per_workout`` makes one folder per workout, sensible for few workouts. Otherwise
    workouts are spread over a fixed number of folders. Rows are split by range, so a
    very long workout is written by many tasks.
    """
    if per_workout:
        df.repartitionByRange("activity_id", "timestamp").write.mode("overwrite").partitionBy("activity_id").parquet(path)
        return
    spread = df.withColumn("folder", F.pmod(F.xxhash64("activity_id"), F.lit(folders)).cast("int"))
    ordered = spread.repartitionByRange("folder", "activity_id", "timestamp")
    ordered.sortWithinPartitions("folder", "activity_id", "timestamp").write.mode("overwrite").partitionBy("folder").parquet(path)


def read_samples(spark: SparkSession, path: str, activity_id: str | None = None, folders: int = 256) -> DataFrame:
    """Samples of all workouts, or of one, which reads only that workout's folder."""
    df = spark.read.parquet(path)
    if activity_id is None or "folder" not in df.columns:
        return df if activity_id is None else df.filter(F.col("activity_id") == activity_id)
    folder = F.pmod(F.xxhash64(F.lit(activity_id)), F.lit(folders)).cast("int")
    return df.filter((F.col("folder") == folder) & (F.col("activity_id") == activity_id))


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)

"""Sessions appended file by file, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from pacelake.sources.messages import all_sessions

MESSAGES = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("activity_id", T.StringType()), T.StructField("seq", T.LongType()),
    T.StructField("mesg", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
])


def append_sessions(
    spark: SparkSession, source: str, target: str, ledger: str, wide: bool = False,
    schema: T.StructType = MESSAGES, files_per_batch: int = 10_000,
) -> int:
    """Append the session rows of message files not read before; returns how many batches were written.

    ``source`` is a folder of Parquet files of decoded messages, ``ledger`` a folder that remembers which
    of them were read, ``target`` a Parquet folder for :func:`read_sessions`. All three must be shared by the
    executors. A run takes what is there in batches of bounded size and ends. If it is stopped within a batch, the
    next run writes that batch again, and readers see one of the two: no session is lost or doubled. A file is known by its
    path, so files must not change after they are written.
    """
    messages = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    run = (
        all_sessions(messages, wide).writeStream.format("parquet").option("path", target)
        .option("checkpointLocation", ledger).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return sum(1 for p in run.recentProgress if p["numInputRows"])


def read_sessions(spark: SparkSession, target: str) -> DataFrame:
    """The sessions of all batches that were finished."""
    return spark.read.parquet(target)

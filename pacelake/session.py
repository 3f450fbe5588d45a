"""Session settings and the two run-time choices that depend on the cluster."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

MAX_GROUP_ROWS = 1_000_000
"""Largest group one task may sort. Bigger groups are split by range."""

MAX_BROADCAST_ROWS = 100_000
"""Largest table that may be broadcast, checked by a bounded count."""


def build_session(app: str = "pacelake", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session, where driver and executors share one disk, may fall back to a
    folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="pacelake-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: what is read afterwards does not depend on any executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def staged(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Like a checkpoint it survives lost executors, but it is columnar and compressed, and later
    readers fetch only the columns they need.
    """
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per session.

    Workers need not run in the repository's folder or have it installed.
    """
    context = spark.sparkContext
    if getattr(context, "_pacelake_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="pacelake-"), "pacelake.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._pacelake_shipped = True


def is_small(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``rows`` rows; never reads more than that plus one."""
    return df.limit(rows + 1).count() <= rows

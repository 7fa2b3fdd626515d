"""What the operators share: words, batches and durable cuts of the lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shipping import ship

#: An Arrow batch ends at so many rows or bytes: texts may be long, and a worker holds a batch or two.
BATCH_ROWS = 2048
BATCH_BYTES = 8 << 20


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at a time, and sees to it that it has this package."""
    ship(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where the session names none and runs on this machine alone."""
    context = spark.sparkContext
    at = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Has a folder that was written deleted when the driver ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers to any more. It does so when the
    driver's garbage is collected, by itself each half an hour, which is too late for long jobs of many steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """As cut(), in compressed Parquet: for wide rows that are read more than once."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    gone_at_exit(df.sparkSession, at)
    return df.sparkSession.read.schema(df.schema).parquet(at)

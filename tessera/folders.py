"""Folders that the whole cluster sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names; in one of this machine only where the session runs on it alone."""
    at = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"

"""Gives the Python workers this package, wherever the driver imported it from."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to all workers, once in a Spark context."""
    context = spark.sparkContext
    if getattr(context, "tessera_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(home):  # imported from an archive that the workers have already
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="tessera-code-"), "tessera_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("tessera", os.path.relpath(path, home)))
    context.addPyFile(archive)
    context.tessera_shipped = True

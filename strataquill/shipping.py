"""Sending this package to executors whose Python does not have it installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the session's Python workers this package, once for each context; nothing is done if it was loaded from an archive."""
    context, here = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    if getattr(context, "_strataquill_shipped", False) or not os.path.isdir(here):
        return
    folder = tempfile.mkdtemp(prefix="strataquill-package-")
    atexit.register(shutil.rmtree, folder, True)
    staged = os.path.join(folder, "stage", os.path.basename(here))
    shutil.copytree(here, staged, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, "strataquill"), "zip", os.path.join(folder, "stage")))
    context._strataquill_shipped = True

"""What a session needs to run this package's Python code in its workers."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reachable(spark: SparkSession) -> None:
    """Put the package's folder on the path of Python workers that share the driver's files.

    On a cluster whose machines don't, ship the package with --py-files; the path then does no harm.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])

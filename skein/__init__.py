"""skein: a Spark-first engine for preparing and measuring mixed text-and-image corpora."""

from __future__ import annotations

import os


def reachable(spark) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder the driver was started in."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])

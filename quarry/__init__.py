"""A PySpark engine for building and querying a corpus memory."""

from __future__ import annotations

import os


def reachable(spark) -> None:
    """Python workers on this machine find this package wherever the driver was started; clusters get it as any package."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in known and home not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([home, *known])

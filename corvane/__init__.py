"""Web-content and fetch-route analytics on Spark."""

from __future__ import annotations

import os


def ship(spark) -> None:
    """Lets Python workers import this package from where the driver has it (on a cluster without that path, use --py-files)."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    held = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in held:
        env["PYTHONPATH"] = os.pathsep.join([root, *held])

"""spanlake: DataFrame operators for execution traces and structured logs."""

from __future__ import annotations

import os
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)


def on_workers(spark) -> None:
    """Let Python workers that are started later import this package from where the driver does.

    On a cluster without a shared install the package goes with ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])

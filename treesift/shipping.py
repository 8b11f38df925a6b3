"""Gives executors this package, for the few functions that run in Python there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if sc.applicationId in _done:
        return
    to = Path(tempfile.mkdtemp(prefix="treesift-")) / "treesift_core.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(to))
    _done.add(sc.applicationId)

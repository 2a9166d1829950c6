"""Sends this package to the executors, whose Python may not have it on its path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application; called by operators before they hand functions to Python workers."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="draftlens-code-")) / "draftlens_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    context.addPyFile(str(target))
    _done.add(context.applicationId)

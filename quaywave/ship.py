"""Makes this package importable in the executors' Python workers, wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package's sources along once per Spark context; Spark's file server carries them."""
    context = spark.sparkContext
    if getattr(context, "_quaywave_shipped", False):
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quaywave-src-")) / "quaywave_src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(str(target))
    context._quaywave_shipped = True

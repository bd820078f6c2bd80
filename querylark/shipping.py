"""Makes the package importable for Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's files to the executors, once an application, unless workers find it by their own path."""
    app = spark.sparkContext.applicationId
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _SHIPPED or any(Path(p).resolve() == ROOT for p in [*paths, os.getcwd()]):
        return
    _SHIPPED.add(app)
    out = Path(tempfile.mkdtemp(prefix="querylark-")) / "querylark.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted((ROOT / "querylark").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(out))

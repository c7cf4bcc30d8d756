"""Making the package importable where Python workers run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors through Spark's own file server, once an application.

    Not needed where the workers' path already has it.
    """
    sc = spark.sparkContext
    known = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if ROOT in known or sc.applicationId in _SHIPPED:
        return
    path = Path(tempfile.mkdtemp(prefix="spanloom-")) / "spanloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "spanloom").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)

"""The package travels to the executors with the session, so workers need no path of their own."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors this package's modules, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_attesta_shipped", False):
        return
    sc._attesta_shipped = True
    top = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="attesta-")) / "attesta.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(out))

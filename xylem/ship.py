"""Makes the package importable by Python workers wherever they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's modules to the executors, once for each SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_xylem_shipped", None) != id(sc):
        root = Path(__file__).parent
        target = Path(tempfile.mkdtemp()) / "xylem-modules.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(target))
        sc._xylem_shipped = id(sc)
    return spark

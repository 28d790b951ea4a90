"""What a session needs to run this package's Python code on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that no executor needs a checkout."""
    sc = spark.sparkContext
    if getattr(sc, "_querent_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="querent-"), "querent_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(target)
    sc._querent_shipped = True


def scratch(spark: SparkSession) -> str:
    """A folder that all executors share: spark.checkpoint.dir, else the warehouse. Never a machine's own on a cluster."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")

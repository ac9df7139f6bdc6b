"""What executors share with the driver: the package's own code, and a folder."""

from __future__ import annotations

import tempfile
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package as an archive, once per application."""
    context = spark.sparkContext
    if getattr(context, "_folia_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="folia-")) / "folia.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    context._folia_shipped = True


@cache
def _own_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="folia-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Where none is set, a temporary one on a single machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = _own_dir(spark.sparkContext.applicationId)
    return path.rstrip("/")

"""Sessions, and the package's way to executors that don't share the driver's folders."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
#: Plans rely on these; a cluster's own settings for memory and partitions are left alone.
SETTINGS = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}


def session(app: str = "loomgraph", **more: str) -> SparkSession:
    """A session with this package's settings and any of the caller's."""
    return ship(SparkSession.builder.appName(app).config(map=SETTINGS | more).getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to executors once per application, unless their Python path has it."""
    context = spark.sparkContext
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT.parent) not in paths and not getattr(context, "_loomgraph_shipped", False):
        folder = tempfile.mkdtemp(prefix="loomgraph-")
        stage = Path(folder, "stage")
        shutil.copytree(ROOT, stage / ROOT.name, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/loomgraph", "zip", stage))
        context._loomgraph_shipped = True
    return spark

"""Session settings that the library's results rest on, and shipping of the package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from tidemark.scratch import scratch_path as scratch_path

#: Needed for right results (UTC clocks) for plans that adapt to skew, or for small batches of long texts. Cluster sizes stay the cluster's business.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}

ROOT = Path(__file__).resolve().parent.parent


def ready(spark: SparkSession) -> SparkSession:
    """Applies SETTINGS; adds the package to the workers' path unless PYTHONPATH already has it."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    if str(ROOT) not in os.environ.get("PYTHONPATH", "").split(":") and not spark.conf.get("tidemark.shipped", None):
        path = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted((ROOT / "tidemark").rglob("*.py")):
                z.write(p, p.relative_to(ROOT))
        spark.sparkContext.addPyFile(str(path))
        spark.conf.set("tidemark.shipped", "true")
    return spark


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with SETTINGS; conf uses underscores for dots."""
    b = SparkSession.builder.master(master).appName("tidemark")
    for k, v in (SETTINGS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()

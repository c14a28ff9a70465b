"""Session settings, and getting this package to Python workers."""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: What the operators assume; a session that sets these differently still gives the same rows.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 400


def session(name: str = "siftwell", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once a session (a zip that Spark hands out).

    Rows here are whole texts, so Arrow batches of Spark's default number of rows would fill the workers'
    and the executors' memory; a session that has not chosen a number gets a smaller one.
    """
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(BATCH_ROWS))
    root = Path(__file__).resolve().parent
    buffer, digest = io.BytesIO(), hashlib.sha256()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(root.rglob("*.py")):
            data = p.read_bytes()
            digest.update(data)
            z.writestr(str(p.relative_to(root.parent)), data)
    name = f"siftwell-{digest.hexdigest()[:16]}.zip"
    if any(f.endswith(name) for f in spark.sparkContext.listFiles):
        return
    folder = tempfile.mkdtemp(prefix="siftwell-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it from the driver as long as that runs
    path = os.path.join(folder, name)
    Path(path).write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(path)

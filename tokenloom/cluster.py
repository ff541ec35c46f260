"""What every job needs of the cluster: this package's code on the executors and a folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Rows and bytes of an Arrow batch, where the session says nothing: whole documents come in batches of a few MB, so that
#: two Python workers and their JVM fit a small executor.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application, for Arrow functions import it there; sets ``BATCH`` where the session leaves it open."""
    for key, value in BATCH.items():
        if spark.conf.get(key, "1") == "1":  # what is asked for comes back where the session has no value
            spark.conf.set(key, value)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-tokenloom-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join(root.name, p.relative_to(root)))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where the setting is absent (single-machine tests) it is set here, once, to a fresh
    local folder; a cluster must name one that all machines see.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-tokenloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder

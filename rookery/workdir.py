"""Folders that the driver and all executors share, and this package on the Python workers' path."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

#: The folder that holds the package.
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_KEY = "spark.checkpoint.dir"
#: Bytes of an Arrow batch, where the session has no bound of its own.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def shared_base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a local master gets a folder of its own; a cluster needs the setting,
    as no folder of one machine would do."""
    base = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{_KEY} must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='rookery-')}"
        spark.conf.set(_KEY, base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path under the shared one."""
    return f"{shared_base(spark)}/engine/{uuid.uuid4().hex}-{label}"


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors, once for an application, so that Python workers find it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="rookery-"), "rookery.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "rookery")):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, ROOT))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def bounded_batches(spark: SparkSession) -> None:
    """Before large values go to Python: bounds the bytes of Arrow batches, unless the session has a bound, and sends the package to the workers."""
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    shipped(spark)

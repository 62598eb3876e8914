"""What a session needs before Python runs on executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application; they needn't have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(root)}-{sc.applicationId}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir.

    A session on one machine that names none gets one of its own; on a cluster that is an error, since executors would
    write where no one else reads.
    """
    sc = spark.sparkContext
    held = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not held:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(held)
    return held

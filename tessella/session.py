"""What a session must know of this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def share_package(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it, whatever folder the session was started in."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _HERE not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([_HERE, *filter(None, paths)])


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; a private one only where none is set, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            named = tempfile.mkdtemp(prefix="checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()

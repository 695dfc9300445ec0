"""Folders that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Tasks that write many small files: a number of their own, as adaptive execution would put their few bytes into one task.
TASKS = 64

def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; on a local master where that is unset, below a temporary one that goes with the process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="trackloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"

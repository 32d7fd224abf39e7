"""Where intermediate tables and streaming checkpoints go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """The path of a new folder under the one that ``spark.checkpoint.dir`` names.

    Every executor must reach it, so a machine-local folder stands in for a
    missing setting only in local mode.
    """
    root = spark.conf.get(SETTING, None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError(f"{SETTING} is not set: name a folder all executors reach")
        root = tempfile.mkdtemp(prefix="shelfmark-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"

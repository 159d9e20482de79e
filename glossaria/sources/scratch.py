"""Fresh folders for what a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from glossaria.sources.committed import remove


def _own(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}"
    return f"{root.rstrip('/')}/glossaria/{spark.sparkContext.applicationId}"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new place below ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs in one process."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Removes all that this application wrote to fresh folders, once no result is read from them any more."""
    remove(spark, _own(spark))

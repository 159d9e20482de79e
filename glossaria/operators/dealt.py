"""Rows of long work, dealt among all cores."""

from pyspark.sql import DataFrame

#: Tasks for each core.
TASKS = 3


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` among tasks for every core. Small rows lie in one file, which one task reads, however long each one's work takes."""
    return rows.repartition(TASKS * rows.sparkSession.sparkContext.defaultParallelism)

"""Folders of batches that count from the moment they are committed.

A batch is written to a folder of its own below ``parts``; then one row below ``commits``, in a folder of its own too, as
writers at the same time must not share one, names it. Commits are numbered, and
batches of one number, by writers at the same time, are in the order of their folders' names: so the order of batches
comes from their commits alone, and a batch of which a writer broke off midway isn't there. A batch may have a key; of
batches with the same key the first commit counts, so that sending one again changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_COMMITS = "batch long, key string, part string"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], _COMMITS)
    return spark.read.schema(_COMMITS).parquet(f"{path}/commits").select("batch", "key", "part")


def commits(spark: SparkSession, path: str) -> DataFrame:
    """batch, key, part of each batch that counts: one small row for each."""
    first = F.min(F.struct("batch", "part")).alias("first")
    return _rows(spark, path).groupBy(F.coalesce("key", "part").alias("_of"), "key").agg(first).select("first.batch", "key", "first.part")


def committed(spark: SparkSession, path: str, key: str) -> bool:
    return bool(_rows(spark, path).where(F.col("key") == key).head(1))


def commit(rows: DataFrame, path: str, key: str | None = None, form: str = "parquet") -> None:
    """Writes ``rows``, in as many files as they have partitions, and commits them. A ``key`` that counts already: nothing."""
    spark, part = rows.sparkSession, f"b{uuid.uuid4().hex}"  # no name that reads as a number
    if key is not None and committed(spark, path, key):
        return
    rows.write.format(form).save(f"{path}/parts/part={part}")
    number = (_rows(spark, path).agg(F.max("batch")).first()[0] or 0) + 1
    row = spark.range(1).select(F.lit(number).cast("long").alias("batch"), F.lit(key).cast("string").alias("key"), F.lit(part).alias("part"))
    row.coalesce(1).write.parquet(f"{path}/commits/commit={part}")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last batch."""
    last = commits(spark, path).orderBy(F.desc("batch"), F.desc("part")).first()
    if last is None:
        raise FileNotFoundError(f"nothing has been committed to {path}")
    return spark.read.parquet(f"{path}/parts/part={last['part']}")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """``commits`` with place, from 0 in their order."""
    order = Window.orderBy("batch", "part")  # one small row for each batch
    return commits(spark, path).withColumn("place", (F.row_number().over(order) - 1).cast("int"))


def every(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches that count, with batch, key, part and place."""
    rows = spark.read.option("basePath", f"{path}/parts").option("mergeSchema", "true").parquet(f"{path}/parts")
    return rows.join(numbered(spark, path), "part")


def drop_earlier(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Removes the rows of all but the last ``keep`` batches; who reads the latest one meanwhile isn't disturbed."""
    rows = commits(spark, path).orderBy(F.desc("batch"), F.desc("part")).limit(keep + 8).collect()  # those before went earlier
    for r in rows[keep:]:
        remove(spark, f"{path}/parts/part={r['part']}")

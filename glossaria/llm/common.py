"""What several operators share: the shared folder, id-ordered chunks, joins that outlive hot keys."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that one grouped task holds at a time; twice this many are usual at most.
CHUNK_BYTES = 8 << 20
#: Bytes that a row counts besides its text.
ROW_BYTES = 16
#: Ranges of ids whose bounds the driver holds, and chunks that each is cut into at most; their square bounds a broadcast.
RANGES = 2048


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``.

    Where that is unset, a temporary one, if driver and executors are one process; elsewhere that is an error, as each
    executor would write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not getattr(context, "_glossaria_dir", None):
            context._glossaria_dir = "file://" + tempfile.mkdtemp(prefix="glossaria-")
        root = context._glossaria_dir
    return f"{root.rstrip('/')}/glossaria/{spark.sparkContext.applicationId}"


#: Folders that the open ``scratch`` blocks have to remove, the innermost last.
_open: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder; the innermost ``scratch`` block removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` from a Parquet table in the shared folder: lineage ends there and no executor's loss undoes it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of the shared folder, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, all that was written inside: only what an outer block wrote, or keeps, may be read afterwards."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def settled(make: Callable[[], DataFrame], spark: SparkSession, name: str) -> tuple[str, DataFrame]:
    """``written`` for the rows that ``make`` plans, and their place; what ``make`` wrote on the way is removed at once."""
    path = new_path(spark, name)
    with scratch(spark):
        df = make()
        df.write.parquet(path)
        schema = df.schema
    return path, spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so that no other column can clash with an operator's own."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def id_chunks(docs: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int]:
    """``docs`` with ``chunk``, numbers of ranges of doc_id of about ``chunk_bytes`` of text, and the bytes of all texts.

    Chunks are numbered in ascending order. Rows of one id share a chunk and null ids form chunks of their own, after
    all others; chunks of more than twice as much text are cut further, by text and, for repeated rows, by a row number.
    The bounds are quantiles of all ids, so gaps and clusters of ids don't unbalance the chunks. Beyond RANGES chunks
    the quantiles are taken inside each of at most RANGES ranges and broadcast: RANGES * RANGES of eight bytes at most.
    """
    probabilities = [i / RANGES for i in range(1, RANGES)]
    size, bounds = docs.agg(F.sum(F.octet_length("text")), F.percentile_approx("doc_id", probabilities, max(10_000, 20 * RANGES))).first()
    size = size or 0
    n = max(1, math.ceil(size / chunk_bytes))
    fine = min(RANGES, math.ceil(n / RANGES))
    ranges = math.ceil(n / fine) if n < RANGES * RANGES else RANGES
    at = sorted({RANGES * i // ranges for i in range(1, ranges)} - {0})
    ranged = id_ranges(docs, [bounds[i - 1] for i in at] if bounds else [])
    if fine == 1:
        return _bounded(ranged, chunk_bytes), size
    probabilities = [i / fine for i in range(1, fine)]
    cuts = ranged.groupBy("chunk").agg(F.percentile_approx("doc_id", probabilities, max(10_000, 20 * fine)).alias("cuts"))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range((fine - 1).bit_length()))))
    # How many cuts lie below the id, by halving; beyond the last one there is none.
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get("cuts", at + step - 1) < F.col("doc_id"), step).otherwise(0))
    finer = ranged.join(F.broadcast(cuts), "chunk").withColumn("chunk", F.col("chunk") * fine + below).select(*docs.columns, "chunk")
    return _bounded(finer, chunk_bytes), size


def _bounded(ranged: DataFrame, chunk_bytes: int) -> DataFrame:
    """Cuts chunks of more than 2 * ``chunk_bytes`` in their order (id, text, row number) and numbers all anew."""
    sizes = ranged.groupBy("chunk").agg(F.sum(F.octet_length("text") + ROW_BYTES).alias("bytes"), F.count(F.lit(1)).alias("n"))
    large = written(sizes.where((F.col("bytes") > 2 * chunk_bytes) & (F.col("n") > 1)).select("chunk", "bytes", "n"), "large-chunks")
    total, rows = large.agg(F.sum("bytes"), F.sum("n")).first()
    if not total:
        return ranged
    parts, hot = min(rows, math.ceil(total / chunk_bytes)), F.broadcast(large.select("chunk"))
    over = ranged.join(hot, "chunk", "left_semi").withColumn("_serial", F.monotonically_increasing_id())
    dealt = over.repartitionByRange(parts, "chunk", F.asc_nulls_last("doc_id"), "text", "_serial").withColumn("_part", F.spark_partition_id())
    cut = written(dealt.drop("_serial"), "cut-chunks").select(*ranged.columns, "_part")
    every = ranged.join(hot, "chunk", "left_anti").select(*ranged.columns, F.lit(0).alias("_part")).unionByName(cut)
    counted = every.select("chunk", "_part").distinct()
    numbers = counted.select("chunk", "_part", (F.row_number().over(Window.orderBy("chunk", "_part")) - 1).alias("_number"))  # one small row for each chunk
    numbers = written(numbers, "chunk-numbers")
    numbers = F.broadcast(numbers) if numbers.count() <= RANGES * RANGES // 4 else numbers
    return every.join(numbers, ["chunk", "_part"]).withColumn("chunk", F.col("_number")).select(*ranged.columns)


def id_ranges(docs: DataFrame, bounds: list[int], column: str = "chunk") -> DataFrame:
    """``column``: numbers of ranges of doc_id by bounds that the driver holds; null ids come last."""
    if not bounds:
        return docs.withColumn(column, F.when(F.col("doc_id").isNull(), 1).otherwise(0))
    splits = sorted({-math.inf, *(float(x) + 0.5 for x in bounds), math.inf})
    numbered = docs.withColumn("chunk_key", F.col("doc_id").cast("double"))
    cut = Bucketizer(splits=splits, inputCol="chunk_key", outputCol=column, handleInvalid="keep")
    last = F.lit(len(splits))
    return cut.transform(numbered).withColumn(column, F.coalesce(F.col(column).cast("int"), last)).drop("chunk_key")


#: A class is hot from this many rows, and from one HOT_SHARE-th of all rows.
HOT_ROWS, HOT_SHARE = 10_000, 500


def join_classes(rows: DataFrame, classes: DataFrame, key: list[str], size: str, total: int) -> DataFrame:
    """``rows`` inner join ``classes`` on ``key``, where one class may hold any share of the rows.

    Classes of at least max(HOT_ROWS, total / HOT_SHARE) rows are HOT_SHARE at most, so they are broadcast;
    the rest is joined by shuffling, where no key can be large. ``size``: the classes' column of row counts.
    """
    least = max(HOT_ROWS, total / HOT_SHARE)
    hot = F.broadcast(classes.where(F.col(size) >= least))
    usual = rows.join(F.broadcast(classes.where(F.col(size) >= least).select(*key)), key, "left_anti")
    return rows.join(hot, key).unionByName(usual.join(classes.where(F.col(size) < least), key))

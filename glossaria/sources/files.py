"""Whole-file and in-memory text sources."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossaria.schema import LOG_BREAK, REQUESTS
from glossaria.sources import committed


def whole_text(spark: SparkSession, path: str, column: str = "words") -> DataFrame:
    """One row for each file: batch_id, the file's name, its text as UTF-8 with line ends made one newline, and the
    values that its folders name."""
    read = spark.read.text(path, wholetext=True)
    text = F.regexp_replace("value", "\r\n?", "\n").alias(column)
    return read.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("batch_id"), text, *(c for c in read.columns if c != "value"))


def from_strings(spark: SparkSession, rows: list[tuple[str, str]], schema: str = REQUESTS) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def required_setting(name: str) -> str:
    """A setting of the environment, on the driver only; a missing one is an error that names it."""
    return os.environ[name]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between the log's separators in its files, without what each begins with, and where it stands.

    Files are read in parts, whatever their size. Of the newline that begins a separator one is taken off each entry;
    the last entry of a file may have none.
    """
    meta, name = F.col("_metadata"), F.element_at(F.split("_metadata.file_path", "/"), -1)
    number = lambda mark: F.coalesce(F.regexp_extract(name, mark + r"-?(\d+)", 1).try_cast("int"), F.lit(0))
    read = spark.read.text(path, lineSep=LOG_BREAK.lstrip("\n"))
    place = F.struct(number("part").alias("file"), number("-c").alias("piece"), name.alias("name"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("serial"))
    pieces = read.select(*(c for c in read.columns if c != "value"), place.alias("at"), meta["file_path"].alias("path"), F.regexp_replace("value", "\n\\z", "").alias("response"))
    first = pieces.groupBy(F.col("path").alias("_path")).agg(F.min("at").alias("_first"))
    return pieces.join(first, F.col("path") == F.col("_path")).where(F.col("at") > F.col("_first")).drop("path", "_path", "_first")


def read_log_text(spark: SparkSession, path: str) -> DataFrame:
    """The entries of one text file that holds a log: response, and ``place``, by which they are in order."""
    return _pieces(spark, path).select(F.struct(F.lit(0).alias("batch"), F.lit("").alias("part"), "at").alias("place"), "response")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The entries that ``append_log`` has committed: response, and ``place``, by which they are in order: that of the
    commit, of the file among the append's, and of the entry in its file."""
    if not committed.exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], f"place {_PLACE}, response string")
    pieces = _pieces(spark, f"{path}/parts").join(committed.numbered(spark, path), "part")
    return pieces.select(F.struct("batch", "part", "at").alias("place"), "response")


_PLACE = "struct<batch: long, part: string, at: struct<file: int, piece: int, name: string, block: long, serial: long>>"


def with_positions(entries: DataFrame) -> DataFrame:
    """``entries`` with pos, their number from 0 in the order of ``place``.

    Entries are counted by stretches of files that one task reads, the stretches' counts are added up, and entries are
    numbered within their stretch: no task numbers the whole log.
    """
    stretch = F.struct("place.batch", "place.part", "place.at.file", "place.at.piece", "place.at.name", "place.at.block")
    rows = entries.withColumn("_stretch", stretch)
    sizes = rows.groupBy("_stretch").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))  # one row for each stretch
    sizes = sizes.select(F.col("_stretch").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_stretch").orderBy("place.at.serial")) - 1
    numbered = rows.withColumn("_inside", inside).join(sizes, F.col("_stretch") == F.col("_of"))
    return numbered.select((F.col("_before") + F.col("_inside")).alias("pos"), *entries.columns)


def read_package(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes, note type and deck of a written package."""
    return spark.read.parquet(f"{path}/notes"), spark.read.json(f"{path}/note_type"), spark.read.json(f"{path}/deck")

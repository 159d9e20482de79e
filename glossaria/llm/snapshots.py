"""Snapshots of a corpus that are kept, each with its static binary fuse filters, and batches screened against them.

A snapshot is a folder: ``texts``, each distinct text once by bucket, and ``filters``, one filter for each bucket. It is
never changed; a corpus grows by more snapshots. Defined cases are those of ``exact_dedup``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_classes, texts, written
from .exact_dedup import KEY, _word, digests, screened, snapshot_filters


def _with_key(source: DataFrame) -> DataFrame:
    return source.select("doc_id", "text", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("bytes"), F.xxhash64("text").alias("xx"))


def write_snapshot(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 200_000) -> None:
    """Writes the distinct texts of ``docs``, each with the largest id that has it, and their filters to ``path``."""
    source = texts(docs, id_col, text_col)
    classes = _with_key(source).groupBy(*KEY).agg(F.max("doc_id").alias("top"), F.first("text").alias("text"))
    buckets = max(1, math.ceil(source.count() / bucket_rows))
    placed = classes.withColumn("word", _word()).withColumn("bucket", F.pmod(F.col("xx"), F.lit(buckets))).withColumn("snap", F.lit(0))
    placed.write.parquet(f"{path}/texts")
    spark = docs.sparkSession
    snapshot_filters(spark.read.schema(placed.schema).parquet(f"{path}/texts")).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/filters")


def known_texts(docs: DataFrame, snapshots: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, snapshot and known_id for every row of a batch: the first as by
    ``exact_dedup`` within the batch; ``snapshot``, the place in the list of the first snapshot that has the same text
    (null: none), and ``known_id``, the largest id that has it there. A text that a snapshot has isn't kept.

    Digests meet the filter of their bucket in each snapshot; what passes joins that bucket's exact texts, and their bytes
    are compared with the batch's.
    """
    spark, source = docs.sparkSession, texts(docs, id_col, text_col)
    rows = written(digests(source), "batch-digests")
    classes = written(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id")), "batch-classes")
    shown = None
    for i, path in enumerate(snapshots):
        filters = spark.read.parquet(f"{path}/filters")
        size = filters.agg(F.max("buckets")).first()[0]
        if size is None:
            continue
        asked = classes.select(F.lit(0).alias("snap"), F.pmod(F.col("xx"), F.lit(size)).alias("bucket"), _word().alias("word"), *KEY)
        passed = screened(asked, filters.select("snap", "bucket", "filter")).select("bucket", *KEY)
        held = spark.read.parquet(f"{path}/texts").select("bucket", *KEY, "top", F.col("text").alias("_held"))
        found = passed.join(held, ["bucket", *KEY]).select(*KEY, F.lit(i).alias("snapshot"), F.col("top").alias("known_id"), "_held")
        shown = found if shown is None else shown.unionByName(found)
    if shown is None:
        same = classes.select(*KEY, F.lit(None).cast("int").alias("snapshot"), F.lit(None).cast("long").alias("known_id"))
    else:
        bodies = _with_key(source).join(shown.select(*KEY).distinct(), KEY, "left_semi").groupBy(*KEY).agg(F.min("text").alias("low"), F.max("text").alias("high"))
        equal = shown.join(bodies, KEY).where("low = _held and high = _held")
        first = equal.groupBy(*KEY).agg(F.min(F.struct("snapshot", "known_id")).alias("first"))
        same = classes.select(*KEY).join(first, KEY, "left").select(*KEY, "first.snapshot", "first.known_id")
    settled = written(classes.join(same, KEY), "batch-settled")
    out = join_classes(rows, settled, KEY, "group_size", rows.count())
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("snapshot").isNull()
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"), "snapshot", "known_id")

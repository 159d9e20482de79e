"""Exact dedup of an incoming batch against immutable snapshots, each screened by static binary fuse filters.

Digests of the batch meet the filter of their bucket in every earlier snapshot. Only what a filter lets pass
joins the snapshot's exact buckets, and only where such a join finds a partner are the texts read again and
compared byte for byte. Duplicates within one batch are grouped separately, by a plain aggregation.

Defined cases: a null text counts as empty; empty texts equal each other. Null ids sort below all others, and an
all-null group has a null keep_id. Rows that repeat both the id and the text are one document: all of them carry
``kept``. Of equal texts the row with the largest id stays. Empty tables give empty results. Extra columns are not
looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fusefilter
from .common import join_classes, texts, written

KEY = ["sha", "bytes", "xx"]
#: Document ids that are broadcast at most, about 40 bytes each.
BROADCAST_IDS = 1_500_000


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, and of the text: SHA-256, length in bytes and an independent 64-bit hash."""
    return docs.select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("bytes"), F.xxhash64("text").alias("xx"))


def _word(column: str = "sha"):
    """The first 64 bits of the digest as a signed integer; bits of their own choose the bucket."""
    return F.conv(F.substring(column, 1, 16), 16, -10).cast("long")


def snapshot_filters(classes: DataFrame) -> DataFrame:
    """(snap, bucket, filter) for rows (snap, bucket, word). A bucket has a bounded number of keys."""

    def build(key, rows):
        words = rows["word"].to_numpy().view(np.uint64)
        return pa.table({"snap": pa.array([key[0].as_py()], pa.int32()), "bucket": pa.array([key[1].as_py()], pa.int64()), "filter": [fusefilter.build(words)]})

    return classes.select("snap", "bucket", "word").groupBy("snap", "bucket").applyInArrow(build, "snap int, bucket long, filter binary")


def screened(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows of ``incoming`` (snap, bucket, word, sha, bytes, xx) that the filter of their bucket lets pass."""

    def probe(rows, filter_row):
        if filter_row.num_rows == 0:
            return rows.slice(0, 0)
        hit = fusefilter.contains(filter_row["filter"][0].as_py(), rows["word"].to_numpy().view(np.uint64))
        return rows.filter(pa.array(hit))

    by = ["snap", "bucket"]
    return incoming.groupBy(*by).cogroup(filters.groupBy(*by)).applyInArrow(probe, incoming.schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slices: int = 3, bucket_rows: int = 200_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The table is taken in as ``slices`` batches by ascending id, as a corpus grows: each is screened against the
    immutable snapshots that the earlier ones left.
    """
    source = texts(docs, id_col, text_col)
    rows = digests(source)
    bounds = source.agg(F.percentile_approx("doc_id", [i / slices for i in range(1, slices)], 10_000)).first()[0] or []
    part = F.lit(0)
    for bound in sorted(set(bounds)):
        part = part + F.when(F.col("doc_id") > bound, 1).otherwise(0)
    rows = written(rows.withColumn("part", part), "digests")

    # New-batch duplicates: grouped within their batch, before anything is compared with a snapshot.
    classes = written(rows.groupBy("part", *KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")), "classes")
    sizes = {r["part"]: (r["n"], r["rows"]) for r in classes.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("rows")).collect()}
    total = sum(n for _, n in sizes.values())
    buckets = max(1, math.ceil(max((n for n, _ in sizes.values()), default=0) / bucket_rows))
    keyed = classes.withColumn("word", _word()).withColumn("bucket", F.pmod(F.col("xx"), F.lit(buckets)))

    filters = written(snapshot_filters(keyed.where(F.col("part") < slices - 1).withColumnRenamed("part", "snap")), "filters")
    earlier = keyed.where("part > 0").select(F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("snap"), "bucket", "word", *KEY)
    positives = screened(earlier, filters)

    # The exact buckets: a positive is a duplicate only where the snapshot holds its whole key.
    exact = keyed.select(F.col("part").alias("snap"), *KEY)
    linked = written(positives.join(exact, ["snap", *KEY], "left_semi").select(*KEY).distinct(), "linked")
    same = _same_bytes(source, classes, linked)

    grouped = classes.join(same.withColumn("joined", F.lit(True)), KEY, "left").withColumn("own", F.when(F.col("joined"), F.lit(-1)).otherwise(F.col("part")))
    groups = grouped.groupBy(*KEY, "own").agg(F.sum("n").alias("group_size"), F.max("top").alias("keep_id"))
    settled = grouped.select("part", *KEY, "own").join(groups, [*KEY, "own"]).drop("own")
    out = join_classes(rows, settled, ["part", *KEY], "group_size", total)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def _same_bytes(source: DataFrame, classes: DataFrame, linked: DataFrame) -> DataFrame:
    """The keys of ``linked`` whose classes hold the same bytes in every batch: one text of each class is compared.

    Up to BROADCAST_IDS texts are picked while the table is scanned, and only they are shuffled; more join by shuffling.
    """
    chosen = written(classes.join(linked, KEY, "left_semi").select(F.col("top").alias("doc_id"), *KEY).where("doc_id is not null"), "compared")
    if chosen.count() <= BROADCAST_IDS:
        source = source.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    shown = source.join(chosen, "doc_id").where((F.sha2("text", 256) == F.col("sha")) & (F.octet_length("text") == F.col("bytes")))
    return shown.groupBy(*KEY).agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low = high").select(*KEY)

"""A corpus from raw documents to packed sequences: five stages, each an operator of ``glossaria.llm``.

Every stage takes what its predecessor kept, written as Parquet. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.llm.common import remove, settled, table
from glossaria.llm.exact_dedup import exact_dedup
from glossaria.llm.packing import packing
from glossaria.llm.quality import good_documents
from glossaria.llm.simhash import near_texts
from glossaria.llm.substring_dedup import substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labels of documents that came this far."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id stays; rows that repeat id and text are one document."""
    gone = exact_dedup(docs).where("not kept").select(F.col("doc_id").alias("gone_id"), "text_sha256")
    text = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (text == gone["text_sha256"]), "left_anti")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near fingerprints of the whole text or by the Jaccard index, the one with the smallest id stays."""
    gone = near_texts(docs).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest"))
    digest = F.unhex(F.substring(F.sha2(F.coalesce(docs["text"], F.lit("")), 256), 1, 32))
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (digest == gone["gone_digest"]), "left_anti")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occurred earlier go from the texts; documents of which nothing is left go, too."""
    others = {c: f"other{i}" for i, c in enumerate(c for c in docs.columns if c not in ("doc_id", "text"))}
    held = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(name) for c, name in others.items()))
    found = substring_dedup(held, columns=tuple(others.values()))
    left = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    values = {"doc_id": F.col("doc_id"), "text": F.col("kept")} | {c: F.col(name) for c, name in others.items()}
    if "n_chars" in values:
        values["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(values["n_chars"])
    return left.select(*(values[c].alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, in sequences."""
    return packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("simhash", near), ("substring_dedup", substrings), ("packing", packed)]

#: SQL can express neither the classifier nor the packing; tests hold each stage against plain Python on a small corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``. What a stage wrote on its way goes when its result is written, and that goes
    when the next stage's is."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path, docs = settled(partial(stage, spark, docs, sf_dir), spark, f"stage-{name}")
        if last:
            remove(spark, last)
        last = path
    return docs

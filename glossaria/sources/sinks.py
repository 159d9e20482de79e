"""Where responses, logs and decks are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.schema import LOG_BREAK, deck, note_type
from glossaria.sources import committed


def write_latest(responses: DataFrame, path: str) -> None:
    """Publishes the latest responses, unvalidated, so that they can be parsed again; ``read_latest`` reads them.

    They are written to a fresh folder, and a commit names it last: a writer that breaks off leaves the former ones."""
    committed.commit(responses, path)
    committed.drop_earlier(responses.sparkSession, path)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    return committed.latest(spark, path)


def append_log(responses: DataFrame, path: str, order: tuple[str, ...] = ("batch_id",), files: int | None = None, key: str | None = None) -> None:
    """Appends the responses to the log, in order, each after the separator; ``files.read_log`` reads them.

    The entries' place is their append's commit and their file's number, never a file's time. ``files``: into how many
    (default: as Spark deals them). ``key``: appends with the same one are one. Null responses are left out.
    """
    entries = responses.where("response is not null")
    entries = entries.repartitionByRange(files, *order).sortWithinPartitions(*order) if files else entries.orderBy(*order)
    committed.commit(entries.select(F.concat(F.lit(LOG_BREAK.lstrip("\n")), "response")), path, key, "text")


def write_package(notes: DataFrame, path: str) -> str:
    """The deck as three tables below ``path``: notes in order, note type and deck. Returns what was written."""
    ordered = notes.orderBy(*[c for c in ("batch_order", "batch_id", "pos") if c in notes.columns])
    ordered.write.mode("overwrite").parquet(f"{path}/notes")
    note_type(notes.sparkSession).write.mode("overwrite").json(f"{path}/note_type")
    deck(notes.sparkSession).write.mode("overwrite").json(f"{path}/deck")
    return f"{path}: deck written"


def add_to_deck(notes: DataFrame, path: str, batch_key: str) -> None:
    """Adds a batch of notes to the deck that lives at ``path``. A batch sent again, as after a crash, is there once;
    equal notes within a batch all stay."""
    committed.commit(notes, path, batch_key)


def read_deck(spark: SparkSession, path: str) -> DataFrame:
    """The notes of all batches with batch_order, from 0 in the order of commits, and batch_key."""
    rows = committed.every(spark, path)
    own = ("place", "key", "batch", "part")
    return rows.select(F.col("place").alias("batch_order"), F.col("key").alias("batch_key"), *[c for c in rows.columns if c not in own])

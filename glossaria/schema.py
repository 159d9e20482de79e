"""Schemas and constants of notes, note type and deck."""

from pyspark.sql import DataFrame, SparkSession

#: Field order, ids and names of note type, card template and deck, and the log's separator.
FIELDS = ("Word", "Sentences", "Meaning", "Pronunciation")
NOTE_TYPE_ID, NOTE_TYPE_NAME = 1607392319, "English Vocabulary"
TEMPLATE_NAME = "Generated English Card"
DECK_ID, DECK_NAME = 2059400110, "Generated English Words"
LOG_BREAK = "\n<break>\n"

WORD_DEFINITION = ", ".join(f"{f}: string" for f in FIELDS)
REQUESTS = "batch_id string, words string"
RESPONSES = "batch_id string, prompt_sha string, response string, received_at timestamp"


def note_type(spark: SparkSession) -> DataFrame:
    """The one-row dimension of the note type; a note has one card, as there is one template."""
    row = (NOTE_TYPE_ID, NOTE_TYPE_NAME, list(FIELDS), TEMPLATE_NAME)
    return spark.createDataFrame([row], "note_type_id long, name string, fields array<string>, template_name string")


def deck(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(DECK_ID, DECK_NAME)], "deck_id long, name string")

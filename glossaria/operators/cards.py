"""Notes to cards: one card for each note, as the note type has one template."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaria.functions.cards import back_html, front_html
from glossaria.functions.text import seeded_pick, sentence_list
from glossaria.schema import TEMPLATE_NAME


def cards(notes: DataFrame, seed: str = "") -> DataFrame:
    """``notes`` with template_name, sentence_list, chosen (null where there is no sentence), front_html and back_html.

    The sentence is chosen by ``seed`` and the word, so that every run renders the same card."""
    key = F.concat(F.lit(seed), F.col("Word")) if seed else F.col("Word")
    chosen = notes.withColumn("template_name", F.lit(TEMPLATE_NAME)).withColumn("sentence_list", sentence_list(F.col("Sentences")))
    chosen = chosen.withColumn("chosen", seeded_pick(F.col("sentence_list"), key)).withColumn("front_html", front_html(F.col("chosen")))
    return chosen.withColumn("back_html", back_html(F.col("front_html"), F.col("Pronunciation"), F.col("Meaning")))

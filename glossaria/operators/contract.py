"""What the prompt asks of a response, as checks on notes. None of them drops a row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaria.functions.forms import forms, ipa
from glossaria.functions.text import sentence_list
from glossaria.operators.dealt import dealt

SENTENCES = 4


def sentence_count_ok(sentences: Column, expected: int = SENTENCES) -> Column:
    return F.coalesce(F.size(sentence_list(sentences)) == expected, F.lit(False))


def bold_ok(sentences: Column, word: Column) -> Column:
    """Whether there are sentences and each emboldens the word itself, whatever its capitals."""
    items, bold = sentence_list(sentences), F.concat(F.lit("<strong>"), F.lower(word), F.lit("</strong>"))
    return F.coalesce((F.size(items) > 0) & F.forall(items, lambda s: F.lower(s).contains(bold)), F.lit(False))


def pronounced(pronunciation: Column) -> Column:
    return F.coalesce(pronunciation, F.lit("")) != ""


def forms_bold(sentences: Column, word: Column, listed: Column | None = None) -> Column:
    """Whether there are sentences and each emboldens the word or one of its ``forms``, whatever its capitals."""
    items, allowed = sentence_list(sentences), forms(word, listed)
    bold = lambda s: F.transform(F.regexp_extract_all(F.lower(s), F.lit("<strong>(.*?)</strong>")), F.trim)
    # The forms are named once, as the variable of a function: within that of the sentences they would be made for each.
    both = F.array(F.struct(items.alias("items"), allowed.alias("allowed")))
    every = F.get(F.transform(both, lambda x: (F.size(x["items"]) > 0) & F.forall(x["items"], lambda s: F.arrays_overlap(bold(s), x["allowed"]))), F.lit(0))
    return F.coalesce(every, F.lit(False))


def checked_forms(notes: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """``notes`` with bold_forms and is_ipa. ``listed``: (word, form), forms that no rule makes."""
    sentences, rows = F.col("Sentences"), notes
    if listed is not None:
        by_word = listed.groupBy(F.lower(F.trim("word")).alias("_head")).agg(F.collect_set("form").alias("_listed"))  # few forms of each word
        rows = notes.join(by_word, F.lower(F.trim(F.col("Word"))) == F.col("_head"), "left")
    bold = forms_bold(sentences, F.col("Word"), F.col("_listed") if listed is not None else None)
    return dealt(rows).withColumns({"bold_forms": bold, "is_ipa": ipa(F.col("Pronunciation"))}).drop("_head", "_listed")


def checked(notes: DataFrame) -> DataFrame:
    """``notes`` with four_sentences, all_bold and has_pronunciation."""
    sentences = F.col("Sentences")
    return notes.withColumns({"four_sentences": sentence_count_ok(sentences), "all_bold": bold_ok(sentences, F.col("Word")), "has_pronunciation": pronounced(F.col("Pronunciation"))})

"""Which of the words asked for got a card: answered, corrected, skipped, or not asked for at all.

Words that have no equal partner meet by deletion neighbourhoods: two words within some edits of each other become equal
when at most as many letters are taken out of each. So near words share a key, and only words that do are compared.
Those with a partner one edit away are settled first: the many keys of two edits are made for the rest only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaria.sources.scratch import fresh_folder

#: Letters from whose beginning keys are made; words that go on beyond them are told apart when they are compared.
PREFIX = 20
#: Letters of the longer word from which one edit, and from which two, are taken for a typing error.
ONE, TWO = 3, 6


def asked_words(requests: DataFrame, words: str = "words") -> DataFrame:
    """batch_id and word for each line of the requests' words that isn't blank."""
    return requests.select("batch_id", F.explode(F.split(words, "\n")).alias("word")).where(F.trim("word") != "")


def normal(word: Column) -> Column:
    return F.lower(F.trim(word))


def allowed_edits(one: Column, other: Column) -> Column:
    longer = F.greatest(F.length(one), F.length(other))
    return F.when(longer >= TWO, 2).when(longer >= ONE, 1).otherwise(0)


def _less_one(words: Column) -> Column:
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))
    return F.flatten(F.transform(F.filter(words, lambda w: w != ""), cut))


def deletion_keys(word: Column, edits: int = 2) -> Column:
    """The beginning of the word, and what is left of it without any letter, or, for two ``edits``, any two in words of at
    least TWO letters.

    A word of fewer letters has at most one edit besides the letters that a longer one has more, so one is enough there.
    """
    begin = F.array(word.substr(1, PREFIX))
    once = F.array_distinct(_less_one(begin))
    if edits == 1:
        return F.array_distinct(F.concat(begin, once))
    return F.array_distinct(F.concat(begin, once, F.when(F.length(word) >= TWO, _less_one(once)).otherwise(F.array().cast("array<string>"))))


def _written(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _nearest(open_: DataFrame, other: DataFrame, edits: int) -> DataFrame:
    """batch_id, word, the least answer that is exactly ``edits`` away, and edits; words without one are left out.

    Keys are hashed. Whatever shares one is compared where it meets, so that only partners are shuffled on. The hint is
    there as a table's size says nothing of its keys', of which a broadcast would hold all.
    """
    keyed = lambda rows, c: rows.select("batch_id", c, F.explode(F.transform(deletion_keys(F.col(c), edits), lambda k: F.xxhash64("batch_id", k))).alias("_key"))
    meet = keyed(open_, "word").join(keyed(other, "answer").hint("merge"), ["_key", "batch_id"])
    near = meet.where((F.levenshtein("word", "answer", edits) == edits) & (allowed_edits(F.col("word"), F.col("answer")) >= edits))
    return near.groupBy("batch_id", "word").agg(F.min("answer").alias("answer")).withColumn("edits", F.lit(edits))


def coverage(asked: DataFrame, notes: DataFrame, word: str = "word", answer: str = "Word") -> DataFrame:
    """batch_id, word, answer, status and edits. One row for each distinct word asked for in its batch: ``answered`` by a
    card for it, ``corrected`` by one for the nearest word that wasn't asked for, of equally near ones the least, or
    ``skipped``; and a row for each word with a card that was ``unasked`` and corrects nothing.

    Words are compared without their case and surrounding blanks. Blank or null words and null batches are left out.
    """
    want = asked.select("batch_id", normal(F.col(word)).alias("word")).where("batch_id is not null and word <> ''").distinct()
    have = notes.select("batch_id", normal(F.col(answer)).alias("answer")).where("batch_id is not null and answer <> ''").distinct()
    path = fresh_folder(asked.sparkSession, "coverage")
    same = ["batch_id", "_same"]
    words = _written(want.withColumn("_same", F.col("word")).join(have.withColumn("_same", F.col("answer")), same, "full").drop("_same"), f"{path}/words")
    open_, other = words.where("answer is null").select("batch_id", "word"), words.where("word is null").select("batch_id", "answer")
    one = _written(_nearest(open_, other, 1), f"{path}/one")
    two = _written(_nearest(open_.join(one.hint("merge"), ["batch_id", "word"], "left_anti"), other, 2), f"{path}/two")
    best = one.unionByName(two).hint("merge")
    answered = words.where("word is not null and answer is not null").select("batch_id", "word", "answer", F.lit("answered").alias("status"), F.lit(0).alias("edits"))
    rest = open_.join(best, ["batch_id", "word"], "left").select("batch_id", "word", "answer", F.when(F.col("answer").isNull(), "skipped").otherwise("corrected").alias("status"), "edits")
    unasked = other.join(best.select("batch_id", "answer").hint("merge"), ["batch_id", "answer"], "left_anti")
    unasked = unasked.select("batch_id", F.lit(None).cast("string").alias("word"), "answer", F.lit("unasked").alias("status"), F.lit(None).cast("int").alias("edits"))
    return answered.unionByName(rest).unionByName(unasked)

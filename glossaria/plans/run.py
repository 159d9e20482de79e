"""The whole run: word lists and a prompt to responses, notes, cards and a deck."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossaria.operators.cards import cards
from glossaria.operators.parse import notes, rejects
from glossaria.operators.respond import Provider, compose, log_answers, respond
from glossaria.sources.files import whole_text
from glossaria.sources.sinks import read_latest, write_latest, write_package


def make_deck(words: DataFrame, prompt: str, make_provider: Callable[[], Provider], path: str, mode: str = "failfast") -> DataFrame:
    """Asks for definitions of ``words`` (batch_id, words) and writes all results below ``path``: answers, latest, log,
    rejects, deck and cards. Returns the cards, read from there.

    The latest responses are written before they are parsed, so that ``deck_from_responses`` can parse them again. With
    mode failfast a response that can't be parsed ends the run; permissive keeps the good notes and the rejects,
    and salvage also what broken responses hold before their first error.
    """
    composed = compose(words, prompt)
    answered = respond(composed, make_provider, f"{path}/answers").select("batch_id", "prompt_sha", "response")
    write_latest(answered, f"{path}/latest")
    log_answers(composed, f"{path}/answers", f"{path}/log")
    return deck_from_responses(words.sparkSession, path, mode)


def make_deck_from_files(spark: SparkSession, words_path: str, prompt_path: str, make_provider: Callable[[], Provider], path: str, mode: str = "failfast") -> DataFrame:
    """``make_deck`` for files of words, a batch each, and the file of the prompt."""
    prompt = whole_text(spark, prompt_path, "prompt").first()["prompt"]
    return make_deck(whole_text(spark, words_path), prompt, make_provider, path, mode)


def deck_from_responses(spark: SparkSession, path: str, mode: str = "failfast") -> DataFrame:
    """The second half of the run, from the latest responses below ``path``."""
    return deck_from(read_latest(spark, f"{path}/latest"), path, mode)


def deck_from_file(spark: SparkSession, responses_path: str, path: str, mode: str = "failfast") -> DataFrame:
    """The second half of the run from saved responses, repaired by hand say: a JSON text file, or a folder of them."""
    return deck_from(whole_text(spark, responses_path, "response").select("batch_id", "response"), path, mode)


def deck_from(latest: DataFrame, path: str, mode: str = "failfast") -> DataFrame:
    """Deck and cards from responses (batch_id, response), and rejects where bad ones don't end the run."""
    spark = latest.sparkSession
    if mode != "failfast":
        rejects(latest, salvaging=mode == "salvage").write.mode("overwrite").parquet(f"{path}/rejects")
    write_package(notes(latest, mode), f"{path}/deck")
    cards(spark.read.parquet(f"{path}/deck/notes")).write.mode("overwrite").parquet(f"{path}/cards")
    return spark.read.parquet(f"{path}/cards")

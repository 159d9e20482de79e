"""Prompts, and responses through a provider."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.sources import committed
from glossaria.sources.ahead import Ahead, qualified
from glossaria.sources.files import required_setting
from glossaria.sources.sinks import append_log

Provider = Callable[[str], str]
_ANSWERS = "prompt_sha string, response string"
#: Prompts that one task asks.
CALLS = 100


def compose(requests: DataFrame, prompt: str, words: str = "words") -> DataFrame:
    """Adds model_input, prompt and words with nothing between, and prompt_sha, its digest."""
    full = F.concat(F.lit(prompt), F.col(words))
    return requests.withColumn("model_input", full).withColumn("prompt_sha", F.sha2(full, 256))


def with_key(setting: str, make: Callable[[str], Provider]) -> Callable[[], Provider]:
    """A maker of providers that get the key from the driver's environment; a missing setting is an error at once."""
    key = required_setting(setting)
    return lambda: make(key)


def answers(spark: SparkSession, path: str) -> DataFrame:
    """(prompt_sha, response, key) that ``ask`` has committed to ``path`` so far; key: the call that asked. A path where
    nothing is yet has none; one that can't be read is an error."""
    if not committed.exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], f"{_ANSWERS}, key string")
    return committed.every(spark, path).select("prompt_sha", "response", "key")


def ask(composed: DataFrame, make_provider: Callable[[], Provider], path: str, calls: int = CALLS) -> None:
    """Asks for each prompt of ``composed`` that ``path`` has no answer to, once, and commits the answers there.

    ``make_provider`` runs once in each task, so that a client is shared by its prompts. Each answer is written ahead, to
    a file of its own, before the next prompt is sent. So a task that is lost, or a run that broke off, asks again for
    one prompt of each task at most: the one whose answer wasn't written yet. The commit makes these files superfluous.
    """
    spark = composed.sparkSession
    prompts = composed.where("model_input is not null").groupBy("prompt_sha").agg(F.min("model_input").alias("model_input"))
    new = prompts.join(answers(spark, path), "prompt_sha", "left_anti")
    count = new.count()
    if not count:
        return
    uri = qualified(spark, f"{path}/ahead")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider, ahead = make_provider(), Ahead(uri)
        for rows in batches:
            got = []
            for sha, text in zip(rows["prompt_sha"], rows["model_input"], strict=True):
                if (answer := ahead.get(sha)) is None:
                    answer = provider(text)
                    ahead.put(sha, answer)
                got.append(answer)
            yield pd.DataFrame({"prompt_sha": rows["prompt_sha"], "response": got})

    committed.commit(new.repartition(math.ceil(count / calls), "prompt_sha").mapInPandas(call, _ANSWERS), path, uuid.uuid4().hex)
    committed.remove(spark, f"{path}/ahead")


def respond(composed: DataFrame, make_provider: Callable[[], Provider], path: str, calls: int = CALLS) -> DataFrame:
    """``composed`` with response, after ``ask``. Equal prompts share an answer; a null input gets a null response."""
    ask(composed, make_provider, path, calls)
    return replay(composed, answers(composed.sparkSession, path))


def log_answers(composed: DataFrame, path: str, log: str) -> None:
    """Appends to ``log`` what was answered at ``path`` and isn't there yet: an append for each call that asked, whose
    entries are in the order of the batches that asked for them. What no call asked for anew isn't logged again."""
    spark = composed.sparkSession
    runs = committed.commits(spark, path).join(committed.commits(spark, log), "key", "left_anti").orderBy("batch", "part").collect()  # one for each call not logged yet
    first = composed.groupBy("prompt_sha").agg(F.min("batch_id").alias("batch_id"))
    for run in runs:
        rows = answers(spark, path).where(F.col("key") == run["key"]).join(first, "prompt_sha", "left")
        append_log(rows, log, ("batch_id", "prompt_sha"), key=run["key"])


def replay(composed: DataFrame, recorded: DataFrame) -> DataFrame:
    """Responses recorded earlier under the same prompt digest; null where there is none. No network, no key."""
    once = recorded.groupBy("prompt_sha").agg(F.min("response").alias("response"))
    return composed.join(once, "prompt_sha", "left")

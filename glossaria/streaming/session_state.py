"""Keyed session state over a stream of card views: what is stored is shown again until a back forgets it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, event_id long, side string, chosen string"


def stream_choices(views: DataFrame, seed: str = "") -> DataFrame:
    """For rows (key, event_id, side, sentences): the sentence that each view shows.

    A stored sentence is kept while it is among the view's sentences, so notes that share a word and lists that change
    are handled; else the view draws one by its event_id. A back removes the key's state. Within a micro-batch views are
    taken in the order of event_id: a key's rows of one micro-batch are sorted in memory, so the trigger and the source's
    limit of files bound them.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("event_id")
        out = []
        for event_id, side, sentences in zip(rows["event_id"], rows["side"], rows["sentences"], strict=True):
            options = [] if sentences is None else list(sentences)
            if not stored or stored not in options:
                number = int(hashlib.md5(f"{seed}#{key[0]}#{event_id}".encode()).hexdigest()[:8], 16)
                stored = options[number % len(options)] if options else None
            out.append((key[0], event_id, side, stored))
            if side == "back":
                stored = None
        if stored:
            state.update((stored,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "event_id", "side", "chosen"])

    return views.groupBy("key").applyInPandasWithState(step, OUT, "stored string", "append", GroupStateTimeout.NoTimeout)

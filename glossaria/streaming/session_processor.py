"""Session state in event time: each view is taken by itself, in the order of its time, whenever it arrives."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glossaria.operators.state import draw

OUT = "key string, event_id long, side string, chosen string"
_VIEW = "us: long, event_id: long, side: string, sentences: array<string>"
#: What Spark's state store must be for this operator.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds whose views wait together, and views of a key that are dealt to them at a time.
WIDTH, VIEWS = 3_600_000, 50_000


class Session(StatefulProcessor):
    """Views wait, in parts by the hour of their time, until the watermark has passed it; an hour's timer, set to its first
    view, then takes all that are due one after another. So the calls of the state store are as many as parts, not views,
    and no part is written again because others come.

    The key's state is the stored sentence and when it was last seen. A session without views for ``idle_ms`` has ended:
    the next view finds nothing stored, and a timer removes what was. Without ``idle_ms`` sessions don't end.
    """

    def __init__(self, seed: str, idle_ms: int | None):
        self.seed, self.idle = seed, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "sentence string, seen long")
        self.parts = handle.getMapState("parts", "hour long", "n int")
        self.waiting = handle.getMapState("waiting", "hour long, part int", f"views array<struct<{_VIEW}>>")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        if initialState["sentence"]:
            self.stored.update((initialState["sentence"], initialState["seen"]))
            if self.idle:
                self.handle.registerTimer(initialState["seen"] + self.idle)

    def _wait(self, views: list[tuple]) -> None:
        """A new part for each hour of ``views`` (us, event_id, side, sentences)."""
        for hour, found in groupby(sorted(views, key=lambda v: v[0]), lambda v: v[0] // 1000 // WIDTH):
            part, n = list(found), self.parts.getValue((hour,))
            n = n[0] if n else 0
            self.waiting.updateValue((hour, n), (part,))
            self.parts.updateValue((hour,), (n + 1,))
            self.handle.registerTimer(part[0][0] // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        views = []
        for _, _, us, event_id, side, sentences in rows:
            views.append((us, event_id, side, list(sentences or [])))
            if len(views) == VIEWS:
                self._wait(views)
                views = []
        self._wait(views)
        return iter(())

    def _due(self, hour: int, ms: int, watermark: int) -> list[tuple]:
        """The hour's views that the watermark has passed, in order; the others wait on, as one part."""
        n = self.parts.getValue((hour,))
        if not n:
            return []
        views = sorted(tuple(v) for i in range(n[0]) for v in self.waiting.getValue((hour, i))[0])
        due = [v for v in views if v[0] // 1000 <= ms or v[0] // 1000 < watermark]
        for i in range(n[0]):
            self.waiting.removeKey((hour, i))
        self.parts.removeKey((hour,))
        if len(due) < len(views):
            self._wait(views[len(due) :])
        return due

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        state = self.stored.get()
        sentence, seen = state if state else (None, ms)
        due = self._due(ms // WIDTH, ms, timerValues.getCurrentWatermarkInMs())
        for us, event_id, side, options in due:
            if self.idle and us // 1000 - seen >= self.idle:
                sentence = None
            if not sentence or sentence not in options:
                sentence = draw(list(options), self.seed, key[0], event_id)
            yield Row(key=key[0], event_id=event_id, side=side, chosen=sentence)
            sentence, seen = None if side == "back" else sentence, us // 1000
        if self.idle and ms - seen >= self.idle:
            sentence = None
        if sentence:
            if due:
                self.stored.update((sentence, seen))
                if self.idle:
                    self.handle.registerTimer(seen + self.idle)
        elif state:
            self.stored.clear()


def session_choices(views: DataFrame, delay: str = "10 minutes", seed: str = "", idle_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """The sentence that each view of a stream (key, ts, event_id, side, sentences) shows, as ``operators.state.replayed``
    has it over a table: views count in the order of (ts, event_id), if they come no later than ``delay`` after others.

    A view is answered when the watermark has passed it; later ones than that are dropped by Spark. ``initial``: (key,
    sentence, seen), what is stored before the stream begins and when it was last seen, in milliseconds. Null keys are
    left out. Whoever starts the query must have set the state store to STORE.
    """
    rows = views.where("key is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    rows = rows.select("key", "ts", "us", "event_id", "side", "sentences")  # as handleInputRows takes them apart
    known = initial.groupBy("key") if initial is not None else None
    return rows.groupBy("key").transformWithState(Session(seed, idle_ms), OUT, "Append", "EventTime", known)

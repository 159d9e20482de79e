"""Session state of several notes of a word: stretches of views as functions, against a replay one view after another."""

import datetime
import random

import pytest

from glossaria.operators.state import Run, draw, replayed
from glossaria.streaming import session_processor
from glossaria.streaming.session_processor import STORE, session_choices

KINDS = "key string, ts long, event_id long, side string, sentences array<string>"


def made_views(n, seed, keys=("hot", "cold", "", None)):
    """Views of words with three notes each, whose lists overlap, change over time, and are empty or null at times."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        key = keys[0] if rng.random() < 0.7 else rng.choice(keys)
        start, size = rng.randrange(6), rng.choice([0, 1, 3, 4])
        lists = [None] if rng.random() < 0.05 else [[f"s{(start + j) % 8}" for j in range(size)]]
        rows.append((key, i // 3, i, "back" if rng.random() < 0.15 else "front", lists[0]))
    return rows


def one_after_another(rows, seed=""):
    stored, out = {}, {}
    for key, _, event_id, side, sentences in sorted(rows, key=lambda r: (r[1], r[2])):
        options = sentences or []
        state = stored.get(key)
        if state is None or state not in options:
            state = draw(options, seed, key, event_id)
        out[event_id] = state
        stored[key] = None if side == "back" else state
    return out


@pytest.mark.parametrize("stretch", [1, 7, 60, 10_000])
def test_replay_in_stretches(spark, stretch):
    rows = made_views(500, stretch)
    got = replayed(spark.createDataFrame(rows, KINDS).repartition(5), "s", stretch=stretch).collect()
    assert {r["event_id"]: r["chosen"] for r in got} == one_after_another(rows, "s") and len(got) == 500


def test_replay_of_little(spark):
    assert replayed(spark.createDataFrame([], KINDS)).count() == 0
    assert [r["chosen"] for r in replayed(spark.createDataFrame([("k", 1, 1, "back", None)], KINDS)).collect()] == [None]


def test_functions_of_stretches_compose():
    rng = random.Random(8)
    for _ in range(300):
        rows = [(i, rng.choice(["front", "front", "back"]), [f"s{rng.randrange(5)}" for _ in range(rng.randrange(4))]) for i in range(rng.randrange(1, 8))]
        cut = rng.randrange(len(rows) + 1)
        state = rng.choice([None, "s0", "s1", "s4", "elsewhere"])
        want, now = [], state
        for i, side, options in rows:
            now = now if now in options else draw(options, "", "k", i)
            want.append(now)
            now = None if side == "back" else now
        for part in (rows[:cut], rows[cut:]):
            run = Run("k")
            for i, side, options in part:
                shown, instead = run.view(i, side, options, "")
                assert instead.get(state, shown) == want[i]
                assert len(instead) <= len(part[0][2])
            state = run.kept.get(state, run.other) if part else state
        assert state == now


TIMED = "key string, ts timestamp, event_id long, side string, sentences array<string>"


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    yield
    spark.conf.set(name, before)


def timed(n, seed):
    return [(k, datetime.datetime.fromtimestamp(1_700_000_000 + ts, datetime.UTC), i, side, s) for k, ts, i, side, s in made_views(n, seed, ("hot", "cold", "x"))]


def stream(spark, path, **options):
    out = session_choices(spark.readStream.schema(TIMED).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), "30 seconds", "s", **options)
    query = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return query


def test_a_stream_that_restarts_equals_the_replay(spark, tmp_path, store):
    rows = timed(180, 3)
    mixed = sorted(rows, key=lambda r: (r[2] // 30, r[2] * 7919 % 30))  # out of order within 30 views, 10 seconds
    end = ("end", datetime.datetime(2030, 1, 1, tzinfo=datetime.UTC), 10_000, "front", ["s0"])
    for part in (mixed[:60], mixed[60:100]):
        spark.createDataFrame(part, TIMED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    first = stream(spark, tmp_path)
    assert sum(p["numInputRows"] > 0 for p in first.recentProgress) == 2
    early = spark.read.parquet(f"{tmp_path}/out").count()
    for part in (mixed[100:], [end]):
        spark.createDataFrame(part, TIMED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream(spark, tmp_path)
    got = {r["event_id"]: r["chosen"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    got.pop(10_000, None)
    want = {r["event_id"]: r["chosen"] for r in replayed(spark.createDataFrame(rows, TIMED), "s", stretch=20).collect()}
    assert got == want and len(got) == 180 and 0 < early < 100


def test_sessions_begin_with_a_table_and_end(spark, tmp_path, store):
    at = lambda s: datetime.datetime.fromtimestamp(1_700_000_000 + s, datetime.UTC)
    options = [f"s{i}" for i in range(50)]
    rows = [("a", at(0), 1, "front", options), ("a", at(50), 2, "front", options), ("a", at(200), 3, "front", options), ("b", at(5), 4, "front", options), ("c", at(5), 5, "front", ["z"]), ("end", at(100_000), 6, "front", ["z"])]
    spark.createDataFrame(rows, TIMED).coalesce(1).write.parquet(f"{tmp_path}/in")
    known = spark.createDataFrame([("a", "s7", 1_699_999_990_000), ("b", "s8", 1_699_999_000_000), ("c", "s9", 1_699_999_990_000), ("d", "s9", 1_699_999_990_000)], "key string, sentence string, seen long")
    stream(spark, tmp_path, idle_ms=60_000, initial=known)
    got = {r["event_id"]: r["chosen"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got[1] == got[2] == "s7" and got[3] == draw(options, "s", "a", 3) and got[4] == draw(options, "s", "b", 4) and got[5] == "z"
    spark.createDataFrame([("end", at(200_000), 7, "front", ["z"])], TIMED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream(spark, tmp_path, idle_ms=60_000, initial=known)  # timers set by timers go off in the next batch
    left = spark.read.format("statestore").option("stateVarName", "stored").load(f"{tmp_path}/state").collect()
    assert [r["key"]["key"] for r in left] in ([], ["end"])  # timers removed what sessions had left


class Store:
    """The state of one key, in memory, with the number of calls."""

    def __init__(self):
        self.calls, self.timers, self.maps, self.value = 0, set(), {}, None

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def getValueState(self, *_):
        return ValueOf(self)

    def getMapState(self, name, *_):
        return MapOf(self, self.maps.setdefault(name, {}))


class ValueOf:
    def __init__(self, store):
        self.store = store

    def get(self):
        self.store.calls += 1
        return self.store.value

    def update(self, value):
        self.store.calls += 1
        self.store.value = value

    def clear(self):
        self.update(None)


class MapOf:
    def __init__(self, store, held):
        self.store, self.held = store, held

    def getValue(self, key):
        self.store.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.store.calls += 1
        self.held[key] = value

    def removeKey(self, key):
        self.store.calls += 1
        self.held.pop(key, None)


class At:
    def __init__(self, ms):
        self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms


def test_calls_of_the_state_store_are_fewer_than_views(monkeypatch):
    """Batches of views that come late and out of order, and watermarks that cut hours: the replay's sentences, by few calls."""
    monkeypatch.setattr(session_processor, "VIEWS", 300)
    rng, store, got = random.Random(5), Store(), {}
    rows = [(k, ts * 20_000, i, side, s) for k, ts, i, side, s in made_views(4000, 5, ("hot",))]  # 20 seconds apart, in ms
    session = session_processor.Session("s", None)
    session.init(store)
    mixed = sorted(rows, key=lambda r: r[1] + rng.randrange(3_000_000))
    for at in range(0, len(mixed), 1000):
        session.handleInputRows(("hot",), iter([(k, None, ms * 1000 + 7, i, side, s) for k, ms, i, side, s in mixed[at : at + 1000]]), None)
        watermark = mixed[at + 1000][1] - 3_000_000 if at + 1000 < len(mixed) else 1 << 60
        for ms in sorted(t for t in store.timers if t < watermark):
            store.timers.discard(ms)
            for r in session.handleExpiredTimer(("hot",), At(watermark), At(ms)):
                got[r["event_id"]] = r["chosen"]
    assert got == one_after_another(rows, "s") and not store.maps["waiting"] and not store.maps["parts"]
    assert store.calls < len(rows) / 4

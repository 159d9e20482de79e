"""The log, the latest responses, the deck and the answers: order, broken writers, several writers, calls after a crash."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from glossaria.operators.respond import answers, ask, compose, log_answers
from glossaria.sources import committed, files, sinks


def entries(spark, path):
    rows = files.with_positions(files.read_log(spark, path)).orderBy("place").collect()
    assert [r["pos"] for r in rows] == list(range(len(rows)))
    return [r["response"] for r in rows]


def responses(spark, ids):
    return spark.createDataFrame([(f"{i:06}", f"r{i}\n" if i % 7 else "") for i in ids], "batch_id string, response string")


def test_a_log_of_many_files_keeps_its_order(spark, tmp_path):
    path = str(tmp_path)
    for k in range(3):
        rows = responses(spark, range(400 * k, 400 * k + 400)).orderBy(F.desc("batch_id"))
        sinks.append_log(rows, path, files=5)
    for place in (tmp_path / "parts").rglob("part-*"):  # order must not come from the files' times
        number = int(place.name[5:10])
        os.utime(place, (2_000_000_000 - number, 2_000_000_000 - number))
    assert len(list((tmp_path / "parts").rglob("part-*.txt"))) == 15
    assert entries(spark, path) == [f"r{i}\n" if i % 7 else "" for i in range(1200)]


def test_a_large_file_is_read_in_parts(spark, tmp_path):
    sinks.append_log(spark.range(3000).select(F.format_string("%06d", "id").alias("batch_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 50)).alias("response")), str(tmp_path), files=2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert files.read_log(spark, str(tmp_path)).rdd.getNumPartitions() > 20
        assert entries(spark, str(tmp_path)) == [f"{i}{'x' * 50}" for i in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_two_writers_of_a_log(spark, tmp_path):
    path, failed = str(tmp_path), []

    def write(name):
        try:
            for k in range(4):
                rows = spark.createDataFrame([(f"{i:03}", f"{name}{k}-{i}") for i in range(30)], "batch_id string, response string")
                sinks.append_log(rows, path, files=4)
        except Exception as error:
            failed.append(error)

    writers = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed
    got = entries(spark, path)
    appends = [got[i : i + 30] for i in range(0, 240, 30)]
    assert len(got) == 240 and all(a == [f"{a[0][:2]}-{i}" for i in range(30)] for a in appends)
    for name in "ab":
        assert [a[0][:2] for a in appends if a[0][0] == name] == [f"{name}{k}" for k in range(4)]


def test_a_writer_that_breaks_off_leaves_what_was_there(spark, tmp_path):
    bad = spark.range(100).select(F.lit("9").alias("batch_id"), F.when(F.col("id") < 99, "x").otherwise(F.raise_error(F.lit("lost")).cast("string")).alias("response"))
    log, latest, deck = (str(tmp_path / n) for n in ("log", "latest", "deck"))
    sinks.append_log(responses(spark, [1]), log)
    sinks.write_latest(responses(spark, [1, 2]), latest)
    sinks.add_to_deck(responses(spark, [1, 2, 2]), deck, "first")
    for broken in (lambda: sinks.append_log(bad, log), lambda: sinks.write_latest(bad, latest), lambda: sinks.add_to_deck(bad, deck, "second")):
        with pytest.raises(Exception, match="lost"):
            broken()
    (tmp_path / "log" / "parts" / "part=half").mkdir()
    (tmp_path / "log" / "parts" / "part=half" / "part-00000.txt").write_text("<break>\nhalf")  # written, never committed
    assert entries(spark, log) == ["r1\n"]
    assert sorted(r["batch_id"] for r in sinks.read_latest(spark, latest).collect()) == ["000001", "000002"]
    assert sinks.read_deck(spark, deck).count() == 3


def test_latest_responses_are_those_published_last(spark, tmp_path):
    path = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        sinks.read_latest(spark, path)
    for i in range(5):
        sinks.write_latest(responses(spark, [i]), path)
        assert [r["batch_id"] for r in sinks.read_latest(spark, path).collect()] == [f"{i:06}"]
    assert len(list((tmp_path / "parts").iterdir())) == 2  # the last and the one before


def test_a_deck_lives_on(spark, tmp_path):
    path = str(tmp_path)
    for key, ids in (("b", [1, 1, 2]), ("a", [3]), ("b", [1, 1, 2]), ("c", [1])):
        sinks.add_to_deck(responses(spark, ids), path, key)
    again = spark.newSession()
    rows = sinks.read_deck(again, path).orderBy("batch_order", "batch_id").collect()
    assert [(r["batch_order"], r["batch_key"], r["batch_id"]) for r in rows] == [(0, "b", "000001"), (0, "b", "000001"), (0, "b", "000002"), (1, "a", "000003"), (2, "c", "000001")]
    part = sinks.committed.commits(spark, path).where("key = 'c'").first()["part"]  # two writers of one key: the first commit counts
    spark.createDataFrame([(9, "c", "another")], "batch long, key string, part string").coalesce(1).write.parquet(f"{path}/commits/commit=another")
    assert committed.commits(spark, path).where("key = 'c'").first()["part"] == part


def asked(folder):
    return sorted(line for place in folder.iterdir() for line in place.read_text().split())


def counting(folder, fatal_after=None):
    """A provider that notes each call in a file of its process, and kills that process after some calls."""

    def make():
        seen = []

        def provide(text):
            seen.append(text)
            if fatal_after is not None and len(seen) > fatal_after:
                os._exit(1)
            with open(folder / str(os.getpid()), "a") as out:
                out.write(text[2:] + "\n")
            return f"answer {text}"

        return provide

    return make


def test_a_killed_task_asks_again_for_one_prompt_at_most(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    composed = compose(files.from_strings(spark, [(f"{i:02}", str(i)) for i in range(30)]), "P:")
    path = str(tmp_path / "answers")
    with pytest.raises(Exception, match="(?i)worker|crash|EOF"):
        ask(composed, counting(calls, 11), path)
    before = asked(calls)
    assert 11 <= len(before) < 30 and answers(spark, path).count() == 0
    ask(composed, counting(calls), path)
    assert sorted(set(asked(calls))) == sorted(map(str, range(30))) and len(asked(calls)) <= 31
    assert answers(spark, path).count() == 30 and not (tmp_path / "answers" / "ahead").exists()
    ask(composed, counting(calls), path)
    assert len(asked(calls)) <= 31
    log = str(tmp_path / "log")
    for _ in range(2):
        log_answers(composed, path, log)
    assert entries(spark, log) == [f"answer P:{i}" for i in range(30)]


def test_a_path_that_cannot_be_read_is_no_empty_one(spark, tmp_path):
    (tmp_path / "commits").mkdir()
    (tmp_path / "commits" / "part-0.parquet").write_text("this is no Parquet")
    with pytest.raises(Exception, match="(?i)parquet|not exist"):
        answers(spark, str(tmp_path)).collect()

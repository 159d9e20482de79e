"""Words asked for and answered, against all pairs in plain Python."""

import random

from pyspark.sql import functions as F

from glossaria.operators import coverage as coverage_module
from glossaria.operators.coverage import asked_words, coverage, deletion_keys


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(asked, answered):
    out = []
    for batch in {b for b, _ in asked} | {b for b, _ in answered}:
        want = {w.strip().lower() for b, w in asked if b == batch and w and w.strip()}
        have = {w.strip().lower() for b, w in answered if b == batch and w and w.strip()}
        used = set()
        for w in want:
            if w in have:
                out.append((batch, w, w, "answered", 0))
                continue
            near = [(d, a) for a in have - want if (d := edits(w, a)) <= (2 if max(len(w), len(a)) >= 6 else 1 if max(len(w), len(a)) >= 3 else 0)]
            if near:
                used.add(min(near)[1])
                out.append((batch, w, min(near)[1], "corrected", min(near)[0]))
            else:
                out.append((batch, w, None, "skipped", None))
        out += [(batch, None, a, "unasked", None) for a in have - want - used]
    return sorted(out, key=repr)


def changed(rng, word):
    word = list(word)
    for _ in range(rng.randrange(4)):
        at, kind = rng.randrange(len(word) + 1), rng.randrange(3)
        if kind == 0:
            word.insert(at, rng.choice("abcé"))
        elif at < len(word):
            word[at : at + 1] = [] if kind == 1 else [rng.choice("abcé")]
    return "".join(word)


def test_coverage_equals_all_pairs(spark):
    rng, asked, answered = random.Random(1), [], []
    for batch in "xyz":
        for _ in range(150):
            word = "".join(rng.choice("abcé") for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 19, 20, 21, 22, 24, 60])))
            asked.append((batch, word))
            answered += [(batch, changed(rng, word)) for _ in range(rng.randrange(3))]
    asked += [("x", "  Both "), ("x", None), ("x", " "), ("q", "alone"), ("x", "twice"), ("x", "twice")]
    answered += [("x", "bOTH"), ("x", None), ("r", "lonely"), ("x", "twice"), ("x", "twice")]
    got = coverage(spark.createDataFrame(asked, "batch_id string, word string"), spark.createDataFrame(answered, "batch_id string, Word string"))
    want = brute(asked, answered)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {x[3] for x in want} == {"answered", "corrected", "skipped", "unasked"} and sum(x[3] == "corrected" for x in want) > 60
    empty = spark.createDataFrame([], "batch_id string, word string")
    assert coverage(empty, empty.withColumnRenamed("word", "Word")).count() == 0


def test_keys_are_few(spark):
    words = spark.createDataFrame([("abcdefghijklmnopqrstuvwxyz" * 20,), ("abcdef",), ("ab",)], "w string")
    assert [r[0] for r in words.select(F.size(deletion_keys(F.col("w")))).collect()] == [1 + 20 + 190, 1 + 6 + 15, 3]


def test_asked_words_are_lines(spark):
    rows = asked_words(spark.createDataFrame([("1", "one\n\n two \n"), ("2", None)], "batch_id string, words string")).collect()
    assert [(r["batch_id"], r["word"]) for r in rows] == [("1", "one"), ("1", " two ")]


def test_keys_are_not_broadcast(spark):
    """A table of words looks small; its keys are a hundred times as many rows."""
    words = spark.range(400).select(F.lit("b").alias("batch_id"), F.concat(F.lit("word "), F.substring(F.md5(F.col("id").cast("string")), 1, 6)).alias("word"))
    words = spark.createDataFrame(words.collect(), words.schema)
    plan = coverage(words.where("word < 'word 8'"), words.where("word >= 'word 8'").withColumnRenamed("word", "Word"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan


def test_keys_of_two_edits_are_made_for_open_words_only(spark, monkeypatch):
    """Words with a partner one edit away don't meet those two edits away, and take the nearest all the same."""
    met = []
    nearest = coverage_module._nearest

    def counted(open_, other, edits):
        met.append((edits, sorted(r["word"] for r in open_.collect())))
        return nearest(open_, other, edits)

    monkeypatch.setattr(coverage_module, "_nearest", counted)
    asked = spark.createDataFrame([("x", "valley"), ("x", "garden"), ("x", "lonely")], "batch_id string, word string")
    answered = spark.createDataFrame([("x", "vallxy"), ("x", "aalexy"), ("x", "gardxx"), ("x", "gaxxen")], "batch_id string, Word string")
    got = {r["word"]: (r["answer"], r["edits"]) for r in coverage(asked, answered).where("word is not null").collect()}
    assert got == {"valley": ("vallxy", 1), "garden": ("gardxx", 2), "lonely": (None, None)}
    assert met == [(1, ["garden", "lonely", "valley"]), (2, ["garden", "lonely"])]
